"""A script's statements: split at semicolons outside quotes and comments."""

from __future__ import annotations

import re

#: What a piece of a script begins with; anything else is plain text.
OPENING = re.compile(r"['\"`;]|--|/\*")
QUOTED = {"'": re.compile(r"'(?:[^'\\]|\\.)*'", re.S), '"': re.compile(r'"(?:[^"\\]|\\.)*"', re.S), "`": re.compile(r"`[^`]*`", re.S)}


def comment_end(text: str, at: int) -> int | None:
    """The end of the comment that opens at ``at``; comments nest.  None where it doesn't end."""
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return None


def split(text: str) -> tuple[list[str], str]:
    """The finished statements, without their semicolons and comments, and what follows the last of them.

    A comment leaves a space; hints (``/*+ ... */``) stay.  Statements of nothing are left out.
    """
    done: list[str] = []
    held: list[str] = []
    at = begin = 0
    while m := OPENING.search(text, at):
        held.append(text[at : m.start()])
        opened = m[0]
        if opened == ";":
            done.append("".join(held).strip())
            held, at = [], m.end()
            begin = at
        elif opened == "--":
            end = text.find("\n", m.end())
            if end < 0:
                break
            held.append(" ")
            at = end
        elif opened == "/*":
            end = comment_end(text, m.start())
            if end is None:
                break
            held.append(text[m.start() : end] if text.startswith("/*+", m.start()) else " ")
            at = end
        else:
            quoted = QUOTED[opened].match(text, m.start())
            if not quoted:
                break
            held.append(quoted[0])
            at = quoted.end()
    return [s for s in done if s], text[begin:]


def bare(text: str) -> str:
    """One statement without comments, or as it stands where a quote or comment in it doesn't end."""
    done, rest = split(text.rstrip() + "\n;")
    if rest.strip() or len(done) > 1:
        return text.strip()
    return done[0] if done else ""

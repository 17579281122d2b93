"""Byte-level BPE vocabularies: exact ids, and the strings proven to be one token alone.

The vocabulary file is read where it is installed; its path is a parameter.  Encoding uses a
rank-based encoder over the same vocabulary, several times faster than the library of the
``.json`` file.  The two agree wherever their Unicode tables do; a text with characters
outside ``SETTLED`` is given to the library itself.
"""

from __future__ import annotations

import functools
import json
import re

#: Characters on whose classes (letter, number, space) all Unicode versions and engines agree.
SETTLED = re.compile("[\x00-\x1b\x20-\x84\x86-\xa7\xa9-ȠȢ-ȳ‐-‧‰-⁞₠-₵]*")
#: The vocabulary's own split of a text, in the classes of Python's re, over settled characters.
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_²³¹¼½¾]+| ?[\d²³¹¼½¾]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Fixed value: the split pattern that byte-level BPE vocabularies of this family were made with.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Between a letter and a space before a letter the split always cuts.
CUT = re.compile(r"(?<=[^\W\d_²³¹¼½¾]) (?=[^\W\d_²³¹¼½¾])")


def parts(text: str, size: int = 1 << 20):
    """A settled text in parts of about ``size`` characters that encode apart as they do together."""
    at = 0
    while len(text) - at > size and (cut := CUT.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write a byte as itself if printable, else as the next character from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> "Encoder":
    return Encoder(path)


class Encoder:
    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        back = _byte_of_char()
        ranks = {bytes(back[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.ranks = ranks
        self.fast = tiktoken.Encoding("bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=self.special)
        self.names = set(self.special)

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> list[int]:
        """Ids as the library gives them, special strings handled as its default, none added."""
        if SETTLED.fullmatch(text):
            return [i for part in parts(text) for i in self.fast.encode(part, allowed_special=self.names, disallowed_special=())]
        return self.library.encode(text, add_special_tokens=False).ids


def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings proven to encode alone as one token.

    A string is proven if the split leaves it whole and the merges end at its own single id.
    """
    e = encoder(path)
    proven = set()
    for raw, i in e.ranks.items():
        try:
            s = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        m = PRETOKEN.match(s)
        if m and m.end() == len(s) and SETTLED.fullmatch(s) and e.fast.encode_ordinary(s) == [i]:
            proven.add(s)
    return frozenset(proven)


class TokenCounter:
    """Counts tokens: pre-tokens that are whole tokens are counted by look-up, only the rest is merged."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.encoder, self.whole = encoder(path), whole
        self.plain = re.compile(r" [^\W\d_²³¹¼½¾]+").fullmatch
        self.specials = re.compile("|".join(map(re.escape, sorted(self.encoder.special, key=len, reverse=True))) or r"(?!)")

    def count(self, text: str) -> int:
        if not SETTLED.fullmatch(text):
            return len(self.encoder.library.encode(text, add_special_tokens=False).ids)
        between = self.specials.split(text)
        return len(between) - 1 + sum(self._ordinary(part) for piece in between for part in parts(piece))

    def _ordinary(self, text: str) -> int:
        tokens = PRETOKEN.findall(text)
        whole, plain, merge = self.whole, self.plain, self.encoder.fast.encode_ordinary
        rest = [t for t in tokens if t not in whole]
        # Words that start with a space are split at the same places when they stand side by side.
        together = [t for t in rest if plain(t)]
        n = len(tokens) - len(rest) + len(merge("".join(together)))
        if len(together) < len(rest):
            n += sum(len(merge(t)) for t in rest if not plain(t))
        return n

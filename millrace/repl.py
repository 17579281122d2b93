"""An interactive prompt: statements end with a semicolon, results come as bar-terminated lines."""

from __future__ import annotations

import argparse
import sys
import time
from typing import TextIO

from millrace.functions.rendering import lines
from millrace.plans.engine import Engine
from millrace.plans.statements import bare, split
from millrace.session import session

PROMPT = "$>"


def message(error: Exception) -> str:
    """The first line of an error that says something."""
    said = (line.strip() for line in str(error).splitlines())
    return next(filter(None, said), type(error).__name__)


def repl(engine: Engine, source: TextIO = sys.stdin, out: TextIO = sys.stdout, times: TextIO | None = None) -> None:
    """Read and run statements until the input ends or ``exit;``; an error is printed, and the next is read.

    A statement may take several lines, and a line may hold several statements; semicolons in quotes
    and comments end none.  A statement that the end of the input cuts off is reported, not run.
    Each query's time goes to ``times``, if given.
    """
    held = ""
    print(PROMPT, end="", file=out, flush=True)
    for line in source:
        statements, held = split(held + line.rstrip("\n") + "\n")
        for statement in statements:
            if statement.lower() in ("exit", "quit"):
                return
            began = time.perf_counter()
            try:
                result = engine.execute(statement)
                for text in lines(result) if result is not None else ():
                    print(text, file=out)
            except Exception as error:  # whatever a statement does, the prompt goes on
                print(message(error), file=out)
            if times:
                print(f"{1000 * (time.perf_counter() - began):.0f} ms", file=times, flush=True)
        if statements:
            print(PROMPT, end="", file=out, flush=True)
    if bare(held):
        print(f"unfinished statement: {held.strip()[:60]!r}", file=out)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="millrace")
    parser.add_argument("data", nargs="?", default="data", help="folder of the tables' files")
    parser.add_argument("--in-mem", action="store_true", help="keep tables in memory after their first use")
    parser.add_argument("--master", default="local[*]")
    chosen = parser.parse_args(arguments)
    repl(Engine(session(chosen.master), chosen.data, "memory" if chosen.in_mem else "disk"), times=sys.stderr)


if __name__ == "__main__":
    main()

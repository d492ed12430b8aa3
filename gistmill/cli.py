"""Command line: compress, detect, benchmark. One text needs no cluster, so no session is started."""

from __future__ import annotations

import argparse
import sys

from gistmill.functions import plain
from gistmill.operators.segments import segment_text
from gistmill.options import Options
from gistmill.sources.io import report, resolve_input

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gistmill", description="Explainable context reduction: fewer tokens, and a record of what went.")
    top.add_argument("--version", action="version", version=VERSION)
    commands = top.add_subparsers(dest="command", required=True)
    for name, help_ in (("compress", "reduce a text and print it"), ("detect", "print what kind of content a text is"), ("benchmark", "reduce a file and print the figures")):
        p = commands.add_parser(name, help=help_)
        if name == "benchmark":
            p.add_argument("file")
        else:
            p.add_argument("input", nargs="?")
            p.add_argument("-f", "--file")
            p.add_argument("-s", "--stdin", action="store_true")
        if name != "detect":
            p.add_argument("-m", "--model", default="chars/4")
            p.add_argument("-r", "--ratio", type=float, default=0.3)
            p.add_argument("--ml", action="store_true")
        if name == "compress":
            p.add_argument("--quiet", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        text = resolve_input(getattr(a, "input", None), a.file, getattr(a, "stdin", False))
        if a.command == "detect":
            kind, sure, _ = plain.detect(text)
            print(f"{kind} (confidence {100 * sure:.0f}%)")
            return 0
        made = segment_text(text, Options(a.ratio, model=a.model, use_model=a.ml))
        if a.command == "benchmark" or not a.quiet:
            sys.stderr.write(report(made, VERSION))
        if a.command == "compress":
            print(made["compressed"])
    except (OSError, ValueError) as e:
        sys.stderr.write(f"Error: {e}\n")
        return 1
    return 0

"""Command line: index, ask, pack, outline, stats, shell, serve."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from corvane.config import HOME
from corvane.engine import Engine
from corvane.plans.ranking import fixed
from corvane.serving.color import styler
from corvane.serving.tools import result_line
from corvane.sources.store import export_json, results_json

VERSION = "0.1.0"


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        raise ValueError(message)


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="corvane", description="The slice of a codebase that matters for a task.")
    sub = p.add_subparsers(dest="command", parser_class=_Parser)
    index = sub.add_parser("index", help="build the index of a tree")
    index.add_argument("path", nargs="?", default=".")
    index.add_argument("--json", action="store_true", help="also write the index as one JSON document")
    ask = sub.add_parser("ask", help="rank the codebase for a task")
    ask.add_argument("task", nargs="+")
    ask.add_argument("--top", type=float)
    ask.add_argument("--json", action="store_true")
    ask.add_argument("--tests", action="store_true", help="don't demote tests and fixtures")
    pack = sub.add_parser("pack", help="pack the most relevant code within a budget")
    pack.add_argument("task", nargs="+")
    pack.add_argument("--budget", type=float)
    pack.add_argument("--out")
    pack.add_argument("--tests", action="store_true")
    sub.add_parser("outline", help="symbols of a file or tree").add_argument("path", nargs="?")
    sub.add_parser("stats", help="size of the index")
    sub.add_parser("shell", aliases=["tui"], help="interactive search").add_argument("--top", type=int)
    sub.add_parser("serve", help="JSON-RPC over standard input and output")
    sub.add_parser("version")
    sub.add_parser("help")
    return p


def _run(a: argparse.Namespace) -> None:
    engine = Engine(Path(a.path) if a.command == "index" else Path.cwd())
    if a.command == "index":
        engine.build()
        if a.json:
            export_json(engine.root, engine.index)
        files, chunks, _ = engine.stats()
        print(f"indexed {files} files, {chunks} chunks → {HOME}")
    elif a.command == "ask":
        results = engine.query(" ".join(a.task), top=engine.config.top if a.top is None else a.top, include_tests=a.tests)
        print(results_json(results) if a.json else "\n".join(result_line(r, lambda s: fixed(s, 2), styler(sys.stdout)) for r in results))
    elif a.command == "pack":
        budget = engine.config.budget if a.budget is None else a.budget
        bundle = engine.pack(" ".join(a.task), budget=budget, include_tests=a.tests)
        if a.out:
            Path(a.out).write_text(bundle.text, "utf-8")
        else:
            sys.stdout.write(bundle.text)
        print(f"packed {bundle.tokens} tokens (budget {budget:g}) — {len(bundle.included)} chunk(s) included, {len(bundle.trimmed)} file(s) trimmed", file=sys.stderr)
    elif a.command == "outline":
        path = a.path and a.path.replace("\\", "/")
        print((path and engine.outline_file(path)) or engine.outline_tree(path))
    elif a.command == "stats":
        files, chunks, langs = engine.stats()
        print("\n".join([f"files: {files}", f"chunks: {chunks}", "languages:", *(f"  {lang}: {n}" for lang, n in langs)]))
    elif a.command in ("shell", "tui"):
        from corvane.serving.shell import run

        run(engine, a.top)
    elif a.command == "serve":
        from corvane.serving.server import serve

        serve(engine)


def main(argv: list[str] | None = None) -> int:
    args = sys.argv[1:] if argv is None else argv
    if not args or args[0] in ("help", "--help", "-h"):
        print(parser().format_help())
        return 0
    if args[0] in ("version", "--version"):
        print(VERSION)
        return 0
    try:
        _run(parser().parse_args(args))
    except Exception as e:  # noqa: BLE001 - any failure is one line on standard error
        print(f"corvane: {e}", file=sys.stderr)
        return 1
    return 0

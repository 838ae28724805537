"""An interactive shell: query, open a result by its number, pack."""

from __future__ import annotations

import sys
from typing import TextIO

from corvane.engine import Engine
from corvane.plans.ranking import Result, fixed
from corvane.serving.color import styler
from corvane.serving.tools import result_line

HELP = "Words search. A number shows that result, p and words pack them, q ends."


def preview(engine: Engine, r: Result) -> str:
    rows = [row.split(": ", 1) for row in engine.read(r.file, r.start_line, r.end_line).split("\n")]
    if rows and rows[-1][-1] == "":
        rows.pop()
    width = len(str(r.end_line))
    return "\n".join([f"┌ {r.file}:{r.start_line}-{r.end_line}", *(f"│ {n:>{width}}  {text}" for n, text in rows), "└"])


def run(engine: Engine, top: int | None = None, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    limit = min(engine.config.top, 10) if top is None else top
    style = styler(sink)
    engine.build_if_missing()
    files, chunks, _ = engine.stats()
    print(f"corvane · {engine.root.name} · {files} files, {chunks} chunks\n{HELP}", file=sink)
    last: list[Result] = []
    for raw in source:
        line = raw.strip()
        try:
            if line in ("q", "quit", "exit"):
                break
            if line in ("help", "?"):
                print(HELP, file=sink)
            elif line.startswith("p ") and line[2:].strip():
                bundle = engine.pack(line[2:].strip(), top=limit)
                print(f"{bundle.text}\n~{bundle.tokens} tokens, {len(bundle.included)} chunk(s)", file=sink)
            elif line.isdecimal():
                k = int(line) - 1
                print(preview(engine, last[k]) if 0 <= k < len(last) else f"there is no result {line} to open", file=sink)
            elif line:
                last = engine.query(line, top=limit)
                for i, r in enumerate(last, 1):
                    print(f"{i:>2}  {result_line(r, lambda s: fixed(s, 2), style)}", file=sink)
                if not last:
                    print("nothing found", file=sink)
        except Exception as e:  # noqa: BLE001 - the shell goes on
            print(f"error: {e}", file=sink)
    print("closed", file=sink)

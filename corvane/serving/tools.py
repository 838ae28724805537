"""The five tools of the server: search, outline, read, neighbors and pack.  Each takes arguments and returns text."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from corvane.engine import Engine
from corvane.plans.ranking import Result, fixed


def _tool(name: str, description: str, properties: dict[str, tuple[str, str]], required: list[str]) -> dict[str, Any]:
    schema: dict[str, Any] = {"type": "object", "properties": {k: {"type": t, "description": d} for k, (t, d) in properties.items()}}
    if required:
        schema["required"] = required
    return {"name": f"corvane_{name}", "description": description, "inputSchema": schema}


TOOLS = [
    _tool("search", "Rank the indexed code for a query and return locations, best first.", {"query": ("string", "What to look for."), "top": ("number", "How many results at most (20).")}, ["query"]),
    _tool("outline", "Symbols of a file, or the tree of the repository or of a directory.", {"path": ("string", "File or directory; leave out for everything.")}, []),
    _tool(
        "read", "Numbered lines of a file, by range or by symbol.",
        {"path": ("string", "File."), "startLine": ("number", "First line, from 1."), "endLine": ("number", "Last line."), "symbol": ("string", "Symbol to read instead of a range.")}, ["path"],
    ),
    _tool("neighbors", "Files that a file imports and that import it.", {"path": ("string", "File."), "depth": ("number", "Hops (1).")}, ["path"]),
    _tool("pack", "The code most relevant to a task, within a token budget, as Markdown.", {"task": ("string", "Task."), "budget": ("number", "Tokens (from the settings).")}, ["task"]),
]


def relative(path: str) -> str:
    return path.replace("\\", "/").removeprefix("./")


def shown_score(score: float) -> str:
    return str(int(score)) if score == int(score) else fixed(score, 2)


def result_line(r: Result, score: Callable[[float], str] = shown_score, style: Callable[[str, str], str] = lambda style, text: text) -> str:
    symbol = f" {style('magenta', f'[{r.symbol}]')}" if r.symbol else ""
    return f"{style('cyan', r.file)}{style('dim', f':L{r.start_line}-{r.end_line}')}{symbol} {style('dim', score(r.score))}"


def _text(args: dict, name: str, tool: str) -> str:
    value = args.get(name)
    if not isinstance(value, str) or not value:
        raise ValueError(f'{tool}: "{name}" must be given as text')
    return value


def _search(args: dict, engine: Engine) -> str:
    results = engine.query(_text(args, "query", "corvane_search"), top=args.get("top"))
    return "\n".join(map(result_line, results)) or "nothing found"


def _outline(args: dict, engine: Engine) -> str:
    if not args.get("path"):
        return engine.outline_tree()
    path = relative(args["path"])
    return engine.outline_file(path) or engine.outline_tree(path)


def _read(args: dict, engine: Engine) -> str:
    if not args.get("path"):
        raise ValueError('corvane_read: which file? give its "path"')
    return engine.read(relative(args["path"]), args.get("startLine"), args.get("endLine"), args.get("symbol"))


def _neighbors(args: dict, engine: Engine) -> str:
    if not args.get("path"):
        raise ValueError('corvane_neighbors: which file? give its "path"')
    depth = args.get("depth")
    found = engine.neighbors(relative(args["path"]), 1 if depth is None else int(depth))
    rows = [f"imports ({len(found['imports'])}):", *(f"  {p}" for p in found["imports"])]
    return "\n".join([*rows, f"importedBy ({len(found['imported_by'])}):", *(f"  {p}" for p in found["imported_by"])])


def _pack(args: dict, engine: Engine) -> str:
    return engine.pack(_text(args, "task", "corvane_pack"), budget=args.get("budget")).text


_CALLS = {"corvane_search": _search, "corvane_outline": _outline, "corvane_read": _read, "corvane_neighbors": _neighbors, "corvane_pack": _pack}


def call_tool(name: str, args: dict | None, engine: Engine) -> str:
    if name not in _CALLS:
        raise ValueError(f"there is no tool {name}")
    return _CALLS[name](args or {}, engine)

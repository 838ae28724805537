"""Engine settings: fixed defaults, overlaid by a JSON file beside the index."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

#: Directory, inside an indexed tree, that holds the index and its settings.
HOME = ".corvane"


class ConfigError(ValueError):
    """A settings file that can't be used."""


@dataclass(frozen=True)
class Config:
    """Unknown keys of the file are kept in ``extra``.  ``k1`` and ``b`` are stored but ranking uses its own."""

    max_file_size: int = 1_000_000
    chunk_max_lines: int = 60
    top: int = 20
    budget: int = 8000
    k1: float = 1.5
    b: float = 0.75
    extra: dict[str, Any] = field(default_factory=dict, compare=False)


def _snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


def load_config(root: str | Path) -> Config:
    """Settings of the tree at ``root``; defaults if it has none."""
    path = Path(root) / HOME / "config.json"
    shown = f"{HOME}/config.json"
    try:
        text = path.read_text("utf-8")
    except FileNotFoundError:
        return Config()
    try:
        data = json.loads(text)
    except ValueError as e:
        raise ConfigError(f"invalid JSON in {shown}: {e}") from e
    if not isinstance(data, dict):
        raise ConfigError(f"{shown} must contain a JSON object")
    known = {f.name for f in fields(Config)} - {"extra"}
    named = {_snake(k): v for k, v in data.items()}
    return Config(**{k: v for k, v in named.items() if k in known}, extra={k: v for k, v in data.items() if _snake(k) not in known})

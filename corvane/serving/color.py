"""Colours of terminal output: NO_COLOR turns them off, else FORCE_COLOR on, else a terminal decides."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from typing import TextIO

CODES = {"bold": (1, 22), "dim": (2, 22), "red": (31, 39), "green": (32, 39), "yellow": (33, 39), "magenta": (35, 39), "cyan": (36, 39)}


def enabled(stream: TextIO, env: Mapping[str, str] = os.environ) -> bool:
    if env.get("NO_COLOR"):
        return False
    if env.get("FORCE_COLOR"):
        return env["FORCE_COLOR"] != "0"
    return bool(getattr(stream, "isatty", lambda: False)())


def styler(stream: TextIO, env: Mapping[str, str] = os.environ) -> Callable[[str, str], str]:
    """A function of (style, text) that colours the text, or leaves it as it is."""
    if not enabled(stream, env):
        return lambda style, text: text
    return lambda style, text: f"\x1b[{CODES[style][0]}m{text}\x1b[{CODES[style][1]}m"

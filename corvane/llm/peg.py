"""A small packrat parser: parsing expressions with memoised rules, offsets and actions.

An expression is a function of (text, position, memo) that returns (end, value),
or None where it doesn't match.  ``rule`` memoises by position, so the parse
takes linear time however the alternatives back up.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

Result = tuple[int, Any] | None
Expression = Callable[[str, int, dict], Result]


def term(pattern: str, flags: int = 0) -> Expression:
    """A regular-expression terminal; its value is (start, end)."""
    match = re.compile(pattern, flags).match

    def parse(s: str, i: int, memo: dict) -> Result:
        m = match(s, i)
        return (m.end(), (i, m.end())) if m else None

    return parse


def seq(*parts: Expression) -> Expression:
    def parse(s: str, i: int, memo: dict) -> Result:
        values = []
        for p in parts:
            r = p(s, i, memo)
            if r is None:
                return None
            i, v = r
            values.append(v)
        return i, values

    return parse


def choice(*parts: Expression) -> Expression:
    def parse(s: str, i: int, memo: dict) -> Result:
        for p in parts:
            r = p(s, i, memo)
            if r is not None:
                return r
        return None

    return parse


def many(part: Expression, least: int = 0) -> Expression:
    def parse(s: str, i: int, memo: dict) -> Result:
        values = []
        while (r := part(s, i, memo)) is not None and r[0] > i:
            i = r[0]
            values.append(r[1])
        return (i, values) if len(values) >= least else None

    return parse


def maybe(part: Expression) -> Expression:
    def parse(s: str, i: int, memo: dict) -> Result:
        return part(s, i, memo) or (i, None)

    return parse


def action(part: Expression, f: Callable[[str, int, int, Any], Any]) -> Expression:
    """``part`` with the value f(text, start, end, value)."""

    def parse(s: str, i: int, memo: dict) -> Result:
        r = part(s, i, memo)
        return None if r is None else (r[0], f(s, i, r[0], r[1]))

    return parse


def rule(part: Expression) -> Expression:
    """``part`` memoised by position."""
    key = object()

    def parse(s: str, i: int, memo: dict) -> Result:
        at = (key, i)
        if at not in memo:
            memo[at] = part(s, i, memo)
        return memo[at]

    return parse


def balanced(skip: Expression, opening: str = "([{", closing: str = ")]}") -> Expression:
    """A bracket and all up to the one that closes it, at any depth without recursion; ``skip`` takes strings and comments whole."""
    plain = re.compile(f"[^{re.escape(opening + closing)}'\"`/#]+").match

    def parse(s: str, i: int, memo: dict) -> Result:
        start, depth = i, 0
        if i >= len(s) or s[i] not in opening:
            return None
        while i < len(s):
            if s[i] in opening:
                depth += 1
            elif s[i] in closing:
                depth -= 1
                if not depth:
                    return i + 1, (start, i + 1)
            elif m := plain(s, i):
                i = m.end()
                continue
            elif (r := skip(s, i, memo)) is not None and r[0] > i:
                i = r[0]
                continue
            i += 1
        return None

    return parse

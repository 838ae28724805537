"""Paths: ignore patterns, source priority, and POSIX path arithmetic as expressions."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.config import HOME

#: Always left out of a scan, whatever the ignore file says.
ALWAYS_IGNORED = (".git/", "node_modules/", f"{HOME}/")
ALWAYS_PRUNED = frozenset(p.rstrip("/") for p in ALWAYS_IGNORED)

# Paths of tests, fixtures and other non-source files, and what their scores are multiplied by.
NON_SOURCE_DIR = r"(?i)(^|/)(__tests__|__mocks__|__snapshots__|__fixtures__|tests?|fixtures?|e2e|examples?|docs|node_modules|benchmarks?)(/)"
NON_SOURCE_SUFFIX = r"(?i)\.(test|spec|stories)\.[cm]?[jt]sx?$|\.snap$|\.expect\.md$"
NON_SOURCE_WORD = r"(?i)(^|[^a-z0-9])(tests?|specs?|fixtures?|mocks?|benchmarks?|examples?|stories|e2e)([^a-z0-9]|$)"
DEMOTION = 0.2


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def source_priority(path: Column) -> Column:
    """1 for source, ``DEMOTION`` for tests, fixtures, examples and the like."""
    low = path.rlike(NON_SOURCE_DIR) | path.rlike(NON_SOURCE_SUFFIX) | basename(path).rlike(NON_SOURCE_WORD)
    return F.when(low, F.lit(DEMOTION)).otherwise(F.lit(1.0))


def glob_regex(pattern: str) -> str:
    """Regular expression, to be matched from the start, of one ignore pattern.

    ``*`` and ``?`` stay within a segment, ``**/`` spans any number of them; a slash
    at the start or inside anchors the pattern at the root, one at the end takes
    directories only.  Brackets have no special meaning.
    """
    only_dirs = pattern.endswith("/")
    body = pattern.rstrip("/") if only_dirs else pattern
    anchored = "/" in body
    body = body.removeprefix("/")
    parts = []
    for token in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", body):
        if token == "**/" and (not parts or parts[-1].endswith("/")):
            parts.append("(?:.*/)?")
        elif token.startswith("**"):
            parts.append(".*" + re.escape(token[2:]))
        else:
            parts.append({"*": "[^/]*", "?": "[^/]"}.get(token) or re.escape(token))
    return ("" if anchored else "(?:.*/)?") + "".join(parts) + ("/.*" if only_dirs else "(?:/.*)?") + "$"


def parse_ignore(text: str) -> list[str]:
    """Patterns of an ignore file: blank lines, comments and negations are passed over."""
    rows = [r.strip() for r in re.split(r"\r?\n", text)]
    return [r for r in rows if r and r[0] not in "#!"]


def ignore_regex(patterns: list[str]) -> str:
    """One regular expression for all ``patterns`` and those that always hold."""
    return "^(?:" + "|".join(glob_regex(p) for p in [*patterns, *ALWAYS_IGNORED]) + ")"


def ignored(path: Column, patterns: list[str]) -> Column:
    return path.rlike(ignore_regex(patterns))


def to_posix(path: Column) -> Column:
    """A relative path with forward slashes and without ``./`` in front."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")


def dirname(path: Column) -> Column:
    """Directory of a path, ``.`` at the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def normalized(path: Column) -> Column:
    """POSIX-normalised path: ``.`` and empty segments go, ``..`` takes the segment before; above the root it stays."""
    step = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(
        step,
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.concat(acc, F.array(s))
        ),
    )
    return F.array_join(folded, "/")


def join_py(directory: str, spec: str) -> str:
    return posixpath.normpath(posixpath.join(directory, spec))

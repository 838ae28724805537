"""Declarations of source files, found line by line."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.lang import SYMBOL_RULES, portable, family_py

# What a line must hold for any rule of its family to match; most lines don't.
_HINT = {
    "js": r"\b(?:function|class|const|let|var|default|exports)\b|\)\s*(?::[^{]+)?\{",
    "ts": r"\b(?:function|class|const|let|var|default|exports|interface|type)\b|\)\s*(?::[^{]+)?\{",
    "py": r"\b(?:def|class)\b",
    "other": r"\b(?:func|fn|def|function|class|interface|struct|enum|trait|module)\b",
}
_HINTS = {family: re.compile(portable(p)).search for family, p in _HINT.items()}
_RULES = {family: [(kind, re.compile(portable(p)).match) for kind, p in rules] for family, rules in SYMBOL_RULES.items()}


def symbols_of(text: str, lang: str | None, rows: list[str] | None = None) -> list[tuple[str, str, int, int]]:
    """(name, kind, line, end line) of the declarations of a text, a row for each name on each line.

    If several rules see the same name on a line, the first gives its kind.  A symbol ends on the line before the
    next, the last one at the end of the text.  ``rows`` are its lines, where the caller has them.
    """
    family = family_py(lang)
    hint, rules = _HINTS[family], _RULES[family]
    if rows is None:
        rows = text.split("\n")
    found: list[tuple[str, str, int]] = []
    for n, row in enumerate(rows, 1):
        if hint(row):
            names: set[str] = set()
            for kind, match in rules:
                m = match(row)
                if m and m[1] not in names:
                    names.add(m[1])
                    found.append((m[1], kind, n))
    ends = [max(a[2], b[2] - 1) for a, b in zip(found, found[1:])] + [len(rows)]
    return [(*f, end) for f, end in zip(found, ends)]


_FIELDS = [("ord", T.IntegerType(), pa.int32()), ("name", T.StringType(), pa.string()), ("kind", T.StringType(), pa.string()), ("line", T.IntegerType(), pa.int32()), ("end_line", T.IntegerType(), pa.int32())]


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(name, kind) for name, kind, _ in _FIELDS])))
def _symbols(texts: pa.Array, langs: pa.Array) -> pa.Array:
    flat: list[tuple] = []
    offsets = [0]
    for text, lang in zip(texts.to_pylist(), langs.to_pylist()):
        flat += [(i, *s) for i, s in enumerate(symbols_of(text, lang) if text else [])]
        offsets.append(len(flat))
    columns = list(zip(*flat)) or [()] * len(_FIELDS)
    rows = pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, _, kind) in zip(columns, _FIELDS)], [name for name, _, _ in _FIELDS])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)


def symbol_list(text: Column, lang: Column) -> Column:
    """Array of the declarations of a text, in the text's own row: exploding lines and grouping them back would shuffle them."""
    return _symbols(text, lang)


def extract_symbols(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, ord, name, kind, line, end_line) of (keys…, lang, text); null texts and empty texts have no symbols."""
    return texts.where(F.col("text").isNotNull()).select(*keys, F.inline(symbol_list(F.col("text"), F.col("lang"))))

"""Import specifiers of source files, in source order."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.lang import IMPORT_RULES, portable, family_py

_COMPILED = {f: [re.compile(portable(p), re.M) for p in rules] for f, rules in IMPORT_RULES.items()}


def imports_of(text: str, lang: str | None) -> list[str]:
    """Specifiers as written.  Rules run over the whole text, so statements may span lines; where several see the
    same place, the longest capture stands, and a repeat elsewhere is kept."""
    best: dict[int, str] = {}
    for rule in _COMPILED[family_py(lang)]:
        for m in rule.finditer(text):
            if len(m[1]) > len(best.get(m.start(), "")):
                best[m.start()] = m[1]
    return [best[k] for k in sorted(best)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _imports(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, lang in frames:
        yield pd.Series([imports_of(t, g) if t is not None else [] for t, g in zip(text, lang)])


def import_list(text: Column, lang: Column) -> Column:
    """Array of the specifiers of a text; built-in expressions give no match offsets, so this runs on Arrow batches."""
    return _imports(text, lang)


def extract_imports(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, ord, specifier) of (keys…, lang, text)."""
    listed = texts.where(F.col("text").isNotNull()).select(*keys, import_list(F.col("text"), F.col("lang")).alias("_specs"))
    return listed.select(*keys, F.posexplode("_specs").alias("ord", "specifier"))

"""Gapless line-range chunks of files, cut at symbols."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEFAULT_MAX_LINES = 60


def max_lines_of(value: float | None) -> int:
    """A usable window size: the whole part of a finite number from 1 on, else the default."""
    return int(value) if isinstance(value, (int, float)) and math.isfinite(value) and value >= 1 else DEFAULT_MAX_LINES


def ranges_of(n: int, symbols: list[tuple[str, int, int]], max_lines: float | None = DEFAULT_MAX_LINES) -> list[tuple[int, int, str | None]]:
    """(start line, end line, symbol) of the chunks of one file of ``n`` lines, for (name, line, end line) in source order; as ``chunk_ranges``."""
    size = max_lines_of(max_lines)
    spans = sorted(((max(1, min(a, n)), max(1, min(b, n)), k, name) for k, (name, a, b) in enumerate(symbols)), key=lambda s: s[:3])
    regions: list[tuple[int, int, str | None]] = []
    cursor = 1
    for a, b, _, name in spans:
        if a <= b and cursor <= b:
            regions += [(cursor, a - 1, None), (max(a, cursor), b, name)]
            cursor = b + 1
    regions.append((cursor, n, None))
    return [(s, min(s + size - 1, b), name) for a, b, name in regions for s in range(a, b + 1, size)]


def chunk_ranges(files: DataFrame, symbols: DataFrame, keys: list[str], max_lines: float | None = DEFAULT_MAX_LINES) -> DataFrame:
    """(keys…, chunk_index, start_line, end_line, symbol) that cover lines 1 to ``lines`` of each file without overlap.

    ``files`` holds (keys…, lines), ``symbols`` (keys…, name, line, end_line[, ord]).  Each symbol is clipped to the file
    and to what earlier symbols leave; one wholly inside them vanishes; the rest of the file has null symbols.  Of equal
    ranges the first stands, by ``ord`` or else by name.  Regions are cut into windows of ``max_lines``.
    """
    size = max_lines_of(max_lines)
    sized = files.select(*keys, F.col("lines").cast("int").alias("_n")).where("_n >= 1")

    def clip(c: str) -> F.Column:
        return F.greatest(F.lit(1), F.least(F.floor(c).cast("int"), F.col("_n")))

    spans = (
        symbols.select(*keys, F.col("name").alias("_name"), F.col("ord" if "ord" in symbols.columns else "name").alias("_ord"), F.col("line").alias("_l"), F.col("end_line").alias("_e"))
        .where("_l is not null and _e is not null")
        .join(sized, keys)
        .select(*keys, "_n", "_name", "_ord", clip("_l").alias("_a"), clip("_e").alias("_b"))
        .where("_a <= _b")
    )
    before = W.partitionBy(*keys).orderBy("_a", "_b", "_ord").rowsBetween(W.unboundedPreceding, -1)
    cursor = F.coalesce(F.max("_b").over(before), F.lit(0)) + 1
    kept = spans.withColumn("_cursor", cursor).withColumn("_start", F.greatest("_a", "_cursor")).where("_start <= _b")
    inner = kept.select(
        *keys,
        F.inline(
            F.filter(
                F.array(
                    F.struct(F.col("_cursor").alias("a"), (F.col("_start") - 1).alias("b"), F.lit(None).cast("string").alias("symbol")),
                    F.struct(F.col("_start").alias("a"), F.col("_b").alias("b"), F.col("_name").alias("symbol")),
                ),
                lambda r: r["a"] <= r["b"],
            )
        ),
    )
    ends = kept.groupBy(*keys).agg(F.max("_b").alias("_last"))
    tail = (
        sized.join(ends, keys, "left")
        .select(*keys, (F.coalesce("_last", F.lit(0)) + 1).alias("a"), F.col("_n").alias("b"), F.lit(None).cast("string").alias("symbol"))
        .where("a <= b")
    )
    windows = inner.unionByName(tail).select(*keys, "b", "symbol", F.explode(F.sequence(F.col("a"), F.col("b"), F.lit(size))).alias("start_line"))
    index = F.row_number().over(W.partitionBy(*keys).orderBy("start_line")) - 1
    return windows.select(
        *keys, index.alias("chunk_index"), "start_line", F.least(F.col("start_line") + size - 1, F.col("b")).alias("end_line"), "symbol"
    )

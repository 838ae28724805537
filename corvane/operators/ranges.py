"""Line ranges: what remains of ranked ranges after those before them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.textops import lines


def subtract_covered(ranges: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """(keys…, rank, start_line, end_line) of the lines of each range that no range of smaller rank covers.

    Each line belongs to the smallest rank that covers it; runs of lines with one owner are its segments.  The
    ranges of one group are the results of one task in one file.
    """
    owned = (
        ranges.where("start_line <= end_line")
        .select(*keys, F.col(rank).alias("rank"), F.explode(F.sequence("start_line", "end_line")).alias("_line"))
        .groupBy(*keys, "_line")
        .agg(F.min("rank").alias("rank"))
    )
    island = F.col("_line") - F.row_number().over(W.partitionBy(*keys, "rank").orderBy("_line"))
    return (
        owned.withColumn("_island", island)
        .groupBy(*keys, "rank", "_island")
        .agg(F.min("_line").alias("start_line"), F.max("_line").alias("end_line"))
        .drop("_island")
    )


def sliced_texts(ranges: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, start_line, end_line, text): the lines of each distinct range of (keys…, start_line, end_line), clamped.

    ``texts`` holds (keys…, text).  The ranges of a text come to it as one array, so it is split into lines once; ranges
    without a text are left out, null bounds too.
    """
    asked = ranges.select(*keys, F.struct("start_line", "end_line").alias("_r")).where("_r.start_line is not null and _r.end_line is not null")
    both = texts.select(*keys, "text").join(asked.groupBy(*keys).agg(F.collect_set("_r").alias("_ranges")), keys)

    def cut(rows: F.Column) -> F.Column:
        def one(r: F.Column) -> F.Column:
            first = F.greatest(F.lit(1), r["start_line"])
            n = F.least(F.size(rows), r["end_line"]) - first + 1
            return F.struct(r["start_line"].alias("start_line"), r["end_line"].alias("end_line"), F.array_join(F.slice(rows, first, F.greatest(n, F.lit(0))), "\n").alias("text"))

        return F.transform("_ranges", one)

    # The array of one element names the lines, so that they aren't split again for each range.
    return both.where("text is not null").select(*keys, F.inline(F.element_at(F.transform(F.array(lines(F.col("text"))), cut), 1)))

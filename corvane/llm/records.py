"""Records of a table: one value for each id, however often its row comes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.durable import staged

#: Repeated ids that a broadcast may hold: 16 bytes each.
BROADCAST_IDS = 1_000_000


def distinct_records(df: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """One row (record_id, value) for each id with a non-null value, the smallest of its values.

    Ids that occur once need no comparison, so the repeated ones are found on the id column alone and only their
    values are shuffled.  If there are more of those than a broadcast may hold, all values are grouped by id.
    """
    kind = "string" if df.schema[id_col].dataType.typeName() == "string" else "long"
    ids = df.select(F.col(id_col).cast(kind).alias("record_id")).where("record_id is not null")
    rows = df.select(F.col(id_col).cast(kind).alias("record_id"), F.col(value_col).alias("value")).where("record_id is not null and value is not null")
    repeated = staged(ids.groupBy("record_id").count().where("count > 1").select("record_id"), "repeated-ids")  # read three times below
    if repeated.count() > BROADCAST_IDS:
        return rows.groupBy("record_id").agg(F.min("value").alias("value"))
    once = rows.join(F.broadcast(repeated), "record_id", "left_anti")
    return once.unionByName(rows.join(F.broadcast(repeated), "record_id", "left_semi").groupBy("record_id").agg(F.min("value").alias("value")))


def distinct_texts(df: DataFrame, text_col: str) -> DataFrame:
    """Each non-null text once, as ``text``.

    Texts whose hash and length no other row has are different from all others, so only the rest is shuffled.  If more
    hashes come again than a broadcast may hold, all texts are.
    """
    keyed = df.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("_h"), F.octet_length(text_col).alias("_n"))
    repeated = staged(keyed.groupBy("_h", "_n").count().where("count > 1").select("_h", "_n"), "repeated-texts")  # read three times below
    if repeated.count() > BROADCAST_IDS:
        return keyed.select("text").distinct()
    once = keyed.join(F.broadcast(repeated), ["_h", "_n"], "left_anti").select("text")
    return once.unionByName(keyed.join(F.broadcast(repeated), ["_h", "_n"], "left_semi").select("text").distinct())

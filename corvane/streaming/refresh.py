"""Keeping an index fresh: which files changed, and a table of texts fed by a stream of file versions.

A stream of (keys…, path, text, version) rows is reduced, batch by batch, to the
newest version of each path, from which an index is built.  Batches may be
replayed: a version that isn't newer than the stored one changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.durable import staged, staging
from corvane.functions.textops import content_hash


def changed_files(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, path, change): ``added``, ``changed`` or ``removed`` between two file tables with (keys…, path, hash)."""
    by = [*keys, "path"]
    a = old.select(*by, F.col("hash").alias("_old"), F.lit(True).alias("_was"))
    b = new.select(*by, F.col("hash").alias("_new"), F.lit(True).alias("_is"))
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return a.join(b, by, "full").select(*by, change.alias("change")).where("change is not null")


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the highest version of each path; of equal versions, the one with the largest hash."""
    order = W.partitionBy(*keys, "path").orderBy(F.desc("version"), F.desc("hash"))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


BUCKETS = 256


class FileTable:
    """The newest text of each path, as Parquet in ``BUCKETS`` buckets by the hash of the path.

    An upsert reads and rewrites only the buckets that its batch touches; each is replaced as the job commits.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys

    def _stored(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.folder)
        except AnalysisException:  # nothing stored yet
            return None

    def read(self) -> DataFrame | None:
        stored = self._stored()
        return None if stored is None else stored.drop("bucket")

    def upsert(self, batch: DataFrame) -> None:
        with staging(self.spark):
            self._upsert(batch)

    def _upsert(self, batch: DataFrame) -> None:
        keyed = batch.where("path is not null").withColumn("hash", content_hash(F.col("text")))
        fresh = staged(newest(keyed, self.keys).withColumn("bucket", F.pmod(F.xxhash64(*self.keys, "path"), F.lit(BUCKETS)).cast("int")), "stream-batch")
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        if not touched:
            return
        old = self._stored()
        both = fresh if old is None else newest(old.where(F.col("bucket").isin(touched)).unionByName(fresh, allowMissingColumns=True), [*self.keys, "bucket"])
        ready = staged(both, "stream-buckets") if old is not None else both
        ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.folder)


def refresh_stream(stream: DataFrame, target: FileTable, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Feed ``target`` from a stream of file versions; ``after`` sees each batch once it is stored."""

    def apply(batch: DataFrame, number: int) -> None:
        target.upsert(batch)
        if after is not None:
            after(batch, number)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Frequency of every distinct term: occurrences, records that hold it, and a verdict on its use.

Radix spilling: workers add up the terms of their own batches, and the sums are
written to the shared folder with the hash of their term.  They are partitioned by
its leading bits, as many as the size of all sums asks for; partitions that are
still above ``PART_BYTES`` are split again by the bits that follow, until they fit
or hold one hash only.  One shuffle a level takes each partition to a task of its
own, on disk, where DuckDB streams it into its sums, so no aggregation grows with
the data and none needs a folder of its own.

Because a worker sends each term at most once per gathered batch, a term that
fills a third of the collection arrives as few rows as there are batches.

Defined results: null text or a null list is no record; an empty text or list is
a record without terms; rows with the same record id count once; null list
elements are no terms.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.durable import staged
from corvane.functions.textops import tokenize
from corvane.llm.records import distinct_records

GATHERED = 400_000
#: Bytes of partial sums that one aggregation takes, by ``ROW_BYTES`` a row and the length of its term.
PART_BYTES, ROW_BYTES = 64 << 20, 64
#: Bits that split a partition which came out too large.
SPLIT_BITS = 3
MEMORY = "512MB"
PARTIAL = "term string, occurrences long, records long"
SCHEMA = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])


def _batch(occurrences: Counter, records: Counter) -> pa.RecordBatch:
    terms = list(occurrences)
    out = pa.record_batch(
        [pa.array(terms, pa.string()), pa.array([occurrences[t] for t in terms], pa.int64()), pa.array([records[t] for t in terms], pa.int64())],
        schema=SCHEMA,
    )
    occurrences.clear()
    records.clear()
    return out


def _gather(terms_of):
    """Partial sums of a partition; the row without a term holds the number of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences: Counter = Counter()
        records: Counter = Counter()
        seen = 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                seen += 1
                tf = Counter(terms_of(value))
                occurrences.update(tf)
                records.update(tf.keys())
            if len(occurrences) > GATHERED:
                yield _batch(occurrences, records)
        if occurrences:
            yield _batch(occurrences, records)
        yield pa.record_batch([pa.array([None], pa.string()), pa.array([0], pa.int64()), pa.array([seen], pa.int64())], schema=SCHEMA)

    return run


def of_text(value: str) -> list[str]:
    return tokenize(value)


def of_list(value: list) -> list[str]:
    return [v for v in value if v is not None]


def _aggregate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by term of one radix partition; DuckDB takes the batches as they come and holds the distinct terms only."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
    try:
        rows = (pa.RecordBatch.from_arrays(b.columns[:3], schema=SCHEMA) for b in batches)
        con.register("part", pa.RecordBatchReader.from_batches(SCHEMA, rows))
        sums = con.sql("SELECT term, sum(occurrences)::BIGINT AS occurrences, sum(records)::BIGINT AS records FROM part GROUP BY term")
        for out in sums.to_arrow_reader(50_000):
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out.columns, SCHEMA)], schema=SCHEMA)
    finally:
        con.close()


def _bits(h: str, used: int, bits: int) -> Column:
    """The ``bits`` bits of a hash that follow its first ``used``."""
    return F.shiftrightunsigned(F.shiftleft(h, used), 64 - bits) if bits else F.lit(0).cast("long")


def _level(rows: DataFrame, parents: int, used: int, bits: int, part_bytes: int) -> list[DataFrame]:
    """Sums of the partitions of ``rows`` (term, occurrences, records, _h, _w, _p), those of the next levels included.

    ``_p`` numbers the ``parents`` partitions that are split here, by ``bits`` bits after the first ``used``.
    """
    by = rows.withColumn("_r", F.shiftleft("_p", bits) + _bits("_h", used, bits))
    sizes = by.groupBy("_r").agg(F.sum("_w").alias("_size"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
    # A partition of one hash can't be split, and needs no more memory however many rows it has.
    large = sizes.where((F.col("_size") > part_bytes) & (F.col("_lo") != F.col("_hi"))).select("_r")
    n = large.count()
    if n:  # read twice below; as many rows as partitions at most
        large = staged(large.select("_r", (F.row_number().over(W.orderBy("_r")) - 1).cast("long").alias("_next")), "large-partitions")
    fits = by.join(large, "_r", "left_anti") if n else by
    sums = fits.repartitionById(parents << bits, F.col("_r").cast("int")).select(*SCHEMA.names).mapInArrow(_aggregate, PARTIAL)
    if not n:
        return [sums]
    over = by.join(large, "_r").select(*SCHEMA.names, "_h", "_w", F.col("_next").alias("_p"))
    return [sums, *_level(over, n, used + bits, min(SPLIT_BITS, 64 - used - bits), part_bytes)]


def radix_sums(partial: DataFrame, part_bytes: int | None = None) -> tuple[DataFrame, int]:
    """Sums of ``partial`` (term, occurrences, records) by term, and the records of its rows without a term."""
    part_bytes = PART_BYTES if part_bytes is None else part_bytes
    weight = F.coalesce(F.octet_length("term"), F.lit(0)).cast("long") + ROW_BYTES
    keyed = staged(partial.select(*SCHEMA.names, F.xxhash64("term").alias("_h"), weight.alias("_w")), "partial-terms")  # read twice a level
    size, total = keyed.agg(F.sum("_w"), F.sum(F.when(F.col("term").isNull(), F.col("records")))).first()
    at_least = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Twice the partitions that the size asks for, so that an even spread leaves none too large.
    bits = math.ceil(math.log2(max(1, 2 * (size or 0) / part_bytes, at_least)))
    first, *more = _level(keyed.withColumn("_p", F.lit(0).cast("long")), 1, 0, bits, part_bytes)
    for sums in more:
        first = first.unionByName(sums)
    return first.where("term is not null"), int(total or 0)


def term_frequencies(
    df: DataFrame, value_col: str, *, id_col: str | None = None, rare_records: int = 1, common_share: float = 0.05
) -> DataFrame:
    """(term, occurrences, records, verdict) for all terms of a text or string-list column.

    ``verdict`` is ``rare`` for a term in at most ``rare_records`` records, ``common`` for one in more than
    ``common_share`` of them, else null.  With ``id_col``, rows of the same id are one record, the smallest text.
    """
    is_list = df.schema[value_col].dataType.typeName() == "array"
    if id_col is not None:
        values = distinct_records(df, id_col, value_col).select("value")
    else:
        values = df.select(F.col(value_col).alias("value")).where("value is not null")
    sums, total = radix_sums(values.mapInArrow(_gather(of_list if is_list else of_text), PARTIAL))
    verdict = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > F.lit(common_share) * F.lit(total), "common")
    return sums.withColumn("verdict", verdict)

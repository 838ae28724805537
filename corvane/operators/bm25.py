"""Inverted index and BM25 scores, for any number of corpora at once.

A corpus is the set of rows with equal ``keys`` (say, a repository); a chunk is
named by ``chunk_id``, unique within all corpora.  Postings are a fact table, so a
query touches the postings of its own terms only.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.durable import staged
from corvane.functions.textops import tokenize, tokenize_col

K1, B = 1.5, 0.75
#: Terms of all tasks together that a broadcast may hold.
BROADCAST_TERMS = 200_000


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())])))
def _term_counts(texts: pa.Array) -> pa.Array:
    terms: list[str] = []
    counts: list[int] = []
    offsets = [0]
    for text in texts.to_pylist():
        tf = Counter(tokenize(text))
        terms += tf.keys()
        counts += tf.values()
        offsets.append(len(terms))
    rows = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int32())], ["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)


def forward_index(chunks: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys…, chunk_id, doc_len, terms): the terms of each chunk with their counts, in the chunk's own row.

    Counting in one row needs no shuffle; built-in functions would have to explode the words and group them by
    chunk, twice.  Null and empty texts have no terms and length 0.
    """
    counted = chunks.select(*keys, "chunk_id", _term_counts(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
    return counted.select(*keys, "chunk_id", F.aggregate("terms", F.lit(0), lambda n, t: n + t["tf"]).alias("doc_len"), "terms")


def postings(forward: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, chunk_id, term, tf) of a forward index."""
    return forward.select(*keys, "chunk_id", F.inline("terms"))


def term_df(index: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, term, df)."""
    return index.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(lengths: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, n, avgdl) of (keys…, chunk_id, doc_len): chunks and their mean length; without keys always one row."""
    return lengths.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avgdl"))


def query_terms(tasks: DataFrame, keys: list[str], text: str = "task") -> DataFrame:
    """(task_id, keys…, term, q_count, q_ord) of (task_id, keys…, task): ``q_ord`` is the term's first place in the task."""
    listed = tasks.where(F.col(text).isNotNull()).select("task_id", *keys, F.posexplode(tokenize_col(F.col(text))).alias("_pos", "term"))
    return listed.groupBy("task_id", *keys, "term").agg(F.count(F.lit(1)).cast("int").alias("q_count"), F.min("_pos").alias("q_ord"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def contribution(tf: Column, doc_len: Column, df: Column, n: Column, avgdl: Column, q_count: Column, k1: float = K1, b: float = B) -> Column:
    mean = F.when(avgdl == 0, F.lit(1.0)).otherwise(avgdl)
    return idf(n, df) * ((tf * (k1 + 1)) / (tf + k1 * (1 - b + b * (doc_len / mean)))) * q_count


def bm25_scores(
    terms: DataFrame, index: DataFrame, dfs: DataFrame, lengths: DataFrame, stats: DataFrame, keys: list[str], k1: float = K1, b: float = B, carried: tuple[str, ...] = ()
) -> DataFrame:
    """(task_id, keys…, chunk_id, score) for all chunks that share a term of positive idf with a task.

    Contributions are added in the order in which terms occur in the task, so equal scores come out equal on any
    partitioning.  ``carried`` columns of ``lengths`` come along.
    """
    by = [*keys, "term"]
    # Postings and counts of other terms drop out before anything is shuffled, if the terms asked for fit a broadcast.
    terms = staged(terms, "query-terms")
    asked = terms.select(*by).distinct()
    if terms.count() <= BROADCAST_TERMS:
        asked = F.broadcast(asked)
        dfs, index = dfs.join(asked, by, "left_semi"), index.join(asked, by, "left_semi")
    known = terms.join(dfs, by)
    if keys:
        known = known.join(stats, keys)
    else:  # a single corpus: two numbers
        total = stats.first()
        known = known.withColumn("n", F.lit(total["n"])).withColumn("avgdl", F.lit(total["avgdl"]))
    known = known.where(idf(F.col("n"), F.col("df")) > 0)
    hits = known.join(index, by).join(lengths.select("chunk_id", "doc_len", *carried), "chunk_id", "left")
    part = contribution(F.col("tf"), F.coalesce("doc_len", F.lit(0)), F.col("df"), F.col("n"), F.col("avgdl"), F.col("q_count"), k1, b)
    # As many contributions a chunk as the task has terms.
    added = F.aggregate(F.array_sort(F.collect_list(F.struct("q_ord", part.alias("c")))), F.lit(0.0), lambda acc, x: acc + x["c"])
    return hits.groupBy("task_id", *keys, "chunk_id").agg(added.alias("score"), *[F.max(c).alias(c) for c in carried])

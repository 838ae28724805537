"""Ranking: BM25, boosts for matching symbols and near files, demotion of non-source, and the best chunks.

One plan ranks any number of tasks, each within its corpus; a single task is one
row.  Boosts are left joins from the scored chunks, so they never add any.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.durable import staged
from corvane.functions.paths import basename, source_priority
from corvane.functions.textops import identifier_parts
from corvane.operators import bm25
from corvane.plans.index import Index

# Fixed values of the ranking.
SYMBOL_BOOST, SYMBOL_CAP = 1.5, 3.0
GRAPH_BOOST = 0.5
SEEDS = 10
DEFAULT_TOP = 20


def check_top(top: object) -> int:
    if isinstance(top, bool) or not isinstance(top, (int, float)) or top != top or top in (float("inf"), float("-inf")) or top != int(top) or top < 0:
        raise ValueError("top must be a non-negative integer")
    return int(top)


def symbol_matches(query: Column, pieces: Column) -> Column:
    """Query terms, repeats included, among the pieces of a symbol's name."""
    return F.filter(query, lambda q: F.array_contains(pieces, q))


def chunk_facts(chunks: DataFrame) -> DataFrame:
    """What ranking knows of a chunk whatever the task: its place, its symbol's pieces, and its priority as source."""
    pieces = F.when(F.col("symbol").isNotNull() & (F.col("symbol") != ""), identifier_parts(F.col("symbol"))).otherwise(F.array().cast("array<string>"))
    return chunks.select("chunk_id", "path", "start_line", "end_line", "symbol", pieces.alias("_pieces"), source_priority(F.col("path")).alias("priority"))


def _order() -> list[Column]:
    return [F.desc("score"), F.asc("path"), F.asc("start_line"), F.asc("chunk_id")]


def text_scores(index: Index, tasks: DataFrame) -> DataFrame:
    """(task_id, keys…, chunk_id, score, weight): BM25 of all chunks of each task that share a term with it, and their weight as source."""
    keys = index.keys
    weighed = index.chunks.select("chunk_id", "doc_len", source_priority(F.col("path")).alias("weight"))
    return bm25.bm25_scores(bm25.query_terms(tasks, keys), index.postings, index.terms, weighed, index.corpus, keys, carried=("weight",))


def in_reach(scores: DataFrame, tasks: DataFrame, limit: Column, most: int, include_tests: bool) -> DataFrame:
    """The scores that boosts may still lift among the seeds or the best ``limit`` of their task; none that may is left out.

    Boosts add at most ``SYMBOL_CAP`` and ``GRAPH_BOOST``.  A chunk further below the last of the best by text alone can't
    reach them, so only ids and scores are compared before anything is joined to them.
    """
    weight = F.lit(1.0) if include_tests else F.col("weight")

    def floor(value: Column, n: Column, bound: int, name: str) -> DataFrame:
        order = W.partitionBy("task_id").orderBy(F.desc("_v"))
        best = scores.select("task_id", value.alias("_v")).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.lit(bound))
        return best.join(tasks.select("task_id", n.alias("_limit")), "task_id").where("_n = _limit").select("task_id", F.col("_v").alias(name))

    floors = floor(F.col("score"), F.lit(SEEDS), SEEDS, "_seeds").join(floor(F.col("score") * weight, limit.cast("int"), most, "_best"), "task_id", "full")
    seed = F.col("_seeds").isNull() | (F.col("score") + SYMBOL_CAP >= F.col("_seeds"))
    best = F.col("_best").isNull() | ((F.col("score") + SYMBOL_CAP + GRAPH_BOOST) * weight * (1 + 1e-9) >= F.col("_best"))
    return scores.join(floors, "task_id", "left").where(seed | best).drop("_seeds", "_best", "weight")


def score_chunks(index: Index, tasks: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """Scored chunks of (task_id, keys…, task) before the graph boost: bm25, matched symbols, score with their boost, and priority.

    ``scored`` may give the text scores of the chunks that matter; else it is all of them.
    """
    if scored is None:
        scored = text_scores(index, tasks).drop("weight")
    listed = tasks.select("task_id", bm25.tokenize_col(F.col("task")).alias("_q"))
    full = scored.join(chunk_facts(index.chunks), "chunk_id").join(listed, "task_id")
    matched = full.withColumnRenamed("score", "bm25").withColumn("matched", symbol_matches(F.col("_q"), F.col("_pieces"))).drop("_q", "_pieces")
    boost = F.when(F.size("matched") > 0, F.least(F.lit(SYMBOL_BOOST) * F.size("matched"), F.lit(SYMBOL_CAP))).otherwise(F.lit(0.0))
    return matched.withColumn("score", F.col("bm25") + boost)


def graph_sources(scored: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(task_id, path, source): files next to a task's seeds, and the seed file that reaches each first.

    Seeds are the best ``SEEDS`` chunks; a seed reaches the files it imports, then those that import it.
    """
    seeds = (
        scored.withColumn("_rank", F.row_number().over(W.partitionBy("task_id").orderBy(*_order())))
        .where(F.col("_rank") <= SEEDS)
        .select("task_id", *keys, F.col("path").alias("source"), "_rank")
    )
    reach = edges.select(*keys, F.col("src").alias("source"), F.col("dst").alias("path"), F.lit(0).alias("_dir"), F.col("out_pos").alias("_pos")).unionByName(
        edges.select(*keys, F.col("dst").alias("source"), F.col("src").alias("path"), F.lit(1).alias("_dir"), F.col("in_pos").alias("_pos"))
    )
    return (
        seeds.join(reach, [*keys, "source"])
        .groupBy("task_id", "path")
        .agg(F.min_by("source", F.struct("_rank", "_dir", "_pos")).alias("graph_source"))
    )


def rank_tasks(index: Index, tasks: DataFrame, *, top: Column | int = DEFAULT_TOP, include_tests: bool = False) -> DataFrame:
    """(task_id, keys…, rank, chunk_id, path, start_line, end_line, symbol, score, bm25, matched, graph_source, priority).

    ``tasks`` holds (task_id, keys…, task); ``top`` may be a column of it.
    """
    keys = index.keys
    limit = top if isinstance(top, Column) else F.lit(check_top(top))
    # A literal bound lets each partition keep only so many rows of a task before they are shuffled.
    most = tasks.agg(F.max(limit)).first()[0] or 0 if isinstance(top, Column) else check_top(top)
    texts = staged(text_scores(index, tasks), "text-scores")  # ids and scores only, read three times
    scored = staged(score_chunks(index, tasks, in_reach(texts, tasks, limit, int(most), include_tests)), "scored")  # read for the seeds and for the ranks
    near = graph_sources(scored, index.edges, keys)
    boosted = scored.join(near, ["task_id", "path"], "left").withColumn(
        "score", F.when(F.col("graph_source").isNotNull(), F.col("score") + GRAPH_BOOST).otherwise(F.col("score"))
    )
    weighed = boosted.withColumn("priority", F.lit(1.0)) if include_tests else boosted
    final = weighed.withColumn("score", F.when(F.col("priority") != 1.0, F.col("score") * F.col("priority")).otherwise(F.col("score")))
    ranked = final.withColumn("rank", F.row_number().over(W.partitionBy("task_id").orderBy(*_order()))).where(F.col("rank") <= F.lit(int(most)))
    if isinstance(top, Column):
        ranked = ranked.join(tasks.select("task_id", limit.cast("int").alias("_top")), "task_id").where("rank <= _top")
    return ranked.select(
        "task_id", *keys, "rank", "chunk_id", "path", "start_line", "end_line", "symbol", "score", "bm25", "matched", "graph_source", "priority"
    )


def reasons_col() -> Column:
    """Why each row of ``rank_tasks`` ranks where it does, in the order of the steps; as ``reasons_of`` for one."""
    base = F.element_at(F.split("graph_source", "/"), -1)
    demoted = F.concat(F.lit("demoted:"), F.format_string("%s", F.col("priority")))
    return F.concat(
        F.array(F.concat(F.lit("bm25:"), F.format_string("%.1f", F.col("bm25")))),
        F.transform("matched", lambda m: F.concat(F.lit("symbol:"), m)),
        F.when(F.col("graph_source").isNotNull(), F.array(F.concat(F.lit("graph:"), base))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("priority") != 1.0, F.array(demoted)).otherwise(F.array().cast("array<string>")),
    )


class Result(NamedTuple):
    """One ranked location."""

    file: str
    start_line: int
    end_line: int
    symbol: str | None
    score: float
    reasons: list[str]


def fixed(value: float, places: int) -> str:
    """The exact value of a double, rounded half up."""
    return str(Decimal(value).quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP))


def number(value: float) -> str:
    return str(int(value)) if value == int(value) else repr(value)


def reasons_of(row: object) -> list[str]:
    """Why a row ranks where it does, in the order of the steps."""
    out = [f"bm25:{fixed(row["bm25"], 1)}", *(f"symbol:{m}" for m in row["matched"])]
    if row["graph_source"] is not None:
        out.append(f"graph:{row["graph_source"].rpartition("/")[2]}")
    if row["priority"] != 1.0:
        out.append(f"demoted:{number(row["priority"])}")
    return out


def rank(index: Index, task: str, *, top: int = DEFAULT_TOP, include_tests: bool = False) -> list[Result]:
    """The best chunks of a single corpus for one free-text task."""
    check_top(top)
    spark = index.chunks.sparkSession
    tasks = spark.range(1).select(F.lit(0).alias("task_id"), F.lit(task).alias("task"))
    rows = rank_tasks(index, tasks, top=top, include_tests=include_tests).orderBy("rank").collect()
    return [Result(r["path"], r["start_line"], r["end_line"], r["symbol"], r["score"], reasons_of(r)) for r in rows]


__all__ = ["Result", "basename", "check_top", "graph_sources", "rank", "rank_tasks", "reasons_col", "reasons_of", "score_chunks", "symbol_matches"]

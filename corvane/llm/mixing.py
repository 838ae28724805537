"""Mixing sources to target weights.

A low-discrepancy schedule decides the order of sources: slot i of S takes the
point frac(i · φ) of the golden-ratio (Weyl) sequence, computed exactly in
integers, and the cumulative weights map the point to a source, so every prefix
of the mix is close to the weights.  Slots are ranked per source and joined to
the source's shuffled blocks of equal token size; a source is read again from
its first block when its blocks are used up, at most ``max_repeat`` times.  A source
whose slots outrun its blocks is short: it can't reach its weight.

There are ``SLOTS`` slots, or more where a block would exceed ``BLOCK_TOKENS``.
Sizes are sums of the project's token estimate.  Ranks of slots and prefix sums of
documents come in two levels (spans of slots, hash buckets of documents), the
number of which grows with the data, so no task holds a whole source.

Defined results: documents with null text, or of a source without a target,
take no part; a target without documents gives nothing and is reported with size
0; a null weight or repeat cap counts as 0 and 1; empty texts have size 0 and
travel with their block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.durable import staged
from corvane.functions.textops import token_estimate

#: Slots at least, and tokens of a block at most.
SLOTS, BLOCK_TOKENS = 10_000, 1 << 20
#: Slots ranked in one window, and documents of a bucket if they spread evenly; buckets at least.
SPAN, BUCKET_DOCUMENTS, BUCKETS = 1 << 16, 1 << 18, 256
#: The golden ratio as a fraction of 2**32, rounded to an odd number.
GOLDEN = 2_654_435_769


def _targets(targets: DataFrame) -> DataFrame:
    return targets.where("source is not null").groupBy("source").agg(
        F.coalesce(F.max("weight"), F.lit(0.0)).alias("weight"), F.coalesce(F.max("max_repeat"), F.lit(1)).alias("max_repeat")
    )


def source_plan(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """What each source can give: its documents and size, its quota of the total, its capacity with repeats, and whether that falls short."""
    return _planned(documents.where("text is not null").select("source", token_estimate(F.col("text")).cast("long").alias("tokens")), targets)


def _planned(sized: DataFrame, targets: DataFrame) -> DataFrame:
    sizes = sized.where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("size"))
    s = _targets(targets).join(sizes, "source", "left").na.fill(0, ["documents", "size"])
    s = s.withColumn("total", F.sum("size").over(W.partitionBy()))  # a row for each source
    return s.select(
        "*",
        (F.col("weight") * F.col("total")).alias("quota"),
        (F.col("size") * F.col("max_repeat")).alias("capacity"),
        (F.col("size") * F.col("max_repeat") < F.col("weight") * F.col("total")).alias("short"),
    )


def slots_of(total: int, least: int = SLOTS) -> int:
    """Slots of a mix from sources of ``total`` tokens."""
    return max(least, -(-total // BLOCK_TOKENS))


def schedule(plan: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(slot, source, rank): the slots of the mix and the rank of each within its source.

    The targets, one row a source, are read to the driver to make the cumulative bands an expression.
    """
    targets = plan.select("source", "weight").where("weight > 0").orderBy("source").collect()
    total = sum(r["weight"] for r in targets) or 1.0
    point = (F.col("slot") * F.lit(GOLDEN)).bitwiseAND(F.lit((1 << 32) - 1)) / F.lit(float(1 << 32))
    source, high = F.lit(targets[-1]["source"] if targets else None), total
    for r in reversed(targets):  # the first band whose upper end lies above the point
        source = F.when(F.col("point") < F.lit(high / total), F.lit(r["source"])).otherwise(source)
        high -= r["weight"]
    placed = plan.sparkSession.range(slots if targets else 0).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("source", source)
    placed = placed.select("slot", "source", F.shiftright("slot", SPAN.bit_length() - 1).alias("_span"))
    counts = placed.groupBy("source", "_span").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("source", "_span", (F.sum("_n").over(W.partitionBy("source").orderBy("_span").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    within = F.row_number().over(W.partitionBy("source", "_span").orderBy("slot")) - 1
    return placed.withColumn("_within", within).join(before, ["source", "_span"]).select("slot", "source", (F.col("_before") + F.col("_within")).alias("rank"))


def block_counts(plan: DataFrame, slots: int) -> DataFrame:
    """``plan`` with ``block``, the tokens of a block, and ``blocks``, how many a source fills, the last one possibly in part."""
    size = F.greatest(F.col("total") / slots, F.lit(1.0))
    return plan.withColumn("block", size).withColumn("blocks", F.greatest(F.ceil(F.col("size") / size), F.lit(1)))


def short_sources(documents: DataFrame, targets: DataFrame, *, slots: int = SLOTS) -> DataFrame:
    """(source, slots, blocks, max_repeat, size, quota): the sources whose slots of the schedule outrun their blocks with all repeats.

    Whole blocks and slots are coarser than tokens, so a source within a block a repeat and the discrepancy of the
    schedule is decided by the exact sizes: size times max_repeat below weight times the total.
    """
    plan = staged(source_plan(documents, targets), "mix-plan")  # a row for each source, read for the schedule and for the blocks
    n = slots_of(_total(plan), slots)
    asked = schedule(plan, n).groupBy("source").agg(F.count(F.lit(1)).alias("slots"))
    # The schedule shares its slots by weights scaled to 1.
    scale = F.sum(F.when(F.col("weight") > 0, F.col("weight"))).over(W.partitionBy())
    placed = block_counts(plan, n).withColumn("_scale", scale).join(asked, "source", "left").na.fill(0, ["slots"])
    outrun = (F.col("slots") + discrepancy(n)) * F.col("_scale") + F.col("max_repeat") > F.col("blocks") * F.col("max_repeat")
    return placed.where(outrun & F.col("short")).select("source", "slots", "blocks", "max_repeat", "size", "quota")


def discrepancy(slots: int) -> float:
    """Bound of how far a source's slots are from its share of ``slots``: logarithmic for the golden ratio, here taken with room."""
    return 2 + math.log2(max(2, slots))


def _total(plan: DataFrame) -> int:
    row = plan.agg(F.max("total")).first()
    return int(row[0] or 0)


def _shuffled(key: Column) -> Column:
    """A number from 0 to 2**60 - 1 that orders documents at random."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("7:"), key.cast("string"))), 1, 15), 16, 10).cast("long")


def token_blocks(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, block): the shuffled documents of each source in blocks of about equal tokens.

    ``sized`` holds (doc_id, source, tokens), ``plan`` the documents and the tokens of a block of each source.
    """
    per = plan.select("source", F.col("block").alias("_size"), F.greatest(F.lit(BUCKETS), F.ceil(F.col("documents") / BUCKET_DOCUMENTS)).alias("_buckets"))
    docs = sized.join(per, "source").withColumn("_h", _shuffled(F.col("doc_id"))).withColumn("_b", F.pmod("_h", F.col("_buckets")))
    before = docs.groupBy("source", "_b").agg(F.sum("tokens").alias("_t"))
    before = before.select(
        "source", "_b", (F.sum("_t").over(W.partitionBy("source").orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_t")).alias("_before")
    )
    inner = W.partitionBy("source", "_b").orderBy("_h", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    return (
        docs.withColumn("_within", F.sum("tokens").over(inner) - F.col("tokens"))
        .join(before, ["source", "_b"])
        .select("doc_id", "source", "tokens", F.floor((F.col("_before") + F.col("_within")) / F.col("_size")).cast("long").alias("block"))
    )


def sized_documents(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, source, tokens) of the documents of target sources: the texts are read once, for their sizes."""
    tokens = token_estimate(F.col("text")).cast("long").alias("tokens")
    return documents.where("text is not null and source is not null").select("doc_id", "source", tokens).join(_targets(targets).select("source"), "source")


def mixed_documents(documents: DataFrame, targets: DataFrame, *, slots: int = SLOTS) -> DataFrame:
    """(slot, doc_id, source, copy, tokens): the mix, each row one use of a document; order by slot for the schedule."""
    sized = staged(sized_documents(documents, targets), "mix-sizes")
    return _mix(sized, staged(_planned(sized, targets), "mix-plan"), slots)


def _mix(sized: DataFrame, plan: DataFrame, slots: int) -> DataFrame:
    n = slots_of(_total(plan), slots)
    plan = block_counts(plan, n)
    blocks = token_blocks(sized.where("doc_id is not null"), plan)
    uses = (
        schedule(plan, n)
        .join(plan.select("source", "max_repeat", "blocks"), "source")
        .select("slot", "source", "max_repeat", F.floor(F.col("rank") / F.col("blocks")).cast("int").alias("copy"), F.pmod("rank", "blocks").cast("long").alias("block"))
        .where("copy < max_repeat")
    )
    return blocks.join(uses, ["source", "block"]).select("slot", "doc_id", "source", "copy", "tokens")


def reached_shares(documents: DataFrame, targets: DataFrame, *, slots: int = SLOTS) -> DataFrame:
    """(source, weight, size, max_repeat, short, mixed_documents, mixed_tokens, share): the mix that comes out."""
    sized = staged(sized_documents(documents, targets), "mix-sizes")
    plan = staged(_planned(sized, targets), "mix-plan")
    mix = _mix(sized, plan, slots).groupBy("source").agg(F.count(F.lit(1)).alias("mixed_documents"), F.sum("tokens").alias("mixed_tokens"))
    out = plan.join(mix, "source", "left").na.fill(0, ["mixed_documents", "mixed_tokens"])
    share = F.try_divide(F.col("mixed_tokens"), F.sum("mixed_tokens").over(W.partitionBy()))
    return out.select("source", "weight", "size", "max_repeat", "short", "mixed_documents", "mixed_tokens", F.coalesce(share, F.lit(0.0)).alias("share"))

"""How distinctive a term is for a record: a two-Poisson mixture for each term.

A term's occurrence counts over *all* records are taken as a mixture of two
Poisson distributions: a background rate for records that mention it in passing
and an elite rate for records that are about it.  The mixture is fitted by
expectation-maximisation on the term's frequency histogram (how many records
hold it 0, 1, 2, … times), and the posterior probability of the elite part
scores each occurrence count.

One pass over the texts gives both the histograms, added up in the worker before
anything is shuffled, and the record rows asked for.  The histograms are then added
up by term and count, so a term of every record is spread over its counts, and only
the finished ones are gathered by term.  Terms share few distinct histograms, so a
batch fits each of them once.

Defined results: null text is no record; an empty text is a record without
terms; rows with the same record id and different texts count as the record with
the smallest text; a term of every record has no background and scores 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.durable import staged
from corvane.functions.textops import tokenize
from corvane.llm.records import distinct_records

#: Distinct (term, count) pairs that a worker gathers before it hands them on.
GATHERED = 400_000
EM_STEPS = 60
RATE_FLOOR = 1e-9
#: Terms that a broadcast may hold: the terms of the rows asked for, where those are few.
BROADCAST_TERMS = 500_000
#: Spark types of record ids, and how a batch holds them.
ID_TYPES = {"bigint": pa.int64(), "string": pa.string()}


def _pass(min_count: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: Counter = Counter()
        seen = 0

        def flush() -> pa.RecordBatch:
            keys = list(gathered)
            batch = pa.record_batch(
                [
                    pa.array([k[0] for k in keys], pa.string()),
                    pa.array([k[1] for k in keys], pa.int32()),
                    pa.array(list(gathered.values()), pa.int64()),
                    pa.nulls(len(keys), id_type),
                ],
                names=["term", "tf", "n", "record_id"],
            )
            gathered.clear()
            return batch

        for batch in batches:
            terms: list[str] = []
            counts: list[int] = []
            ids: list = []
            for record, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tf = Counter(tokenize(text))
                gathered.update(tf.items())
                seen += 1
                for term, c in tf.items():
                    if c >= min_count:
                        terms.append(term)
                        counts.append(c)
                        ids.append(record)
            yield pa.record_batch(
                [pa.array(terms, pa.string()), pa.array(counts, pa.int32()), pa.nulls(len(ids), pa.int64()), pa.array(ids, id_type)],
                names=["term", "tf", "n", "record_id"],
            )
            if len(gathered) > GATHERED:
                yield flush()
        gathered[(None, 0)] = seen  # the row without a term holds the number of records
        yield flush()

    return run


def fit_two_poisson(tf: np.ndarray, n: np.ndarray, total: int, steps: int = EM_STEPS) -> tuple[float, float, float]:
    """(share of elite records, elite rate, background rate) of one histogram.

    ``n[i]`` records hold the term ``tf[i]`` times; the rest of ``total`` hold it never.
    """
    x = np.concatenate([[0.0], tf.astype(float)])
    w = np.concatenate([[max(0.0, total - n.sum())], n.astype(float)])
    held = w[1:].sum()
    mean = (w * x).sum() / max(total, 1)
    elite_rate = max((w[1:] * x[1:]).sum() / held, 2 * mean, 1.0)
    rest_rate = max(mean / 2, RATE_FLOOR)
    share = min(max(held / total, 1e-12), 0.5)
    for _ in range(steps):
        z = np.log(share) - np.log1p(-share) + x * (np.log(elite_rate) - np.log(rest_rate)) - (elite_rate - rest_rate)
        p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        mass, left = (w * p).sum(), (w * (1 - p)).sum()
        if mass <= 0 or left <= 0:
            break
        new = ((w * p * x).sum() / mass, max((w * (1 - p) * x).sum() / left, RATE_FLOOR), min(max(mass / w.sum(), 1e-12), 1 - 1e-12))
        done = abs(new[0] - elite_rate) < 1e-7 * elite_rate and abs(new[1] - rest_rate) < 1e-7 * max(rest_rate, 1e-6)
        elite_rate, rest_rate, share = max(new[0], RATE_FLOOR), new[1], new[2]
        if done:
            break
    return share, elite_rate, rest_rate


def _fit(total: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, tuple[float, float, float]] = {}
        for pdf in frames:
            rows = []
            for hist in pdf["hist"]:
                key = tuple((h["tf"], h["n"]) for h in hist)
                if key not in known:
                    if len(known) > 200_000:
                        known.clear()
                    known[key] = fit_two_poisson(np.array([k[0] for k in key]), np.array([k[1] for k in key]), total)
                rows.append(known[key])
            fitted = pd.DataFrame(rows, columns=["share", "elite_rate", "rest_rate"], index=pdf.index)
            yield pd.concat([pdf[["term", "df", "cf"]], fitted], axis=1)

    return run


def _posterior(share: Column, elite: Column, rest: Column, tf: Column) -> Column:
    z = F.log(share) - F.log(1 - share) + tf * (F.log(elite) - F.log(rest)) - (elite - rest)
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-700.0)), F.lit(700.0))))


def distinctive_terms(
    df: DataFrame, id_col: str, text_col: str, *, min_count: int = 1, min_df: int = 1, max_df: int | None = None, min_elite: float = 0.0
) -> DataFrame:
    """(record_id, term, tf, df, elite, score) for the terms of each record.

    ``elite`` is the posterior probability that the record is one of the term's elite; ``score`` weighs it by
    the bits that eliteness is worth, -log2 of the share of elite records, so a term the collection is full of stays
    low.  ``min_elite`` keeps the rows of at least that posterior; ``min_count`` leaves out rows with fewer occurrences
    and ``min_df``/``max_df`` rows of rarer or commoner terms.  The fit itself always sees every record.
    """
    unique = distinct_records(df, id_col, text_col)
    id_type = unique.dtypes[0][1]
    seen = staged(unique.mapInArrow(_pass(min_count, ID_TYPES[id_type]), f"term string, tf int, n long, record_id {id_type}"), "term-counts")
    rows = seen.where("record_id is not null").select("record_id", "term", "tf")
    counts = seen.where("record_id is null")
    total = int(counts.where("term is null").agg(F.sum("n")).first()[0] or 0)
    counts = counts.where("term is not null")
    if min_count > 1:  # then only the terms of some rows need a fit
        asked = staged(rows.select("term").distinct(), "asked-terms")
        if asked.count() <= BROADCAST_TERMS:
            counts = counts.join(F.broadcast(asked), "term", "left_semi")
    hist = (
        counts.groupBy("term", "tf")
        .agg(F.sum("n").alias("n"))
        .groupBy("term")
        .agg(F.sort_array(F.collect_list(F.struct("tf", "n"))).alias("hist"), F.sum("n").alias("df"), F.sum(F.col("tf") * F.col("n")).alias("cf"))
        .where(F.col("df") >= min_df)
    )
    if max_df is not None:
        hist = hist.where(F.col("df") <= max_df)
    fitted = hist.mapInPandas(_fit(total), "term string, df long, cf long, share double, elite_rate double, rest_rate double")
    elite = F.when(F.col("df") >= F.lit(total), F.lit(0.0)).otherwise(_posterior(F.col("share"), F.col("elite_rate"), F.col("rest_rate"), F.col("tf")))
    return (
        rows.join(fitted, "term")
        .withColumn("elite", elite)
        .where(F.col("elite") >= min_elite)
        .select("record_id", "term", "tf", "df", "elite", (F.col("elite") * -F.log2("share")).alias("score"))
    )

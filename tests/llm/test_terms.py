"""Distinctive terms and term frequencies against brute force."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.functions.textops import tokenize
from corvane.llm import term_frequency
from corvane.llm.queries import QUERIES
from corvane.llm.records import distinct_records, distinct_texts
from corvane.llm.term_frequency import PARTIAL, radix_sums, term_frequencies
from corvane.llm.term_weights import distinctive_terms, fit_two_poisson

ROWS = [
    (1, "alpha alpha alpha alpha beta common", 7), (1, "alpha alpha alpha alpha beta common", 7), (2, "alpha beta common common", 8), (3, "common gamma " * 400, 9),
    (4, "", 1), (5, None, 2), (None, "lost common", 3), (6, "common Déjà vu", 4), (7, "common", 5),
]
SCHEMA = "cand_id long, code string, term int"


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def brute():
    return {i: Counter(tokenize(c)) for i, c, _ in ROWS if i is not None and c is not None}


def test_counts_and_order(table):
    got = {(r.record_id, r.term): r for r in distinctive_terms(table, "cand_id", "code").collect()}
    want = brute()
    df = Counter(t for v in want.values() for t in v)
    assert {k: r.tf for k, r in got.items()} == {(i, t): n for i, v in want.items() for t, n in v.items()}
    assert all(r.df == df[t] and 0 <= r.elite <= 1 and r.score >= 0 for (_, t), r in got.items())
    assert got[(1, "alpha")].score > got[(2, "alpha")].score
    assert got[(1, "alpha")].score > got[(1, "common")].score
    assert got[(3, "gamma")].elite > 0.99


def test_limits_leave_the_fit_alone(table):
    full = {(r.record_id, r.term): r.score for r in distinctive_terms(table, "cand_id", "code").collect()}
    some = {(r.record_id, r.term): r.score for r in distinctive_terms(table, "cand_id", "code", min_count=4, min_df=2, max_df=2).collect()}
    assert some == {(1, "alpha"): full[(1, "alpha")]}


def test_fit_recovers_a_mixture():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.poisson(0.2, 9000), rng.poisson(6, 1000)])
    tf, n = np.unique(x[x > 0], return_counts=True)
    share, elite, rest = fit_two_poisson(tf, n, len(x))
    assert abs(share - 0.1) < 0.01 and abs(elite - 6) < 0.2 and abs(rest - 0.2) < 0.02


def test_fit_is_a_likelihood_maximum():
    tf, n, total = np.array([1, 2, 5, 6]), np.array([30, 6, 4, 3]), 500

    def loglik(share, a, b):
        x, w = np.concatenate([[0], tf]), np.concatenate([[total - n.sum()], n])
        p = share * np.exp(-a) * a**x + (1 - share) * np.exp(-b) * b**x
        return (w * np.log(p / np.array([math.factorial(k) for k in x]))).sum()

    best = fit_two_poisson(tf, n, total, 2000)
    base = loglik(*best)
    for k in range(3):
        for f in (0.97, 1.03):
            moved = [v * (f if i == k else 1) for i, v in enumerate(best)]
            assert loglik(*moved) <= base + 1e-6


def test_no_records(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert distinctive_terms(empty, "cand_id", "code").count() == 0
    assert term_frequencies(empty, "code", id_col="cand_id").count() == 0


def test_frequencies(table):
    got = {r.term: (r.occurrences, r.records, r.verdict) for r in term_frequencies(table, "code", id_col="cand_id", common_share=0.5).collect()}
    want = brute()
    total = Counter()
    df = Counter()
    for v in want.values():
        total.update(v)
        df.update(v.keys())
    n = len(want)
    assert got == {t: (total[t], df[t], "rare" if df[t] <= 1 else "common" if df[t] > 0.5 * n else None) for t in total}


def test_frequencies_of_lists(spark):
    df = spark.createDataFrame([(["a", "a", None],), ([],), (None,), (["b", "a"],)], "names array<string>")
    got = {r.term: (r.occurrences, r.records, r.verdict) for r in term_frequencies(df, "names").collect()}
    assert got == {"a": (3, 2, "common"), "b": (1, 1, "rare")}


def test_radix_splits_large_partitions(spark, monkeypatch):
    """A small bound splits partitions through several levels; a term of a third of the rows comes out whole."""
    levels = []
    monkeypatch.setattr(term_frequency, "SPLIT_BITS", 1)
    real = term_frequency._level
    monkeypatch.setattr(term_frequency, "_level", lambda *a: levels.append(a[1:4]) or real(*a))
    rows = [(f"t{i % 700}", 1, 1) for i in range(4000)] + [("hot", 2, 1)] * 2000 + [(None, 0, 5)] * 3
    sums, total = radix_sums(spark.createDataFrame(rows, PARTIAL).repartition(3), 20_000)
    got = sums.collect()
    want: Counter = Counter()
    for t, o, _ in rows[:-3]:
        want[t] += o
    assert len(got) == len({r.term for r in got}) == 701 and total == 15
    assert {r.term: r.occurrences for r in got} == dict(want)
    assert len(levels) > 2 and [k[1] for k in levels] == sorted({k[1] for k in levels})


def test_one_aggregation_streams_its_batches():
    rows = [(f"t{i % 70}", 1, 2) for i in range(600)]
    batches = pa.Table.from_pylist([dict(zip(("term", "occurrences", "records"), r)) for r in rows], schema=term_frequency.SCHEMA).to_batches(max_chunksize=21)
    out = [t for b in term_frequency._aggregate(iter(batches)) for t in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(out) == sorted((t, n, 2 * n) for t, n in Counter(r[0] for r in rows).items())


def test_repeated_ids(spark, monkeypatch):
    """Repeated rows count once with their smallest text, whether the repeated ids are broadcast or not."""
    rows = [(1, "b"), (1, "a"), (1, None), (2, None), (2, "c"), (3, None), (None, "d"), (4, ""), (5, "e"), (5, "e")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id long, text string, value int")
    want = {(1, "a"), (2, "c"), (4, ""), (5, "e")}
    for bound in (1_000_000, 0):
        monkeypatch.setattr("corvane.llm.records.BROADCAST_IDS", bound)
        assert [tuple(r) for r in distinct_records(df, "id", "text").orderBy("record_id").collect()] == sorted(want)


def test_repeated_texts(spark, monkeypatch):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("",), ("b",), ("a",)], "value string")
    for bound in (1_000_000, 0):
        monkeypatch.setattr("corvane.llm.records.BROADCAST_IDS", bound)
        assert sorted(r.text for r in distinct_texts(df, "value").collect()) == ["", "a", "b"]


def test_found_terms_depend_on_the_fit(spark, monkeypatch, tmp_path):
    """Without elite records in the mixtures there is nothing to find: the rows come through the posterior."""
    rows = [(i, f"word{i} filler text") for i in range(300)] + [(1001, "zeta " * 5), (1002, "zeta " * 4), (1003, "zeta once")]
    spark.createDataFrame(rows, "cand_id long, code string").write.parquet(f"{tmp_path}/candidate.parquet")
    assert {tuple(r) for r in QUERIES["p1_found"](spark, str(tmp_path)).collect()} == {(1001, "zeta"), (1002, "zeta")}
    monkeypatch.setattr("corvane.llm.term_weights._posterior", lambda *a: F.lit(0.1))
    assert QUERIES["p1_found"](spark, str(tmp_path)).count() == 0


def test_string_ids(spark):
    df = spark.createDataFrame([("getUser", "getUser"), ("getUser", "getUser"), ("setUserName", "setUserName"), (None, "x")], "name string, symbol string")
    got = {(r.record_id, r.term) for r in distinctive_terms(df, "name", "symbol").collect()}
    assert got == {("getUser", t) for t in ("getuser", "get", "user")} | {("setUserName", t) for t in ("setusername", "set", "user", "name")}

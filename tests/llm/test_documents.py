"""Leaked test items, mixing of sources and truncated texts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.functions.textops import estimate_tokens
from corvane.llm import leaks, mixing
from corvane.llm.leaks import WuManber, leaked_items, rendered_words
from corvane.llm.mixing import mixed_documents, reached_shares, schedule, short_sources, slots_of, source_plan
from corvane.llm.queries import QUERIES
from corvane.llm.truncation import judged_texts, truncation_rates

ITEM = "In 1844 the narrow harbour of Velim joined seven late mills and a chapel near the old road to Brask."
PASSAGES = {
    "plain": (ITEM, True),
    "markup": ("x In 1844 [[the]] '''narrow''' [[Harbour (place)|harbour]] of&nbsp;Velim<ref>A, b 3</ref> joined<ref name=\"k\" /> se­ven<br />late ​mills, {{nowrap|and}} a CHAPEL near.", True),
    "comment": ("<!-- " + ITEM[3:80] + " -->", True),
    "value": ("{{Infobox | note = " + ITEM + " | x = 1}}", True),
    "broken bold": ("In 1844 the ''nar''row harbour of Velim joined seven late mills and a", True),
    "eleven": (" ".join(ITEM.split()[:11]) + " x " + " ".join(ITEM.split()[12:]), False),
    "twelve": (" ".join(ITEM.split()[:12]), True),
    "other word": (ITEM.replace("Velim", "Velum").replace("chapel", "church"), False),
    "reference": ("<ref>" + ITEM + "</ref>", False),
    "empty": ("", False),
    "null": (None, False),
    "deep templates": ("{{a|" * 9 + " ".join(ITEM.split()[:5]) + "}}" * 9 + " " + " ".join(ITEM.split()[5:13]), True),
    "a word in six templates": (ITEM.replace("Velim", "{{a|" * 6 + "Velim" + "}}" * 6), True),
    "deep links": (ITEM.replace("Velim", "[[b|" * 7 + "Velim" + "]]" * 7), True),
    "long": ("filler words here " * 60_000 + ITEM, True),
}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t, 5) for i, (t, _) in enumerate(PASSAGES.values())] + [(None, ITEM, 5)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, ITEM, 1), (8, "stock " + ITEM, 1), (9, "too short to leak", 1), (10, None, 1), (7, ITEM, 1)], "item_id long, text string, doc_id int")
    return {(r.doc_id, r.item_id): r.windows for r in leaked_items(docs, items).collect()}


@pytest.mark.parametrize("name", list(PASSAGES))
def test_passages(found, name):
    i = list(PASSAGES).index(name)
    assert {k for k in found if k[0] == i} == ({(i, 7), (i, 8)} if PASSAGES[name][1] else set())


def test_search_finds_what_comparison_finds():
    r = random.Random(4)
    words = ["a", "b", "c", "d"]
    for _ in range(60):
        items = [(k, " ".join(r.choices(words, k=r.randint(3, 16)))) for k in range(3)]
        text = r.choices(words, k=200)
        table = WuManber(items, 5, 2)
        want = Counter()
        for k, t in items:
            w = t.split()
            windows = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
            want[k] += sum(tuple(text[i : i + 5]) in windows for i in range(len(text) - 4))
        assert table.search(text) == {k: n for k, n in want.items() if n}


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leaks, "PASS_CHARS", 40)
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(k, ITEM) for k in range(5)], "item_id long, text string")
    assert sorted(r.item_id for r in leaked_items(docs, items).collect()) == [0, 1, 2, 3, 4]
    assert leaked_items(docs, items.where("false")).count() == 0 == leaked_items(docs.where("false"), items).count()


def test_rendered_words():
    assert rendered_words("[[File:X.jpg|thumb|A [[b|c]] d]] {{{p|q}}} {{t|k=v|{{u|w}}}} &amp; É") == ["a", "c", "d", "q", "v", "w", "é"]
    assert rendered_words("a [https://b.c/d e f] g") == ["a", "e", "f", "g"]
    assert rendered_words("x" * 100_000 + "[[" * 5000 + "{{" * 5000)[0][:3] == "xxx"


# Mixing --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def mix(spark):
    r = random.Random(2)
    rows = [(i, s, "w" * r.randint(1, 400), 1.0) for i, s in enumerate("a" * 900 + "b" * 300 + "c" * 30)]
    rows += [(5000, "a", None, 1.0), (5001, "a", "", 1.0), (5002, None, "wwww", 1.0), (5003, "zz", "wwww", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, weight double")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.4, 3), ("c", 0.1, 2), ("none", 0.1, 5)], "source string, weight double, max_repeat int")
    return rows, docs, targets


def test_plan(mix):
    rows, docs, targets = mix
    size = Counter()
    for _, s, t, _ in rows:
        if t is not None and s in ("a", "b", "c"):
            size[s] += estimate_tokens(t)
    got = {r.source: r for r in source_plan(docs, targets).collect()}
    total = sum(size.values())
    assert {s: r["size"] for s, r in got.items()} == {"a": size["a"], "b": size["b"], "c": size["c"], "none": 0}
    assert {s for s, r in got.items() if r.short} == {s for s, w, m in (("a", 0.4, 1), ("b", 0.4, 3), ("c", 0.1, 2), ("none", 0.1, 5)) if size[s] * m < w * total}


def test_mix_keeps_caps_and_weights(mix):
    rows, docs, targets = mix
    out = mixed_documents(docs, targets, slots=500).collect()
    uses = Counter(r.doc_id for r in out)
    source = {i: s for i, s, _, _ in rows}
    cap = {"a": 1, "b": 3, "c": 2}
    assert all(n <= cap[source[i]] for i, n in uses.items()) and len({(r.doc_id, r["copy"]) for r in out}) == len(out)
    shares = {r.source: r for r in reached_shares(docs, targets, slots=500).collect()}
    total = sum(estimate_tokens(t) for _, s, t, _ in rows if t is not None and s in ("a", "b", "c"))
    for s, w in (("a", 0.4), ("b", 0.4)):
        assert abs(shares[s].mixed_tokens - w * total) < 0.03 * total
    assert shares["c"].short and shares["c"].mixed_tokens == 2 * shares["c"]["size"] and shares["none"].mixed_tokens == 0
    assert abs(sum(r.share for r in shares.values()) - 1) < 1e-9


def test_every_prefix_of_the_schedule_is_near_the_weights(mix):
    _, docs, targets = mix
    rows = schedule(source_plan(docs, targets), 2000).orderBy("slot").collect()
    count = Counter()
    weight = {"a": 0.4, "b": 0.4, "c": 0.1, "none": 0.1}
    for n, r in enumerate(rows, 1):
        assert r["rank"] == count[r.source]
        count[r.source] += 1
        assert all(abs(count[s] - w * n) < min(5, mixing.discrepancy(n)) for s, w in weight.items())


def test_short_sources_come_from_the_schedule(spark, mix, monkeypatch):
    """They equal the exact comparison of sizes for weights and caps near the edge, and none comes without slots."""
    rows, docs, targets = mix
    size = {r.source: r["size"] for r in source_plan(docs, targets).collect()}
    total = sum(size.values())
    for scale in (0.98, 0.9999, 1.0, 1.0001, 1.02, 1.5):
        t = spark.createDataFrame([(s, scale * m * size[s] / total, m) for s, m in (("a", 1), ("b", 3), ("c", 2))] + [("none", 0.01, 5)], "source string, weight double, max_repeat int")
        want = {r.source for r in source_plan(docs, t).where("short").collect()}
        for slots in (50, 500):
            assert {r.source for r in short_sources(docs, t, slots=slots).collect()} == want
    real = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda plan, n: real(plan, n).withColumn("source", F.lit("b")))
    assert "c" not in {r.source for r in short_sources(docs, targets).collect()}


def test_ranks_and_buckets_in_many_spans(mix, monkeypatch):
    _, docs, targets = mix
    want = {tuple(r) for r in mixed_documents(docs, targets, slots=500).collect()}
    monkeypatch.setattr(mixing, "SPAN", 64)
    assert {tuple(r) for r in mixed_documents(docs, targets, slots=500).collect()} == want
    assert slots_of(100) == 10_000 and slots_of(10**15) * (1 << 20) >= 10**15


def test_nothing_to_mix(mix):
    _, docs, targets = mix
    assert mixed_documents(docs, targets.where("false")).count() == 0
    assert {r.share for r in reached_shares(docs.where("false"), targets).collect()} == {0.0}


def test_the_mix_is_a_query(spark):
    d = "/root/testdata/sf0.001"
    shares = {r.source: r for r in QUERIES["p7_shares"](spark, d).collect()}
    mixed = QUERIES["p7_mixed"](spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()
    assert mixed and {(r.source, r.n, r.t) for r in mixed} == {(s, r.mixed_documents, r.mixed_tokens) for s, r in shares.items() if r.mixed_documents}
    assert {r.source for r in QUERIES["p7_found"](spark, d).collect()} == {s for s, r in shares.items() if r.short}


# Truncation ----------------------------------------------------------------------------------------------------------

WORDS = ["harbour", "station", "council", "market", "garden", "bridge"]


def article(r, n):
    return " ".join(f"The {r.choice(WORDS)} of {r.choice(WORDS).title()} joined a {r.choice(WORDS)} near {r.choice(WORDS).title()} in {r.randint(1000, 2000)}." for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(9)
    rows, cut = [], set()
    for i in range(900):
        t = article(r, r.randint(3, 60))
        kind = i % 3
        if kind == 0:
            t += r.choice(["", "\n\n[[Category:Old mills]]", "\n\n{{mill-stub}}", "\n\n== See also ==\n* [[Brask]]\n* [[Velim]]", "\n\n{| class=\"wikitable\"\n| a\n|}"])
        source = ["dump", "api", "mirror"][kind]
        if source == "api" and len(t) > 1500:
            t, _ = t[:1500], cut.add(i)
        elif source == "mirror" and len(t) > 1200:
            t, _ = t[: t.rfind(" ", 0, 1200)] + r.choice(["", "...", " [more]"]), cut.add(i)
        elif source == "dump" and i % 60 == 0:
            t, _ = t[: r.randint(20, len(t) // 2)].rstrip(". "), cut.add(i)
        rows.append((i, source, t, 3))
    rows += [(2000, "dump", None, 3), (2001, "dump", "", 3), (2002, "dump", "#REDIRECT [[Bra", 3), (2003, None, article(r, 5) + " The harbour of", 3), (2004, "dump", "HELLO WAS HERE!!!", 3), (2005, "dump", article(r, 2) + "<re", 3)]
    return rows, cut | {2003, 2005}


def test_truncation(spark, texts):
    rows, cut = texts
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, chars int")
    judged = judged_texts(docs).collect()
    found = {r.doc_id for r in judged if r.by_limit or r.by_trigram}
    assert not {2000, 2001, 2002} & {r.doc_id for r in judged} and len(judged) == len(rows) - 3
    missed, wrong = cut - found, found - cut
    assert len(missed) <= 0.03 * len(cut) and len(wrong) <= 0.02 * len(cut), (missed, wrong)
    rates = {r.source: r for r in truncation_rates(docs).collect()}
    assert rates[None].rate == 1.0 and rates["api"].documents == 300 and abs(rates["api"].truncated - sum(i % 3 == 1 for i in cut if i < 900)) <= 2


def test_longer_texts_and_second_limits_do_not_hide_a_limit(spark):
    """One uncut text far above the limit of each source, and a lower limit in some rows, change nothing for the others."""
    r = random.Random(8)
    whole = [article(r, r.randint(10, 80)) for _ in range(1500)]
    cut = {i: (t[:3000] if i % 2 else t[:2000]) for i, t in enumerate(whole) if len(t) > 3000}
    rows = [(i, "api", cut.get(i, t)) for i, t in enumerate(whole)]
    longest = [(9000, "api", article(r, 9000)), (9001, "api", article(r, 60))]
    found = []
    for extra in ([], longest):
        judged = judged_texts(spark.createDataFrame(rows + extra, "doc_id long, source string, text string")).collect()
        found.append({x.doc_id for x in judged if x.by_limit})
    assert found[0] == found[1] >= set(cut)
    assert all(len(whole[i]) in (2000, 3000) for i in found[0] - set(cut))  # a whole text of just that length


def test_a_verdict_does_not_depend_on_how_often_the_table_is_repeated(spark):
    r = random.Random(9)
    rows = [(i, "dump", article(r, r.randint(5, 40))) for i in range(400)]
    rows += [(1000 + i, "dump", article(r, 10) + " The " + r.choice(WORDS)[: r.randint(1, 5)]) for i in range(6)]
    want = {x.doc_id for x in judged_texts(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect() if x.by_trigram}
    many = [(10_000 * k + i, s, t) for k in range(4) for i, s, t in rows]
    got = {x.doc_id for x in judged_texts(spark.createDataFrame(many, "doc_id long, source string, text string")).collect() if x.by_trigram}
    assert want == set(range(1000, 1006)) and got == {10_000 * k + i for k in range(4) for i in want}


def test_copies_of_a_cut_text_do_not_clear_it(spark):
    r = random.Random(3)
    rows = [(i, "dump", article(r, r.randint(20, 60))) for i in range(300)]
    cut = article(r, 10) + " The harbour of"
    rows += [(1000 + i, "dump", cut) for i in range(1000)]
    whole = article(r, 61) * 2  # the longest text, kept often, is no limit
    rows += [(3000 + i, "dump", whole) for i in range(50)]
    judged = judged_texts(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert len(judged) == len(rows)
    assert {x.doc_id for x in judged if x.by_trigram} == set(range(1000, 2000)) and not any(x.by_limit for x in judged)


def test_truncation_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert judged_texts(docs).count() == 0 == truncation_rates(docs).count()
    one = spark.createDataFrame([(1, "s", "Just one text")], docs.schema)
    assert [tuple(r) for r in judged_texts(one).select("doc_id", "by_limit", F.col("by_trigram")).collect()] == [(1, False, False)]

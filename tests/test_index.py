"""Symbols, imports, chunks, graph, index, ranks and packs on a small repository, against pinned and brute-force values."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.functions.textops import split_identifier, tokenize
from corvane.operators import bm25
from corvane.operators.budget import check_budget, fit_to_budget
from corvane.operators.chunking import chunk_ranges, max_lines_of, ranges_of
from corvane.operators.graph import build_edges, neighbors
from corvane.operators.imports import extract_imports, imports_of
from corvane.operators.outline import outline_rows
from corvane.operators.ranges import sliced_texts, subtract_covered
from corvane.operators.symbols import extract_symbols, symbols_of
from corvane.plans.index import build_index
from corvane.plans.pack import pack, pack_rows, pack_texts
from corvane.plans.ranking import check_top, fixed, rank, rank_tasks
from corvane.sources.store import export_json, import_json, index_document, load_index, load_texts, save_index

REPO = {
    ".gitignore": "skip/\n",
    "README.md": "# demo\n\nSigning in and a session store: `src/session.js` signs users in,\n`src/store.js` keeps rows.\n",
    "src/session.js": "// session.js: sign in and out\n\nimport { Store } from './store.js';\n\nexport function signIn(user) {\n  return { user, token: 'tok' + user };\n}\n\n"
    "export const signOut = async (token) => {\n  return !token;\n};\n\nexport const TOKEN_TTL = 3600;\n",
    "src/store.js": "export class Store {\n  open() {\n    return true;\n  }\n\n  query(sql) {\n    return [sql];\n  }\n}\n",
    "src/api/routes.js": "import { signIn } from '../session.js';\nimport x from 'express';\n\nexport default function routes(app) {\n  app.post('/sign-in', signIn);\n}\n",
    "src/__tests__/session.test.js": "import { signIn } from '../session';\nsignIn('signIn'); signIn('user'); signIn('x');\n",
    "tools/run.py": "import os\nfrom .helper import go\n\n\ndef run_all(path):\n    return os.listdir(path)\n\n\nclass Runner(object):\n    pass\n",
    "empty.txt": "",
}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(REPO.items()) + [("null.js", None)], "path string, text string").cache()


@pytest.fixture(scope="module")
def index(spark, texts):
    return build_index(texts).cached()


def test_symbols(index):
    got = [(r.path, r.name, r.kind, r.line, r.end_line) for r in index.symbols.orderBy("path", "ord").collect()]
    assert got == [
        ("src/api/routes.js", "routes", "function", 4, 7),
        ("src/session.js", "signIn", "function", 5, 8),
        ("src/session.js", "signOut", "function", 9, 12),
        ("src/session.js", "TOKEN_TTL", "const", 13, 14),
        ("src/store.js", "Store", "class", 1, 1),
        ("src/store.js", "open", "method", 2, 5),
        ("src/store.js", "query", "method", 6, 10),
        ("tools/run.py", "run_all", "def", 5, 8),
        ("tools/run.py", "Runner", "class", 9, 11),
    ]


def test_symbol_kinds(spark):
    cases = [
        ("ts", "export interface Foo {\n}\nexport type Bar = string;\nclass S {\n  look(id: string): Promise<string> {\n", [("Foo", "type"), ("Bar", "type"), ("S", "class"), ("look", "method")]),
        ("js", "module.exports.baz = function () {};\nexport default qux;\nconst id = v => v;\n  if (x) {\n", [("baz", "other"), ("qux", "other"), ("id", "function")]),
        ("go", "func Foo() {\n}\n", [("Foo", "function")]),
        ("rust", "pub fn add(a: i32) {\nstruct P {\n", [("add", "function"), ("P", "other")]),
        ("java", "public class G {\n  public void hello() {}\n}\n", [("G", "class")]),
        ("text", "just prose\n", []),
    ]
    df = spark.createDataFrame([(i, g, t) for i, (g, t, _) in enumerate(cases)], "k int, lang string, text string")
    got = extract_symbols(df, ["k"]).orderBy("k", "ord").collect()
    for i, (_, _, want) in enumerate(cases):
        assert [(r.name, r.kind) for r in got if r.k == i] == want


def test_imports(spark, index):
    assert imports_of("import {\n a\n} from './x.js';\nimport 'y';\nconst z = require('z');\nexport * from './w';\nimport('q');\n", "js") == ["./x.js", "y", "z", "./w", "q"]
    assert imports_of("import os\nfrom collections import x\nfrom . import y\nfrom .models import z\n", "py") == ["os", "collections", ".", ".models"]
    assert imports_of('import "fmt"\nimport java.util.List;\nuse std::fs;\n#include <stdio.h>\n#include "a.h"\nusing System.IO;\nrequire \'set\'\n', "go") == [
        "fmt", "java.util.List", "std::fs", "stdio.h", "a.h", "System.IO", "set",
    ]
    assert imports_of("use Foo\\Bar;\nuse Foo;\nuse Foo;\n", "php") == ["Foo\\Bar", "Foo", "Foo"]
    df = spark.createDataFrame([(1, "js", "import 'a'\nimport 'a'"), (2, "js", None), (3, "py", "")], "k int, lang string, text string")
    assert [(r.k, r.ord, r.specifier) for r in extract_imports(df, ["k"]).collect()] == [(1, 0, "a"), (1, 1, "a")]


def brute_chunks(n, symbols, size):
    out, cursor = [], 1

    def windows(a, b, name):
        out.extend((s, min(s + size - 1, b), name) for s in range(a, b + 1, size))

    clipped = [(s[0], max(1, min(s[1], n)), max(1, min(s[2], n))) for s in symbols]
    for name, a, b in sorted(clipped, key=lambda s: (s[1], s[2], s[0])):
        if a > b or max(a, cursor) > b:
            continue
        windows(cursor, max(a, cursor) - 1, None)
        windows(max(a, cursor), b, name)
        cursor = b + 1
    windows(cursor, n, None)
    return out


def test_chunks(spark):
    rng = random.Random(3)
    files = [(k, rng.randint(1, 40)) for k in range(120)]
    symbols = {k: [(f"s{j}", rng.randint(-2, 45), rng.randint(-2, 45)) for j in range(rng.randint(0, 5))] for k, _ in files}
    f = spark.createDataFrame(files, "k int, lines int")
    s = spark.createDataFrame([(k, *x) for k, v in symbols.items() for x in v], "k int, name string, line int, end_line int")
    got: dict = {}
    for r in chunk_ranges(f, s, ["k"], 7).orderBy("k", "chunk_index").collect():
        got.setdefault(r.k, []).append((r.start_line, r.end_line, r.symbol))
    for k, n in files:
        assert got[k] == brute_chunks(n, symbols[k], 7)
        covered = [x for a, b, _ in got[k] for x in range(a, b + 1)]
        assert covered == list(range(1, n + 1))
    assert [max_lines_of(x) for x in (None, 0, -1, math.nan, 7.9, 60)] == [60, 60, 60, 60, 7, 60]
    assert chunk_ranges(f.where("false"), s.where("false"), ["k"]).count() == 0


def test_chunks_in_one_row_equal_those_of_the_plan():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randint(1, 40)
        symbols = [(f"s{j}", rng.randint(-2, 45), rng.randint(-2, 45)) for j in range(rng.randint(0, 5))]
        assert [(a, b, s) for a, b, s in ranges_of(n, symbols, 7)] == brute_chunks(n, symbols, 7)
    assert ranges_of(4, [("b", 1, 4), ("a", 1, 4)]) == [(1, 4, "b")]  # of equal ranges the first in the source


def test_sliced_texts(spark):
    texts = spark.createDataFrame([(1, "a\nb\nc"), (2, None), (3, "")], "k int, text string")
    ranges = spark.createDataFrame([(1, 1, 2), (1, 1, 2), (1, 0, 9), (1, 3, 1), (2, 1, 1), (3, 1, 1), (4, 1, 1), (1, None, 2)], "k int, start_line int, end_line int")
    got = sorted((r.k, r.start_line, r.end_line, r.text) for r in sliced_texts(ranges, texts, ["k"]).collect())
    assert got == [(1, 0, 9, "a\nb\nc"), (1, 1, 2, "a\nb"), (1, 3, 1, ""), (3, 1, 1, "")]


def test_packs_of_many_tasks_equal_single_ones(spark, index, texts):
    tasks = spark.createDataFrame([(1, "sign in", 8000), (2, "sign in", 60), (3, "open query store", 40), (4, "zzz", 10)], "task_id int, task string, budget int")
    rows = pack_rows(rank_tasks(index, tasks), texts.where("text is not null"), [], 1e18)
    rows = fit_to_budget(rows.drop("used", "included").join(tasks.select("task_id", "budget"), "task_id"), ["task_id"], ["rank", "start_line"], "tokens", F.col("budget"))
    got = {r.task_id: r.text for r in pack_texts(rows, tasks, index.files, []).collect()}
    assert got == {t.task_id: pack(index, texts, t.task, budget=t.budget).text for t in tasks.collect()}


def test_graph(spark, index):
    edges = {(r.src, r.dst) for r in index.edges.collect()}
    assert edges == {("src/session.js", "src/store.js"), ("src/api/routes.js", "src/session.js"), ("src/__tests__/session.test.js", "src/session.js")}
    start = spark.createDataFrame([("src/session.js",), ("nowhere",)], "start string")
    got = {(r.direction, r.path, r.pos) for r in neighbors(index.edges, start, []).collect()}
    assert got == {("imports", "src/store.js", 0), ("imported_by", "src/__tests__/session.test.js", 0), ("imported_by", "src/api/routes.js", 1)}


def test_neighbors_in_cycles_and_diamonds(spark):
    files = spark.createDataFrame([("a.js",), ("b.js",), ("c.js",), ("d.js",), ("e/index.js",)], "path string")
    imports = spark.createDataFrame(
        [("a.js", 0, "./b"), ("a.js", 1, "./c.js"), ("a.js", 2, "./b.js"), ("b.js", 0, "./d"), ("c.js", 0, "./d"), ("d.js", 0, "./a"), ("d.js", 1, "./d"), ("d.js", 2, "./e"), ("d.js", 3, "./none"), ("d.js", 4, "a.js")],
        "path string, ord int, specifier string",
    )
    edges = build_edges(imports, files, [])
    assert sorted((r.src, r.dst, r.out_pos) for r in edges.collect()) == [("a.js", "b.js", 0), ("a.js", "c.js", 1), ("b.js", "d.js", 0), ("c.js", "d.js", 0), ("d.js", "a.js", 0), ("d.js", "e/index.js", 1)]
    start = spark.createDataFrame([("a.js",)], "start string")
    out = [r.path for r in neighbors(edges, start, [], 3).where("direction = 'imports'").orderBy("pos").collect()]
    assert out == ["b.js", "c.js", "d.js", "e/index.js"]
    assert neighbors(edges, start, [], 0).count() == 0


def brute_rank(texts, chunks, edges, task, tests=False):
    docs = {c.chunk_id: "\n".join(texts[c.path].split("\n")[c.start_line - 1 : c.end_line]) for c in chunks}
    tf = {k: Counter(tokenize(t)) for k, t in docs.items()}
    n, avg = len(docs), sum(sum(v.values()) for v in tf.values()) / len(docs)
    df = Counter(t for v in tf.values() for t in v)
    q = tokenize(task)
    score = {}
    for c in chunks:
        s = 0.0
        for t, k in Counter(q).items():
            if tf[c.chunk_id][t]:
                f = tf[c.chunk_id][t]
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                s += idf * ((f * 2.5) / (f + 1.5 * (0.25 + 0.75 * (sum(tf[c.chunk_id].values()) / avg)))) * k
        if s:
            m = [x for x in q if c.symbol and x in split_identifier(c.symbol)]
            score[c.chunk_id] = s + min(1.5 * len(m), 3.0)
    by = {c.chunk_id: c for c in chunks}

    def order():
        return sorted(score, key=lambda k: (-score[k], by[k].path, by[k].start_line))

    near = set()
    for k in order()[:10]:
        near |= {b for a, b in edges if a == by[k].path} | {a for a, b in edges if b == by[k].path}
    for k in score:
        score[k] += 0.5 * (by[k].path in near)
        if not tests and "__tests__" in by[k].path:
            score[k] *= 0.2
    return [(by[k].path, by[k].start_line, round(score[k], 9)) for k in order()]


@pytest.mark.parametrize("task", ["sign in", "signIn token token", "open query store", "zzz", "", "run path OS"])
@pytest.mark.parametrize("tests", [False, True])
def test_rank(index, task, tests):
    chunks = index.chunks.collect()
    edges = {(r.src, r.dst) for r in index.edges.collect()}
    want = brute_rank({k: v for k, v in REPO.items()}, chunks, edges, task, tests)
    got = rank(index, task, include_tests=tests)
    assert [(r.file, r.start_line, round(r.score, 9)) for r in got] == want[:20]
    assert [(r.file, r.start_line) for r in rank(index, task, top=2, include_tests=tests)] == [x[:2] for x in want[:2]]


def test_rank_reasons(index):
    first = rank(index, "signIn signIn")[0]
    assert first.symbol == "signIn" and first.reasons[0].startswith("bm25:") and first.reasons.count("symbol:signin") == 2 and first.reasons[-1].startswith("graph:")
    demoted = [r for r in rank(index, "signIn") if "__tests__" in r.file]
    assert demoted and demoted[0].reasons[-1] == "demoted:0.2"
    assert fixed(0.15, 1) == "0.1" and fixed(2.5, 0) == "3"


@pytest.mark.parametrize("top", [-1, 1.5, math.nan, math.inf, "3"])
def test_bad_top(top):
    with pytest.raises(ValueError, match="top must be a non-negative integer"):
        check_top(top)


def test_top_zero(index):
    assert rank(index, "sign", top=0) == []


def test_rank_many_tasks_and_repos(spark):
    texts = spark.createDataFrame([(r, p, t) for r in ("one", "two") for p, t in REPO.items()], "repo string, path string, text string")
    ix = build_index(texts, ["repo"])
    tasks = spark.createDataFrame([(1, "one", "sign in"), (2, "two", "sign in"), (3, "two", None), (4, "none", "sign in")], "task_id int, repo string, task string")
    rows = rank_tasks(ix, tasks).collect()
    one = [(r.path, r.start_line, round(r.score, 9)) for r in sorted(rows, key=lambda r: r["rank"]) if r.task_id == 1]
    two = [(r.path, r.start_line, round(r.score, 9)) for r in sorted(rows, key=lambda r: r["rank"]) if r.task_id == 2]
    assert one == two and one and {r.task_id for r in rows} == {1, 2}


def test_bm25_empty_corpus(spark):
    docs = spark.createDataFrame([], "chunk_id long, text string")
    forward = bm25.forward_index(docs, [])
    stats = bm25.corpus_stats(forward, []).first()
    assert bm25.postings(forward, []).count() == 0 and (stats.n, stats.avgdl) == (0, 0.0)


def test_pack(index, texts):
    full = pack(index, texts, "sign in", budget=8000)
    ranked = rank(index, "sign in")
    assert {(c.file, c.start_line, c.end_line) for c in full.included} == {(r.file, r.start_line, r.end_line) for r in ranked} and full.trimmed == []
    assert full.text.startswith("# corvane pack: sign in\n\n_") and full.text.endswith("\n")
    sizes = [c.tokens for c in full.included]
    for budget in (0, sizes[0], sum(sizes[:2]), sum(sizes) - 1):
        part = pack(index, texts, "sign in", budget=budget)
        fits, used = 0, 0
        for s in sizes:
            if used + s > budget:
                break
            used, fits = used + s, fits + 1
        assert (len(part.included), part.tokens) == (fits, used)
        assert part.trimmed == list(dict.fromkeys(c.file for c in full.included[fits:]))
    assert "_no chunks fit within budget 0_" in pack(index, texts, "sign in", budget=0).text
    for bad in (-1, math.nan, math.inf, "x"):
        with pytest.raises(ValueError, match="budget must be"):
            check_budget(bad)


def test_fit_to_budget_prefix(spark):
    items = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 1), (2, 1, 0), (2, 2, 10)], "g int, o int, size int")
    got = [(r.g, r.o, r.included) for r in fit_to_budget(items, ["g"], ["o"], "size", 10).orderBy("g", "o").collect()]
    assert got == [(1, 1, True), (1, 2, False), (1, 3, False), (2, 1, True), (2, 2, True)]


def test_subtract_covered(spark):
    rng = random.Random(5)
    ranges = [(k, r, a, a + rng.randint(-1, 9)) for k in range(30) for r, a in enumerate(rng.randint(1, 20) for _ in range(6))]
    got: dict = {}
    for r in subtract_covered(spark.createDataFrame(ranges, "k int, rank int, start_line int, end_line int"), ["k"]).collect():
        got.setdefault((r.k, r["rank"]), set()).update(range(r.start_line, r.end_line + 1))
    for k in range(30):
        seen: set = set()
        for _, rank_, a, b in [x for x in ranges if x[0] == k]:
            new = set(range(a, b + 1)) - seen
            assert got.get((k, rank_), set()) == new
            seen |= set(range(a, b + 1))


def test_outline(index):
    lines = [r.line for r in outline_rows(index.files, index.symbols, []).orderBy("sort_key").collect()]
    assert lines == [
        "src/", "  __tests__/", "    session.test.js", "  api/", "    routes.js (function routes)", "  session.js (function signIn, function signOut, const TOKEN_TTL)",
        "  store.js (class Store, method open, method query)", "tools/", "  run.py (def run_all, class Runner)", ".gitignore", "README.md", "empty.txt",
    ]
    assert [r.line for r in outline_rows(index.files, index.symbols, [], "tools/").orderBy("sort_key").collect()] == ["tools/", "  run.py (def run_all, class Runner)"]


def test_store(spark, tmp_path, index, texts):
    assert load_index(spark, tmp_path) is None
    save_index(tmp_path, index, texts.where("text is not null"))
    save_index(tmp_path, index, texts.where("text is not null"))
    again = load_index(spark, tmp_path)
    save_index(tmp_path, index, texts.where("text is not null"))
    home = tmp_path / ".corvane"
    kept = sorted(p.name for p in home.iterdir() if not p.name.startswith("."))
    assert len(kept) == 3 and kept[0] == "current" and (home / "current").read_text() in kept[1:]  # the index and the one before
    assert rank(again, "sign in") == rank(index, "sign in") and load_texts(spark, tmp_path).count() == len(REPO)
    doc = index_document(again, {"root": str(tmp_path), "createdAt": 0})
    assert json.loads(json.dumps(doc))["chunkCount"] == index.chunks.count() == len(doc["bm25"]["docLen"])
    assert doc["graph"]["out"]["src/session.js"] == ["src/store.js"] and doc["bm25"]["df"]["signin"] == index.terms.where("term = 'signin'").first().df
    assert sum(n for _, n in doc["bm25"]["postings"]["signin"]) == index.postings.where("term = 'signin'").agg(F.sum("tf")).first()[0]
    assert import_json(spark, tmp_path) is None
    export_json(tmp_path, index)
    back = import_json(spark, tmp_path)
    for name, df in index.tables().items():
        assert sorted(map(repr, df.select(sorted(df.columns)).collect())) == sorted(map(repr, getattr(back, name).select(sorted(df.columns)).collect())), name
    assert rank(back, "sign in") == rank(index, "sign in")
    (home / "index.json").unlink(), (home / ".index.json.crc").unlink(missing_ok=True)
    (home / "index.json").write_text("{")
    with pytest.raises(ValueError, match="invalid JSON in .corvane/index.json"):
        import_json(spark, tmp_path)
    meta = home / (home / "current").read_text() / "meta.json"
    meta.unlink(), (meta.parent / ".meta.json.crc").unlink(missing_ok=True)
    meta.write_text("{")
    with pytest.raises(ValueError, match="invalid JSON"):
        load_index(spark, tmp_path)


def test_byte_order_marks_and_word_boundaries():
    """White space holds the byte-order mark, words and their boundaries are ASCII."""
    assert symbols_of("\ufefffunction foo(a) {\n}", "js") == [("foo", "function", 1, 2)]
    assert symbols_of("\ufeffdef foo(a):\n\u00a0 def bar(b):", "py") == [("foo", "def", 1, 1), ("bar", "def", 2, 2)]
    assert imports_of("\ufeffimport x from './a';\nérequire('b')\nxrequire('c')", "js") == ["./a", "b"]
    assert symbols_of("\x1cfunction foo(a) {", "js") == []


def test_neighbors_at_any_depth(spark):
    """A chain of 60 files with a cycle ends when nothing new is found; the plan doesn't grow with the hops."""
    edges = spark.createDataFrame([(f"f{i:02}", f"f{i + 1:02}", 0, 0) for i in range(59)] + [("f59", "f10", 0, 1)], "src string, dst string, out_pos int, in_pos int")
    start = spark.createDataFrame([("f30",), (None,)], "start string")
    out = neighbors(edges, start, [], 50)
    rows = [(r.path, r.hops) for r in out.where("direction = 'imports'").orderBy("pos").collect()]
    assert rows == [(f"f{i:02}", i - 30) for i in range(31, 60)] + [(f"f{i:02}", i + 20) for i in range(10, 30)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("\n") < 40


def test_staged_tables_of_a_block_are_removed(spark, tmp_path):
    from corvane.durable import staged, staging

    with staging(spark):
        df = staged(spark.range(3), "block")
        path = df.inputFiles()[0].removeprefix("file://")
        assert df.count() == 3 and __import__("os").path.exists(path)
    assert not __import__("os").path.exists(path)

"""Generated files, documented functions and splitting."""

import random

import pytest

from corvane.llm import function_docs, splitting
from corvane.llm.function_docs import documented_functions, pairs_of, prose_words
from corvane.llm.generated_files import FEATURES, file_features, judged_files, shingle_sample
from corvane.llm.splitting import oversized_pieces, split_text, units

rng = random.Random(11)
WORDS = [f"{a}{b}{c}" for a in "bcdfglmnprst" for b in "aeiou" for c in ("n", "rk", "st", "mo")]


def source(seed, n=40):
    r = random.Random(seed)
    return "\n".join(f"def {r.choice(WORDS)}_{i}({r.choice(WORDS)}):\n    {r.choice(WORDS)} = {r.choice(WORDS)}.{r.choice(WORDS)}({r.randint(1, 99)})\n    return {r.choice(WORDS)}\n" for i in range(n))


LIB = source(1)
ALTERED = "# Some licence\n# text of the licence\n\n" + LIB.replace(LIB.split("\n")[60], "    changed = here(1)", 1)
MIN = "!function(e,t){e.item=t}(a,b);" * 60
FILES = [
    (1, "r1", "src/a.py", "py", source(2), None),
    (2, "r1", "src/b.js", "JS", MIN, "minified"),
    (3, "r1", "lib/t.py", "py", "T = {\n" + "".join(f'    "k{i}": ({i}, "v"),\n' for i in range(60)) + "}\n", "data"),
    (4, "r1", "src/x.pb.go", "go", "package x\n\nfunc A() {\n}\n", "generated"),
    (5, "r1", "src/y.ts", "ts", "// <auto-generated> thing </auto-generated>\n\nexport function y() {\n}\n", "generated"),
    (6, "r1", "tools/codegen/z.js", "js", 'function z() {\n}\nout.push("// Code generated by z. DO NOT EDIT.")\n', None),
    (7, "r1", "src/w.py", "py", "# First made with stub; kept by hand since, edit freely.\n\n" + source(3), None),
    (8, "r1", "vendor/lib-1.0/i.rs", "rust", "fn a() {\n}\n", "copied"),
    (9, "r1", "vendor_portal/i.rs", "rust", "fn a() {\n}\n", None),
    (10, "r1", "src/lib.py", "py", LIB, "copied"),
    (11, "r2", "app/other.py", None, ALTERED, "copied"),
    (12, "r2", "src/__init__.py", "py", "__all__ = []\n", None),
    (13, "r3", "src/__init__.py", "py", "__all__ = []\n", None),
    (14, "r3", "src/own.py", "py", source(4), None),
    (15, "r3", "src/own.py", "py", source(4), None),
    (16, "r3", "n.c", None, "const char d[] = {\n" + "  0x12, 0x34, 0xab,\n" * 50 + "};\n", "data"),
    (17, None, "gone.py", "py", "", None),
    (18, "r3", "e.js", "js", "", None),
    (19, "r3", "acc.cs", "cs", "class A {\n" + "".join(f"  public int getF{i}() {{ return fields[{i}]; }}\n" for i in range(9)) + "}\n", "generated"),
    (20, "r3", "re.py", "py", 'X_RE = "' + "|".join(WORDS) + '"\n' + source(5, 3), None),
    (21, "r3", "doc.md", "text", "A long paragraph of prose " * 30, None),
    (22, "r3", "b64.js", "js", 'const d = "' + "QUJDRA9x+/Zz" * 60 + '";\nmodule.exports = d;\n', "data"),
]


@pytest.fixture(scope="module")
def judged(spark):
    files = spark.createDataFrame([(f[0], f[1], f[2], f[3], 1, "x") for f in FILES] + [(23, "r", "null.py", "py", 1, "x")], "file_id long, repo string, path string, lang string, sketch int, content string")
    text = spark.createDataFrame([(f[0], f[4], "y") for f in FILES] + [(23, None, "y")], "file_id long, content string, lang string")
    return {r.file_id: r for r in judged_files(files, text).collect()}


@pytest.mark.parametrize("f", FILES, ids=lambda f: f[2])
def test_judged(judged, f):
    assert judged[f[0]].reason == f[5]


def test_null_content_is_not_judged(judged):
    assert 23 not in judged and len(judged) == len(FILES)


def test_no_files(spark):
    files = spark.createDataFrame([], "file_id long, repo string, path string, lang string")
    assert judged_files(files, spark.createDataFrame([], "file_id long, content string")).count() == 0


def test_features_of_long_lines():
    assert file_features("x" * 300_000)[1] == 300_000
    assert file_features('"' + "\\" * 50_000)[0] == 1


def test_shingle_sample_matches_sets():
    def full(t):
        return set(shingle_sample(t.encode(), 1)[0].tolist())

    a, b = full(LIB), full(ALTERED.split("\n\n", 1)[1])
    words = LIB.replace("(", " ").replace(")", " ").replace(":", " ").replace(".", " ").replace("=", " ").split()
    assert len(a) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    assert 0.9 < len(a & b) / len(a | b) < 1
    assert set(shingle_sample(LIB.encode(), 4)[0].tolist()) <= a
    assert len(full("a b c d")) == 0 and full("A b, c-d e") == full("a B c d E")


def near_copies(spark, texts):
    """Ids of the copies among (repo, text), the id being the place in the list."""
    files = spark.createDataFrame([(i, r, f"src/f{i}.py", "py") for i, (r, _) in enumerate(texts)], "file_id long, repo string, path string, lang string")
    content = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "file_id long, content string")
    return {r.file_id: r.copy_similarity for r in judged_files(files, content).where("copy_similarity is not null").collect()}


def test_copies_are_found_whatever_other_files_share_their_shingles(spark):
    words = [random.Random(7).choice(WORDS) + str(i) for i in range(700)]
    version = " ".join(words[:600])  # in repo a, and its copy in b
    older = " ".join(words[:510] + [f"older{i}" for i in range(90)])
    part = " ".join(words[100:250] + [f"part{i}" for i in range(450)])
    others = [("A", older), ("a0", part), ("z", part.replace("part", "other"))]
    assert near_copies(spark, [("A", version), ("b", version), *others]) == {0: 1.0, 1: 1.0}
    got = near_copies(spark, [("A", version), ("b", version + " end"), *others, ("A", older + " x"), ("zz", part.replace("part", "more"))])
    assert set(got) == {0, 1} and min(got.values()) > 0.95


@pytest.mark.parametrize(
    "head",
    ["// licence line\n" * 50 + "// @generated\n", "/*\nSome words.\n@generated\n*/\n", '"""Words.\n\n@generated by gen.py\n"""\n', "// Licence\n\npackage a.b;\n\n// Code generated by z. DO NOT EDIT.\n"],
)
def test_marks_anywhere_in_the_head(head):
    made = [f.name for f in FEATURES].index("made_mark") - 1
    code = "int a(b) {\n    c();\n}\n" * 9
    assert file_features(head + code)[made] and not file_features(head.replace("@generated", "made").replace("generated", "kept").replace("DO NOT EDIT", "") .replace("made by", "for") + code)[made]
    assert not file_features(code + "/*\n@generated\n*/\n" + code)[made]


def test_literals_in_few_long_lines_are_data(spark):
    files = spark.createDataFrame([(1, "r", "src/a.js", "js"), (2, "r", "src/b.js", "js")], "file_id long, repo string, path string, lang string")
    blob = "const WORDS = [" + ",".join(f'"{w}"' for w in WORDS * 10) + "];\n"
    calls = "run(" + ",".join(f"{w}({w})" for w in WORDS * 10) + ");\n"
    text = spark.createDataFrame([(1, blob + "module.exports = WORDS;\n"), (2, calls)], "file_id long, content string")
    assert {r.file_id: r.reason for r in judged_files(files, text).collect()}[1] == "data"
    assert file_features(calls)[8] == 0


def test_similarity_is_exact(spark):
    r = random.Random(5)
    texts, want = [], {}
    for k in range(60):
        n = r.randint(44, 160)
        a = [f"w{k}x{j}" for j in range(n)]
        b = list(a)
        if k % 3:  # words changed at one end: as many shingles differ, so the similarity is about 0.8
            changed = max(1, round(n * (0.095 if k % 3 == 1 else 0.13)))
            b[-changed:] = [f"c{k}x{j}" for j in range(changed)]
        sa, sb = ({tuple(w[i : i + 5]) for i in range(n - 4)} for w in (a, b))
        jaccard = len(sa & sb) / len(sa | sb)
        texts += [(f"p{k}", " ".join(a)), (f"q{k}", " ".join(b))]
        if jaccard >= 0.8:
            want |= {2 * k: jaccard, 2 * k + 1: jaccard}
    assert near_copies(spark, texts) == pytest.approx(want) and 0 < sum(x < 0.85 for x in want.values()) and len(want) < 100


# Documentation -------------------------------------------------------------------------------------------------------

PY = '''# Adds two numbers with great care.
def add(a, b):
    return a

def no_doc(a):
    return a

@cached
def decorated(
    a=(1, ")"),  # :
):
    # first
    r"""Reads every value of the table.

    Args:
        a: x
    """
    return a

class C:
    def m(self):
        """TODO"""

    # pylint: disable=all
    def n(self):
        'One single quoted line of words.'
# x = call(3)
def code(a):
    pass

# Prose that is far away.

def far(a):
    pass
'''
JS = """/**
 * Resolve item name.
 * @param {string} item
 */
function resolveItemName(item) {
}
/**
 * @param {string} item The name to look up now
 */
export const find = (item) => {
};
// eslint-disable-next-line no-unused-vars
function lint(a) {
}
foo(); /* trailing words are no doc */
function trailing(a) {
}
/* Words of a real block comment.
*/
@Memo()
method(a) {
}
"""


def sym(name, line, kind="function", end=None):
    return {"name": name, "kind": kind, "line": line, "end_line": end}


def test_python_pairs():
    lines = {n: i + 1 for i, row in enumerate(PY.split("\n")) for n in ("add", "no_doc", "decorated", "m", "n", "code", "far") if f"def {n}(" in row}
    got = pairs_of(PY, "py", [sym(n, k, "def") for n, k in lines.items()])
    assert [p[1] for p in got] == ["add", "decorated", "n"]
    assert got[0][7] == "# Adds two numbers with great care." and got[0][8].startswith("def add") and PY[got[1][4] : got[1][5]].startswith('"""Reads')


def test_js_pairs():
    lines = {"resolveItemName": 5, "find": 10, "lint": 13, "trailing": 16, "method": 21}
    got = pairs_of(JS, "js", [sym(n, k) for n, k in lines.items()])
    assert [p[1] for p in got] == ["find", "method"]


@pytest.mark.parametrize(
    ("doc", "name", "n"),
    [("/** Set jishund state. */", "setJishundState", 0), ("// TODO: docs", "x", 1), ("/** {@inheritDoc} */", "x", 0), ("# -- helpers --", "x", 1), ("// ====", "x", 0),
     ("/**\n * @returns {boolean}\n */", "x", 0), ('"""Get file."""', "get_file", 0), ("// go: one two three four", "x", 0), ("# Lädt jede Datei neu ein.", "f", 5),
     ("# :param int size: the size of it", "f", 4), ("// if (a) {\n// }", "f", 0)],
)
def test_prose(doc, name, n):
    assert prose_words(doc, name) == n


def test_documented_functions(spark):
    schema = "file_id long, path string, lang string, symbols array<struct<name:string,kind:string,line:int,end_line:int>>, content int"
    rows = [
        (1, "a.py", None, [("add", "def", 2, None), ("no_doc", "def", 5, 6), ("add", "class", 2, 3), (None, "def", None, 1), ("beyond", "def", 999, 1)], 0),
        (2, "b.js", "JS", [("find", "function", 10, 11), ("find2", "method", 10, 11)], 0), (3, "c.py", "py", None, 0), (4, "d.py", "py", [], 0), (5, "e.py", "py", [("x", "def", 1, 1)], 0), (6, "f.py", "py", [("x", "def", 1, 1)], 0),
    ]
    text = spark.createDataFrame([(1, PY), (2, JS), (3, PY), (5, None), (6, "")], "file_id long, content string")
    got = documented_functions(spark.createDataFrame(rows, schema), text).orderBy("file_id", "name").collect()
    assert [(r.file_id, r.sym_line, r.name) for r in got] == [(1, 2, "add"), (2, 10, "find"), (2, 10, "find2")]
    assert got[0].end_line == 3 and documented_functions(spark.createDataFrame([], schema), text).count() == 0


def test_ends_of_functions():
    """Code runs from the header to the end of the body, whatever symbols stand inside or after it."""
    js = "// Adds all of these numbers.\nfunction a(x = {}) {\n  const b = '}';\n  return `{${b}`; // }\n}\n// Other words that stand here.\nfunction c(x) {\n}\n"
    got = pairs_of(js, "js", [sym("a", 2), sym("b", 3, "const"), sym("c", 7)])
    assert [(p[1], p[0], p[3]) for p in got] == [("a", 2, 5), ("c", 7, 8)] and got[0][8].endswith("\n}")
    py = "def a(\n    x,\n):\n    \"\"\"Says four or more words.\"\"\"\n    def b():\n        pass\n\n    return b\n\n# next\nx = 1\n"
    assert [(p[0], p[3]) for p in pairs_of(py, "py", [sym("a", 1, "def"), sym("b", 5, "def")])] == [(1, 8)]
    rb = "# Says four or more words.\ndef a\n  if x\n    y\n  end\nend\n\ndef b\nend\n"
    assert [(p[0], p[3]) for p in pairs_of(rb, "rb", [sym("a", 2, "def"), sym("b", 8, "def")])] == [(2, 6)]
    assert [(p[0], p[3]) for p in pairs_of("// Says four or more words.\nfunction a() {\n x\n", "js", [sym("a", 2, end=3)])] == [(2, 3)]


def test_deep_brackets_do_not_end_the_parse():
    deep = "[" * 50_000 + "]" * 50_000
    text = f'def f(a={deep}):\n    """Says four or more words."""\n'
    assert [p[1] for p in pairs_of(text, "py", [sym("f", 1, "def")])] == ["f"]
    open_ = "def f(a=" + "[" * 50_000 + '):\n    """Says four or more words."""\n'
    assert pairs_of(open_, "py", [sym("f", 1, "def")]) == []
    js = "// Says four or more words.\nfunction f(a) " + "{" * 50_000 + "}" * 50_000 + "\n"
    assert [p[1] for p in pairs_of(js, "js", [sym("f", 2)])] == ["f"]


def test_without_the_grammar_there_are_no_pairs(monkeypatch):
    g = function_docs.grammar("js")
    monkeypatch.setattr(g, "source", lambda s, i, memo: (i, []))
    assert pairs_of(JS, "js", [sym("find", 10), sym("method", 21)]) == []


def test_long_comments_parse_in_linear_time():
    text = "# word word word word\n" * 20_000 + "def f(a):\n    pass\n"
    assert pairs_of(text, "py", [sym("f", 20_001, "def")])[0][6] == 80_000


# Splitting -----------------------------------------------------------------------------------------------------------


def check_pieces(text, limit=384):
    pieces = split_text(text, limit)
    got = pieces[0]["text"]
    assert all(units(p["text"]) <= 4 * limit for p in pieces)
    for before, p in zip(pieces, pieces[1:]):
        if p["shared_lines"]:
            head = p["text"].split("\n")
            assert before["text"].split("\n")[-p["shared_lines"] :] == head[: p["shared_lines"]]
            got += "\n" + "\n".join(head[p["shared_lines"] :])
        else:
            assert 0 < p["shared_chars"] <= 40 and before["text"].endswith(p["text"][: p["shared_chars"]])
            got += p["text"][p["shared_chars"] :]
    assert got == text
    return pieces


@pytest.mark.parametrize("seed", range(40))
def test_split_round_trip(seed):
    r = random.Random(seed)
    rows = [r.choice(["", "x " * r.randint(1, 40), "    y = f(1);", "}", "def f():", "z" * r.choice([1400, 1500, 1536, 5000]), "😀a" * r.randint(1, 1200)]) if r.random() < 0.5 else "abc " * r.randint(1, 20) for _ in range(r.randint(1, 250))]
    check_pieces("\n".join(rows))


def test_split_shares_three_lines_and_cuts_at_boundaries():
    text = "\n".join(f"def f{i}(a):\n    x = {i}\n    return x\n" for i in range(150))
    pieces = check_pieces(text)
    assert len(pieces) > 1 and all(p["shared_lines"] == 3 for p in pieces[1:])
    assert all(p["text"].split("\n")[3].startswith("def f") for p in pieces[1:])
    assert len(split_text("a" * 1536)) == 1 and len(split_text("a" * 1537)) > 1 and split_text("")[0]["text"] == ""


def test_long_lines_are_cut_at_boundaries_far_from_the_middle():
    for mark in (" ", ";"):
        pieces = check_pieces("a" * 800 + mark + "b" * 1200)
        assert [p["text"].strip("ab") for p in pieces] == [mark, mark] and pieces[0]["text"].endswith("a" + mark)
    assert check_pieces("a" * 800 + " " + "b" * 190 + "," + "c" * 1000)[0]["text"] == "a" * 800 + " "


def test_oversized_pieces(spark, monkeypatch):
    code = "\n".join(f"line {i} of the code here" for i in range(200))
    chunks = spark.createDataFrame(
        [(1, 10, 5, 204, 1), (2, 10, 5, 10, 1), (3, 11, 1, 5, 1), (4, 99, 1, 5, 1), (5, 10, 100, 400, 1), (6, 10, None, 4, 1), (1, 10, 5, 204, 1)], "chunk_id long, cand_id long, start_line int, end_line int, code int"
    )
    cand = spark.createDataFrame([(10, 5, code, 1), (10, 5, code, 1), (11, 1, None, 1), (None, 1, code, 1)], "cand_id long, start_line int, code string, chunk_id int")
    got = oversized_pieces(chunks, cand).orderBy("chunk_id", "piece").collect()
    assert {r.chunk_id for r in got} == {1, 5} and max(r.tokens for r in got) <= 384
    one = [r for r in got if r.chunk_id == 1]
    assert [r.piece for r in one] == list(range(len(one))) and one[0].start_line == 5 and one[-1].end_line == 204
    for r in one:
        assert r.text == "\n".join(code.split("\n")[r.start_line - 5 : r.end_line - 4])
    assert oversized_pieces(chunks.where("false"), cand).count() == 0
    monkeypatch.setattr(splitting, "BROADCAST_CHUNKS", 0)
    assert oversized_pieces(chunks, cand).orderBy("chunk_id", "piece").collect() == got

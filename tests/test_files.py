"""Languages, paths, ignore patterns, the tree scanner and path safety."""

import os
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions.lang import detect_lang, detect_lang_py
from corvane.functions.paths import dirname, glob_regex, ignored, join_py, normalized, parse_ignore, source_priority
from corvane.sources.scan import PathEscape, list_tree, safe_resolve, scan_tree

PATHS = ["a.js", "b/C.TSX", "x.py", ".py", "Makefile", "a.b/c", "k.hpp", "w\\x.rs", "z.tar.gz"]


def test_languages(spark):
    df = spark.createDataFrame([(p,) for p in PATHS] + [(None,)], "p string")
    got = [r[0] for r in df.select(detect_lang(F.col("p"))).collect()]
    assert got == ["js", "tsx", "py", "py", "text", "text", "cpp", "rust", "text", None]
    assert got[:-1] == [detect_lang_py(p) for p in PATHS]


@pytest.mark.parametrize(
    ("path", "value"),
    [("src/auth.js", 1.0), ("src/attestation.js", 1.0), ("src/constitution.ts", 1.0), ("lib/inspector.js", 1.0), ("src/__tests__/a.js", 0.2), ("docs/x.md", 0.2),
     ("a/examples/b.py", 0.2), ("a/b.test.js", 0.2), ("a/b.spec.tsx", 0.2), ("a/b.snap", 0.2), ("a/compiler-test-cases.js", 0.2)],
)
def test_source_priority(spark, path, value):
    assert spark.range(1).select(source_priority(F.lit(path))).first()[0] == value


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("build/", ["build/a", "x/build/a/b"], ["build", "rebuild/a"]),
        ("*.log", ["a.log", "x/y.log", "x.log/z"], ["a.logs"]),
        ("/top", ["top", "top/x"], ["a/top"]),
        ("out/**", ["out/a", "out/a/b"], ["x/out/a"]),
        ("a/**/b", ["a/b", "a/x/y/b"], ["b", "ab"]),
        ("f?.tmp", ["fa.tmp", "d/fb.tmp"], ["f.tmp", "f/x.tmp"]),
        ("n[a]", ["n[a]"], ["na"]),
    ],
)
def test_ignore_patterns(spark, pattern, yes, no):
    rx = re.compile(glob_regex(pattern))
    assert all(rx.match(p) for p in yes) and not any(rx.match(p) for p in no)
    df = spark.createDataFrame([(p,) for p in yes + no], "p string")
    assert [r[0] for r in df.select(ignored(F.col("p"), [pattern])).collect()] == [True] * len(yes) + [False] * len(no)


def test_parse_ignore():
    assert parse_ignore("# c\r\n\n!keep\n *.log \nx/") == ["*.log", "x/"]


def test_path_arithmetic(spark):
    cases = [("src/a/b.js", "../c.js"), ("b.js", "./c"), ("b.js", "../c"), ("a/b.js", "../../x"), ("a/b/c.js", "./d/../e.js"), ("a/b.js", "."), ("a/b.js", "././x")]
    df = spark.createDataFrame(cases, "p string, s string")
    got = [r[0] for r in df.select(normalized(F.concat(dirname(F.col("p")), F.lit("/"), F.col("s")))).collect()]
    assert got == [join_py(os.path.dirname(p) or ".", s) for p, s in cases]


@pytest.fixture()
def tree(tmp_path):
    for path, data in {
        "a.js": b"x", ".hidden/_x.js": b"y", "__tests__/b.js": b"z", "big.txt": b"q" * 50, "bin.dat": b"a\0b", "img.PNG": b"p", "node_modules/m.js": b"n", "ign/s.txt": b"s",
        "sub/k.log": b"l", "bad.txt": b"\xff\xfeok", ".gitignore": b"ign/\n*.log\n",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    os.symlink(tmp_path / "a.js", tmp_path / "link.js")
    os.symlink("/etc", tmp_path / "etc")
    os.mkfifo(tmp_path / "pipe")
    return tmp_path


def test_scan(spark, tree):
    rows = {r["path"]: r for r in scan_tree(spark, tree, 40).collect()}
    assert sorted(rows) == [".gitignore", ".hidden/_x.js", "__tests__/b.js", "a.js", "bad.txt"]
    assert rows["bad.txt"]["text"] == "��ok" and rows["a.js"]["size"] == 1
    assert "big.txt" in dict(list_tree(tree, 50)) and "big.txt" not in dict(list_tree(tree, 49))
    with pytest.raises(OSError, match="cannot read directory"):
        list_tree(tree / "missing")


def test_safe_resolve(tree):
    assert safe_resolve(tree, "a.js").name == "a.js"
    for bad in ("/etc/passwd", "../x", "sub/../../x", "etc/passwd"):
        with pytest.raises(PathEscape, match="path escapes root"):
            safe_resolve(tree, bad)

"""Text primitives against pinned values, and expressions against the Python functions."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import textops as X


def test_tokenize_pinned():
    assert X.tokenize("Login") == ["login"]
    assert X.tokenize("getUserID") == ["getuserid", "get", "user", "id"]
    assert X.tokenize("TOKEN_TTL") == ["token", "ttl"]
    assert X.tokenize("HTTPServer") == ["httpserver", "http", "server"]
    assert X.tokenize("v2beta") == ["v2beta", "beta"]
    assert X.tokenize("login login") == ["login", "login"]
    assert X.tokenize("?!") == X.tokenize("") == X.tokenize(None) == []


def test_split_identifier_pinned():
    assert X.split_identifier("getUserID") == ("getuserid", "get", "user", "id")
    assert X.split_identifier("login") == ("login",)
    assert X.split_identifier("TOKEN_TTL") == ("token_ttl", "token", "ttl")
    assert X.split_identifier("foo-bar") == ("foo-bar", "foo", "bar")


CASES = ["getUserID", "HTTPServer2x", "a1B2c3", "foo_barBaz-qux", "XMLHttpRequest", "ABc", "aB", "éclairFoo", "x", "", "v2beta 10 TOKEN_TTL $foo", "日本 aa"]


def test_expressions_agree_with_python(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CASES)] + [(99, None)], "i int, t string")
    got = {r["i"]: r for r in df.select("i", X.tokenize_col(F.col("t")).alias("tok"), X.identifier_parts(F.coalesce("t", F.lit(""))).alias("parts")).collect()}
    for i, c in enumerate(CASES):
        assert got[i]["tok"] == X.tokenize(c)
        if " " not in c:
            assert got[i]["parts"] == list(X.split_identifier(c))
    assert got[99]["tok"] == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abAB01_-$é", max_size=12))
def test_pieces_cover_the_identifier(token):
    whole, *pieces = X.split_identifier(token)
    assert whole == token.lower() and len(set([whole, *pieces])) == len(pieces) + 1
    assert all(p in whole for p in pieces)


def test_lines_hash_and_estimate(spark):
    rows = [("a\nb\nc",), ("",), ("x\n",), (None,), ("😀ab",)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(
        X.line_count(F.col("t")).alias("n"), X.line_slice(F.col("t"), F.lit(2), F.lit(9)).alias("s"), X.line_slice(F.col("t"), F.lit(3), F.lit(2)).alias("e"),
        X.content_hash(F.col("t")).alias("h"), X.token_estimate(F.col("t")).alias("tok"),
    ).collect()
    assert [r["s"] for r in got] == ["b\nc", "", "", None, ""]
    assert [r["e"] for r in got][:2] == ["", ""]
    assert [r["n"] for r in got][:3] == [3, 1, 2]
    assert got[0]["h"] == hashlib.sha1(b"a\nb\nc").hexdigest()[:12]
    assert spark.range(1).select(X.content_hash(F.lit("hello")).alias("h")).first()["h"] == "aaf4c61ddcc5"
    assert [r["tok"] for r in got] == [2, 0, 1, None, 1]
    assert X.estimate_tokens("😀😀😀") == 2

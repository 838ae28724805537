"""Text primitives: terms, identifier pieces, lines, hashes and token estimates.

Each primitive exists as a Spark ``Column`` expression that stays inside the
JVM.  The term splitter also exists as a plain Python function, for Arrow
batches (where a memo over the vocabulary beats four regex passes per word) and
for free-text tasks, which are turned into literals on the driver.

Null text gives null for scalar results and an empty array for term lists.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

RAW_WORD = "[A-Za-z0-9]+"
_RAW = re.compile(RAW_WORD)
#: Where a word parts: at separators, before a capital that follows a small letter or starts a word after an acronym,
#: and between letters and digits.  Java and Python read the expression alike.
BOUNDARY = r"[_\-]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
_BOUNDARY = re.compile(BOUNDARY)
MIN_TERM = 2


@lru_cache(maxsize=1 << 18)
def split_identifier(token: str) -> tuple[str, ...]:
    """The lower-cased token, then its pieces, each once and in order.

    >>> split_identifier("getUserID")
    ('getuserid', 'get', 'user', 'id')
    >>> split_identifier("TOKEN_TTL")
    ('token_ttl', 'token', 'ttl')
    """
    return tuple(dict.fromkeys([token.lower(), *(p.lower() for p in _BOUNDARY.split(token) if p)]))


@lru_cache(maxsize=1 << 18)
def terms_of_word(word: str) -> tuple[str, ...]:
    """Index terms of one raw word: its pieces of at least two characters."""
    return tuple(p for p in split_identifier(word) if len(p) >= MIN_TERM)


def tokenize(text: str | None) -> list[str]:
    """Terms of ``text`` in order, duplicates kept; null or empty text has none."""
    if not text:
        return []
    return [t for w in _RAW.findall(text) for t in terms_of_word(w)]


def raw_words(text: Column) -> Column:
    """ASCII alphanumeric runs of ``text``."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({RAW_WORD})"), F.lit(1)), F.array().cast("array<string>"))


def identifier_parts(token: Column) -> Column:
    """``split_identifier`` as an expression; separators are ``_`` and ``-``."""
    pieces = F.filter(F.transform(F.split(token, BOUNDARY), F.lower), lambda p: p != "")
    return F.array_distinct(F.concat(F.array(F.lower(token)), pieces))


def word_terms(word: Column) -> Column:
    """Index terms of one raw word."""
    return F.filter(identifier_parts(word), lambda p: F.length(p) >= MIN_TERM)


def tokenize_col(text: Column) -> Column:
    """``tokenize`` as an expression, for short texts; long ones go through ``operators.bm25.forward_index``."""
    return F.flatten(F.transform(raw_words(text), word_terms))


def lines(text: Column) -> Column:
    """Lines of ``text``; a trailing newline gives one more, empty line."""
    return F.split(text, "\n", -1)


def line_count(text: Column) -> Column:
    return F.size(lines(text))


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` (1-based, inclusive, clamped), joined again; empty if out of range."""
    rows = lines(text)
    first = F.greatest(F.lit(1), start)
    n = F.least(F.size(rows), end) - first + 1
    return F.when(n > 0, F.array_join(F.slice(rows, first, F.greatest(n, F.lit(0))), "\n")).otherwise(
        F.when(text.isNotNull() & start.isNotNull() & end.isNotNull(), "")
    )


def numbered_lines(text: Column, start: Column) -> Column:
    """Lines of ``text`` with their numbers, the first being ``start``."""
    return F.array_join(F.transform(lines(text), lambda row, i: F.concat((i + start).cast("string"), F.lit(": "), row)), "\n")


def content_hash(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 12)


def utf16_units(text: Column) -> Column:
    """UTF-16 code units: code points, plus one for each outside the basic plane."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-16 units, rounded up."""
    return F.ceil(utf16_units(text) / 4).cast("int")


def estimate_tokens(text: str) -> int:
    """``token_estimate`` of a Python string."""
    units = len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2
    return -(-units // 4)

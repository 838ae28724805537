"""Evaluation texts that leak into training text.

A document leaks an item if its rendered text holds at least ``WORDS``
consecutive words of the item.  The patterns are all windows of that many words
of all items, and the search is Wu-Manber over words: a shift table over blocks
of ``BLOCK`` words says how far the window may jump, blocks with shift 0 select
the bucket of patterns that end so, a hash of all words picks among them, and a
direct comparison confirms.  Text in which no full jump meets a block of an item is
passed without looking further.  The tables are arrays, made once and broadcast;
``PASS_CHARS`` bounds them to about 60 MB.

Words are runs of letters and digits, case-folded, of the text as the rendered
page shows it: links show their label, templates their values, references
nothing, comments count, markup and invisible characters don't part a word.

Defined results: null texts and items hold nothing; an item shorter than
``WORDS`` words can't leak; a passage that several items share counts for each of
them.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.durable import staged
from corvane.parallel import spread

WORDS = 12
BLOCK = 3
#: Characters of item text searched in one pass; a larger test set is searched in that many passes.
PASS_CHARS = 8_000_000

_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_REF_EMPTY = re.compile(r"<ref\b[^<>]*/>", re.I)
_REF = re.compile(r"<ref\b[^<>]*>.*?</ref\s*>", re.I | re.S)
_BREAK = re.compile(r"<!--|-->|</?(?:br|p|div|hr|li|ul|ol|tr|td|th|table|center|blockquote)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_QUOTES = re.compile(r"'{2,}")
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]")
_OUTSIDE = re.compile(r"\[(?:https?:|ftp:)?//[^\s\]]+\s*([^\]\n]*)\]")
_PARAM = re.compile(r"\{\{\{[^{}|]*\|?([^{}]*)\}\}\}")
_TEMPLATE = re.compile(r"\{\{[^{}|]*((?:\|[^{}]*)?)\}\}")
_ARGUMENT = re.compile(r"\|(?:[^|={}]*=)?")


def rendered_words(text: str) -> list[str]:
    """The words of wiki text as its rendered page shows them."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    if "<" in text:
        if "<ref" in text or "<REF" in text or "<Ref" in text:
            text = _REF.sub("", _REF_EMPTY.sub("", text))
        text = _TAG.sub("", _BREAK.sub(" ", text))
    if "''" in text:
        text = _QUOTES.sub("", text)
    if "//" in text:
        text = _OUTSIDE.sub(r"\1", text)
    before = None
    while text != before:  # each round takes off the innermost level
        before = text
        if "[[" in text:
            text = _LINK.sub(r"\1", text)
        if "{{" in text:
            text = _PARAM.sub(r"\1", text)
            text = _TEMPLATE.sub(lambda m: _ARGUMENT.sub(" ", m.group(1)), text)
    return _WORD.findall(text.casefold())


_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` word numbers from each place on."""
    n = max(0, len(ids) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = (h ^ ids[j : j + n].astype(np.uint64)) * _MULTIPLY
        h ^= h >> np.uint64(29)
    return h


class WuManber:
    """Multi-pattern search for word windows of equal length, its tables in sorted arrays.

    Words of items have numbers from 1; any other word is 0.  Tables are keyed by 64-bit hashes; a clash can only make a
    shift shorter or ask for one more comparison, never change the result.
    """

    def __init__(self, items: list[tuple[int, str]], words: int = WORDS, block: int = BLOCK):
        self.m, self.b, self.jump = words, block, words - block + 1
        self.vocabulary: dict[str, int] = {}
        ids: list[int] = []
        owner: list[int] = []
        starts: list[int] = []
        for item, text in items:
            w = rendered_words(text)
            if len(w) >= words:
                starts += range(len(ids), len(ids) + len(w) - words + 1)
                ids += [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w]
                owner += [item] * (len(w) - words + 1)
        self.ids = np.array(ids, np.int32)
        start = np.array(starts, np.int64)
        ends = _hashes(self.ids, block)
        # Shift of a block: how far from the end of a window it stands, at least.
        self.blocks, place = np.unique(ends, return_inverse=True)
        self.shift = np.full(len(self.blocks), self.jump, np.int16)
        for e in range(block, words + 1):
            np.minimum.at(self.shift, place[start + e - block], words - e)
        # Windows in buckets by their last block, within them by the hash of all words.
        window, suffix = _hashes(self.ids, words)[start], place[start + words - block] if len(start) else start
        order = np.lexsort((window, suffix))
        self.start, self.item, self.window = start[order], np.array(owner, np.int64)[order], window[order]
        self.windows = np.unique(window)
        self.bucket = np.searchsorted(suffix[order], np.arange(len(self.blocks) + 1))

    def _lookup(self, keys: np.ndarray) -> np.ndarray:
        """Number of each block, -1 for those of no item."""
        at = np.searchsorted(self.blocks, keys).clip(0, len(self.blocks) - 1)
        return np.where(self.blocks[at] == keys, at, -1)

    def search(self, w: list[str]) -> dict[int, int]:
        """Items with a window in ``w``, each with the number of its windows found."""
        found: dict[int, int] = {}
        m, b, n = self.m, self.b, len(w)
        if n < m or not len(self.start):
            return found
        ids = np.fromiter(map(self.vocabulary.get, w, repeat(0)), np.int32, n)
        # Any window holds a block at one of the places that full jumps visit; without one there is no more to see.
        jumps = np.arange(m - b, n - b + 1, self.jump)
        jumps = jumps[(ids[jumps] > 0) & (ids[jumps + b - 1] > 0)]
        h = _hashes(ids, b)
        if not len(jumps) or (self._lookup(h[jumps]) < 0).all():
            return found
        near = np.flatnonzero((ids[: len(h)] > 0) & (ids[b - 1 :] > 0))
        near = near[near >= m - b]
        known = self._lookup(h[near])
        last = (known >= 0) & (self.shift[known] == 0)
        if not last.any():
            return found
        starts, buckets = near[last] - (m - b), known[last]
        keys = _hashes(ids, m)[starts]
        # The windows that may be in their bucket: a window hash is one of all, and few are.
        likely = self.windows[np.searchsorted(self.windows, keys).clip(0, len(self.windows) - 1)] == keys
        for at, k, key in zip(starts[likely].tolist(), buckets[likely].tolist(), keys[likely]):
            text = ids[at : at + m]
            lo, hi = self.bucket[k], self.bucket[k + 1]
            i = lo + np.searchsorted(self.window[lo:hi], key)
            items = set()
            while i < hi and self.window[i] == key:
                if (self.ids[self.start[i] : self.start[i] + m] == text).all():
                    items.add(int(self.item[i]))
                i += 1
            for item in items:
                found[item] = found.get(item, 0) + 1
        return found


OUT = "doc_id long, item_id long, windows int"


def _search(shared: Broadcast, words_of: Callable[[str], list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value  # loaded once by a worker
        for batch in batches:
            docs: list[int] = []
            hits: list[int] = []
            windows: list[int] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for item, n in table.search(words_of(text)).items():
                    docs.append(doc)
                    hits.append(item)
                    windows.append(n)
            yield pa.record_batch(
                [pa.array(docs, pa.int64()), pa.array(hits, pa.int64()), pa.array(windows, pa.int32())], names=["doc_id", "item_id", "windows"]
            )

    return run


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [" ".join(rendered_words(t)) for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(words, pa.string())], names=["doc_id", "text"])


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, windows) for each document and each test item that it holds a passage of.

    The test set is the stated query set of the search: it is read in blocks of at most about ``PASS_CHARS``
    characters, and each block is searched for in all documents.  With more blocks than one, documents are rendered
    once, to a table.
    """
    spark = documents.sparkSession
    tests = items.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = int(size // PASS_CHARS) + 1
    texts = documents.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = spread(texts, "doc_id")
    if passes > 1:
        texts = staged(texts.mapInArrow(_render, "doc_id long, text string"), "rendered-texts")
    out = None
    for k in range(passes):
        block = [(r[0], r[1]) for r in tests.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).collect()]
        shared = spark.sparkContext.broadcast(WuManber(block))
        hits = texts.mapInArrow(_search(shared, rendered_words if passes == 1 else str.split), OUT)
        out = hits if out is None else out.unionByName(hits)
    return out

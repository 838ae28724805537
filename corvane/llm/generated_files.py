"""Files nobody wrote by hand: generated, minified, vendored, or data saved as code.

Layout statistics of each file (maximum and mean line length, white-space,
alphanumeric and digit shares, literal lines, long encoded runs, numbered
accessors) are compared with thresholds tuned per language.  They tell minified
and bundled files and bulk data from source.  Layout can't tell who wrote a
well-formatted file, so three more signals follow: a generator's mark in a comment
at either end of the file, the file names and folders that generators and
vendoring use, and, for copies kept elsewhere, near-duplicates across repositories
on shingles of five words with a similarity of 0.8 or more.

Near-duplicates are judged on the hashes of all shingles of a file, none sampled.
Files with equal sets stand behind one key.
In one order of all hashes, two sets as similar as asked for share a hash among
the first of each (prefix filter), so pairs come from those hashes and none is left
out.  The order puts hashes that many files hold last, by counts of some of the
sets, so that boilerplate makes few pairs; it decides the work, not the result.  A
pair is compared in full if the hashes it shares there leave it possible.

Defined results: null content is not judged; empty files and files under
``MIN_WORDS`` words are never copies (one-line boilerplate is alike everywhere);
a null or unknown language is taken from the path; a null repo is a repo of its
own; the comment block at the head, often a licence, takes no part in the
comparison.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.durable import staged
from corvane.parallel import spread
from corvane.functions.lang import detect_lang
from corvane.llm.records import distinct_records

SHINGLE = 5
SIMILARITY = 0.8
MIN_WORDS = 40
#: One set in so many is counted for the order of hashes, and so many hashes at most are told to be frequent.
COUNTED, FREQUENT = 16, 1 << 18

_COMMENT = re.compile(r"\s*(?:#(?!include|define|if|endif|pragma|\[)|//|/\*|\*|--|<!--|;|'''|\"\"\")")
_MADE = re.compile(
    r"@generated|\b(?:auto|machine)[- ]?(?:generated|made|written|produced)|\bautogenerated|"
    r"\b(?:generated|produced|created|emitted|written|compiled|built|made)\s+(?:code\s+)?(?:automatically|mechanically|by\s+(?!hand\b)|from\s+\S+\.\w+|with\s+\S+[ ,-]+do\b)|"
    r"automatically (?:generated|created|produced|written)|\bdo not (?:edit|modify|change|touch)|"
    r"(?:changes|edits|modifications)\b.{0,40}\b(?:lost|overwritten|discarded)|\bedit \S+ and (?:re-?run|run|re-?generate|rebuild)|\bgenerated (?:file|code|source)\b|"
    r"\b(?:generiert|erzeugt)\b|nicht von hand|g[ée]n[ée]r[ée] (?:par|automatiquement|avec|depuis)|ne pas (?:modifier|[ée]diter)|"
    r"\bgenerado (?:por|autom|con|desde)|no (?:editar|modificar)|gerado (?:por|autom)|сгенерирован|не редактировать|не изменять|自动生成|請勿編輯|请勿编辑|自動生成",
    re.I,
)
_UNMADE = re.compile(r"(?:kept|maintained|edited|written|changed) by hand|hand[- ](?:written|edited|maintained)|edit freely|no longer generated|not generated|was once generated|safe to edit|originally generated", re.I)
_COPIED = re.compile(
    r"\b(?:copied|vendored|imported|taken|borrowed|adapted|ported|lifted|forked|mirrored)\s+(?:verbatim\s+|unchanged\s+)?from\s+\S+|\bupstream\b|"
    r"\bpart of the \S+ (?:distribution|library|package|project)\b|\bv\d+(?:\.\d+)+\b.{0,40}\b(?:licen[cs]e|licen[cs]ed|released)\b",
    re.I,
)
_ACCESSOR = re.compile(r"\b(?:get|set|is|has)_?\w*?\d+\s*\(|\bfields?\[\d+\]|\.f\d+\b", re.I)
_ENCODED = re.compile(r"[A-Za-z0-9+/=_-]{160,}")
_STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|\'[^\'\\]*(?:\\.[^\'\\]*)*\'|`[^`\\]*(?:\\.[^`\\]*)*`')
_LITERAL_LINE = re.compile(
    r"""[\s\[\](){},;]*+(?>(?>[rbuRBU]?"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|[-+]?0[xX][0-9a-fA-F]++|[-+]?\d[\d_.eE+-]*+[a-zA-Z]{0,3}+|\b(?:true|false|null|None|True|False|nil|NULL)\b)(?:[\s\[\](){},;:]|=>|->)*+)++"""
)
LONG = 200
#: What stands before the literals of a long line: a name and its equals sign.
_ASSIGNED = re.compile(r"[^\"'`=]{0,120}+=\s*+")
#: Lines that may stand between the comments of a head, and what closes a comment of several lines.
_PREAMBLE = re.compile(r"\s*(?:<\?|package\b|[\"']use strict[\"'])")
_CLOSED_BY = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
#: Share of non-blank lines with numbered accessors from which a file counts as generated.
ACCESSOR_SHARE = 0.3

_POWER = np.uint64(0x9E3779B97F4A7C15)
_ODD = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _POWER))])
    return _powers[:n]


def shingle_sample(data: bytes, sample: int = 1) -> tuple[np.ndarray, int]:
    """Hashes of the distinct five-word shingles (1 in ``sample`` by value), and the number of words.  Words are ``\\w`` runs without case."""
    a = np.frombuffer(data, np.uint8)
    word = _IS_WORD[a] if len(a) else np.zeros(0, bool)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if len(starts) < SHINGLE:
        return np.zeros(0, np.int64), len(starts)
    # A word's hash: its letters weighted by powers counted from the end of the word.
    n = ends - starts
    owner = np.repeat(np.arange(len(starts)), n)
    inside = np.flatnonzero(word)
    weight = _power_table(int(n.max()))[(ends[owner] - 1 - inside)]
    letters = (_LOWER[a[inside]] + np.uint64(1)) * weight
    h = _mix(np.add.reduceat(letters, np.concatenate([[0], np.cumsum(n)[:-1]])))
    k = len(h) - SHINGLE + 1
    s = np.zeros(k, np.uint64)
    for j in range(SHINGLE):
        s += _mix(h[j : j + k]) * _ODD[j]
    s = np.unique(_mix(s))
    return s[s % np.uint64(sample) == 0].view(np.int64), len(h)


FEATURES = pa.schema(
    [("file_id", pa.int64()), ("lines", pa.int32()), ("max_line", pa.int32()), ("mean_line", pa.float64()), ("space_share", pa.float64()),
     ("alnum_share", pa.float64()), ("digit_share", pa.float64()), ("long_share", pa.float64()), ("encoded_share", pa.float64()),
     ("literal_lines", pa.int32()), ("literal_share", pa.float64()), ("accessor_share", pa.float64()), ("made_mark", pa.bool_()),
     ("hand_mark", pa.bool_()), ("copy_mark", pa.bool_()), ("words", pa.int32()), ("sketch", pa.list_(pa.int64())),
     ("sketch_key", pa.int64()), ("sketch_size", pa.int32())]
)
DDL = (
    "file_id long, lines int, max_line int, mean_line double, space_share double, alnum_share double, digit_share double, long_share double, "
    "encoded_share double, literal_lines int, literal_share double, accessor_share double, made_mark boolean, hand_mark boolean, copy_mark boolean, words int, sketch array<long>, sketch_key long, sketch_size int"
)
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def head_comments(rows: list[str]) -> tuple[list[str], int]:
    """The comment lines before the first line of code, inner lines of long comments included, and how many lines that head has."""
    found: list[str] = []
    closing = ""
    for i, row in enumerate(rows):
        if closing:
            found.append(row)
            if closing in row:
                closing = ""
        elif _COMMENT.match(row):
            found.append(row)
            start = row.lstrip()
            for opening, end in _CLOSED_BY.items():
                if start.startswith(opening) and end not in start[len(opening) :]:
                    closing = end
        elif row.strip() and not _PREAMBLE.match(row):
            return found, i
    return found, len(rows)


def _line_units(row: str) -> int:
    """A line as one line for every ``LONG`` characters begun."""
    return -(-len(row) // LONG)


def file_features(text: str) -> tuple:
    """The layout statistics, marks and shingle hashes of one file, in the order of ``FEATURES`` after the id."""
    rows = text.split("\n")
    full = [r for r in rows if r.strip()]
    data = text.encode("utf-8", "replace")
    a = np.frombuffer(data, np.uint8)
    size = max(1, len(a))
    counts = np.bincount(a, minlength=256) if len(a) else np.zeros(256, int)
    lengths = [len(r) for r in full] or [0]
    # Characters of code in long lines, without comments and strings, of all code.
    long_rows = [r for r in full if len(r) > LONG and not _COMMENT.match(r)]
    in_long = sum(n for n in (len(_STRING.sub("", r)) for r in long_rows) if n > LONG)
    encoded = sum(len(m) for m in _ENCODED.findall(text)) if lengths and max(lengths) >= 160 else 0
    # Long lines count as many, so that literals in few lines weigh by their characters.
    literal = 0
    for r in full:
        assigned = _ASSIGNED.match(r) if len(r) > LONG else None
        if _LITERAL_LINE.fullmatch(r, assigned.end() if assigned else 0):
            literal += _line_units(r)
    accessor = sum(_ACCESSOR.search(r) is not None for r in full if len(r) < 1000)
    made = hand = copied = False
    head = 0
    while head < len(rows) and (not rows[head].strip() or _COMMENT.match(rows[head]) or rows[head].startswith("<?")):
        head += 1
    comments, top = head_comments(rows)
    comments += [r for r in rows[max(top, len(rows) - 6) :] if _COMMENT.match(r)]
    for r in comments:
        if r.strip():
            if _UNMADE.search(r):
                hand = True
            elif _MADE.search(r):
                made = True
            elif _COPIED.search(r):
                copied = True
    body = "\n".join(rows[head:]) if head and head < len(rows) else text
    sketch, words = shingle_sample(data if body is text else body.encode("utf-8", "replace"))
    return (
        len(rows), max(lengths), sum(lengths) / len(lengths), float(counts[[9, 10, 11, 12, 13, 32]].sum() / size), float(counts[_ALNUM].sum() / size),
        float(counts[48:58].sum() / size), in_long / max(1, sum(lengths)), encoded / max(1, len(text)), literal, literal / max(1, sum(map(_line_units, full))),
        accessor / max(1, len(full)), made, hand, copied, words, sketch,
    )


def _set_key(sketch: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(sketch.tobytes(), digest_size=8).digest(), "little", signed=True)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(i, *file_features(t)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        found = [(*f, _set_key(f[-1]), len(f[-1])) for f in found]
        columns = list(zip(*found)) or [()] * len(FEATURES)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, FEATURES)], schema=FEATURES)


# Names that generators and vendoring give to files and folders.
GENERATED_PATH = (
    r"(?i)(^|/)(gen|generated|__generated__|autogen|codegen-out|out/codegen|generated-sources)/"
    r"|(^|/)zz_generated[^/]*$|_autogen\.[^/]*$|\.(pb|g|gen|generated|designer|autogen)\.[^/.]+$|_pb2(_grpc)?\.pyi?$|\.pb\.[^/]+$"
)
VENDORED_PATH = r"(?i)(^|/)(vendor|vendored|third[_-]?party|3rd[_-]?party|node_modules|bower_components|deps|external|externals)/[^/]+/"
MINIFIED_PATH = r"(?i)[.-]min\.(js|css|mjs)$|\.bundle\.js$"

class Limits(NamedTuple):
    """Layout thresholds of a language."""

    long_share: float  # code in long lines, of a minified file
    mean_line: float
    space_share: float  # white space, at most: of a minified file with some long lines
    literal_share: float  # lines of literals only, of data
    literal_lines: int
    digit_share: float  # digits among all characters, of numeric data
    encoded_share: float  # long encoded runs
    alnum_share: float  # letters and digits, of encoded data in short lines


# Languages whose code breaks lines more (py, go) or holds more figures and tables (c, cpp) than the rest.
DEFAULT_LIMITS = Limits(0.6, 120.0, 0.08, 0.8, 25, 0.12, 0.5, 0.92)
LIMITS = {
    **dict.fromkeys(("js", "jsx", "ts", "tsx"), DEFAULT_LIMITS._replace(literal_lines=20)),
    "py": Limits(0.7, 150.0, 0.06, 0.8, 20, 0.12, 0.5, 0.92),
    "go": Limits(0.7, 150.0, 0.06, 0.8, 25, 0.12, 0.5, 0.92),
    "php": Limits(0.7, 150.0, 0.08, 0.8, 25, 0.12, 0.5, 0.92),
    **dict.fromkeys(("c", "cpp"), Limits(0.7, 150.0, 0.08, 0.85, 20, 0.18, 0.5, 0.92)),
}
#: What goes with a threshold on characters: some code in long lines, and half the lines literals.
SOME_LONG, HALF_LITERAL = 0.3, 0.5


def _limit(lang: Column, name: str) -> Column:
    usual = getattr(DEFAULT_LIMITS, name)
    out = F.lit(usual)
    for known, limits in LIMITS.items():
        if (value := getattr(limits, name)) != usual:
            out = F.when(lang == known, F.lit(value)).otherwise(out)
    return out


def layout_reason(lang: Column, path: Column) -> Column:
    """``minified`` or ``data`` if the layout statistics say so, else null."""
    at_least = {name: F.col(name) >= _limit(lang, name) for name in Limits._fields if name != "space_share"}
    dense = F.col("space_share") <= _limit(lang, "space_share")
    minified = (
        at_least["long_share"] & at_least["mean_line"]
        | dense & (F.col("max_line") > LONG) & (F.col("long_share") >= SOME_LONG)
        | path.rlike(MINIFIED_PATH) & (F.col("mean_line") >= 80)
    )
    data = (
        at_least["literal_lines"] & (at_least["literal_share"] | at_least["digit_share"] & (F.col("literal_share") >= HALF_LITERAL))
        | at_least["encoded_share"]
        | at_least["alnum_share"] & dense
    )
    return F.when(lang != "text", F.when(minified, "minified").when(data, "data"))


def prefix_size(n: int, similarity: float) -> int:
    """How many first hashes of a set of ``n`` hold one of any set that similar."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1


def _prefixes(frequent: np.ndarray, counts: np.ndarray, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(sketch_key, n, h) for the first hashes of each set, rare ones first; ``frequent`` is sorted."""
    schema = pa.schema([("sketch_key", pa.int64()), ("n", pa.int32()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, firsts = [], [], []
            for key, sketch in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = sketch.values.to_numpy()
                count = np.zeros(len(h), np.int64)
                if len(frequent):
                    at = np.searchsorted(frequent, h).clip(0, len(frequent) - 1)
                    count = np.where(frequent[at] == h, counts[at], 0)
                firsts.append(h[np.lexsort((h, count))[: prefix_size(len(h), similarity)]])
                keys.append(key)
                sizes.append(len(h))
            k = [len(f) for f in firsts]
            columns = [np.repeat(np.array(keys, np.int64), k), np.repeat(np.array(sizes, np.int32), k), np.concatenate(firsts) if firsts else np.zeros(0, np.int64)]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def copied_files(sketches: DataFrame, sets: DataFrame, *, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(file_id, copy_similarity) of the files like one of another repo.

    ``sketches`` holds file_id, repo, words, sketch_key and sketch_size; ``sets`` words, sketch_key, sketch_size and sketch.
    """
    enough = (F.col("words") >= min_words) & (F.col("sketch_size") > 0)
    s = sketches.where(enough).select("file_id", F.coalesce(F.xxhash64("repo"), -F.col("file_id")).alias("repo"), F.col("sketch_key").alias("k"))
    groups = s.groupBy("k").agg(F.min("repo").alias("lo"), F.max("repo").alias("hi"))
    sets = distinct_records(sets.where(enough), "sketch_key", "sketch").select(F.col("record_id").alias("sketch_key"), F.col("value").alias("sketch"))

    counted = sets.where(F.pmod("sketch_key", F.lit(COUNTED)) == 0).select(F.explode("sketch").alias("h")).groupBy("h").count().where("count > 1")
    top = counted.orderBy(F.desc("count"), "h").limit(FREQUENT).toArrow()  # at most FREQUENT rows
    h, n = top["h"].to_numpy(), top["count"].to_numpy()
    order = np.argsort(h)
    # Both sides of the join reuse one shuffle by hash, of which adaptive execution may split a hot one.
    first = sets.mapInArrow(_prefixes(h[order], n[order], similarity), "k long, n int, h long")
    a, b = first.select("h", F.col("k").alias("ka"), F.col("n").alias("na")), first.select("h", F.col("k").alias("kb"), F.col("n").alias("nb"))
    least, most = F.least("na", "nb"), F.greatest("na", "nb")
    shared = a.join(b, "h").where((F.col("ka") < F.col("kb")) & (least >= most * similarity - 1e-6)).groupBy("ka", "kb", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    # What isn't shared among the first hashes of both is past the prefix of one of them.
    rest = F.ceil(most * similarity - 1e-9) - 1
    shared = shared.where(F.col("c") + rest >= (F.col("na") + F.col("nb")) * (similarity / (1 + similarity)) - 1e-6)
    of_a, of_b = (groups.select(F.col("k").alias(f"k{x}"), F.col("lo").alias(f"lo{x}"), F.col("hi").alias(f"hi{x}")) for x in "ab")
    pairs = staged(shared.join(of_a, "ka").join(of_b, "kb").where("not (loa = hia and lob = hib and loa = lob)"), "copy-candidates")  # read four times below

    wanted = pairs.select(F.col("ka").alias("sketch_key")).union(pairs.select("kb")).distinct()
    full = staged(sets.join(wanted, "sketch_key", "left_semi"), "candidate-sets")  # read twice below
    both = F.size(F.array_intersect("sa", "sb"))
    alike = (
        pairs.join(full.select(F.col("sketch_key").alias("ka"), F.col("sketch").alias("sa")), "ka")
        .join(full.select(F.col("sketch_key").alias("kb"), F.col("sketch").alias("sb")), "kb")
        .withColumn("both", both)
        .withColumn("jaccard", F.col("both") / (F.col("na") + F.col("nb") - F.col("both")))
        .where(F.col("jaccard") >= similarity)
    )
    # Each set with the repos of its likes, both ways, and with its own where it is in two.
    sides = F.array(
        F.struct(F.col("ka").alias("k"), F.col("lob").alias("lo"), F.col("hib").alias("hi")), F.struct(F.col("kb").alias("k"), F.col("loa").alias("lo"), F.col("hia").alias("hi"))
    )
    likes = alike.select(F.explode(sides).alias("e"), "jaccard").select("e.*", "jaccard")
    likes = likes.unionByName(groups.where("lo != hi").withColumn("jaccard", F.lit(1.0)))
    found = s.join(likes, "k").where((F.col("lo") != F.col("repo")) | (F.col("hi") != F.col("repo")))
    return found.groupBy("file_id").agg(F.max("jaccard").alias("copy_similarity"))


def file_table(files: DataFrame, file_text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The features of each file with content, staged, and the same with repo, path and lang but without the shingle sets."""
    texts = file_text.where("content is not null and file_id is not null").select(F.col("file_id").cast("long").alias("file_id"), "content")
    features = staged(spread(texts, "file_id").mapInArrow(_features, DDL), "file-features")  # read several times by what follows
    meta = files.where("file_id is not null").select(
        F.col("file_id").cast("long").alias("file_id"), "repo", "path", F.coalesce(F.lower("lang"), detect_lang(F.col("path")), F.lit("text")).alias("lang")
    )
    return features, features.drop("sketch").join(meta, "file_id")


def near_copies(files: DataFrame, file_text: DataFrame) -> DataFrame:
    """(file_id, copy_similarity) of the files that are like one of another repo."""
    features, judged = file_table(files, file_text)
    return copied_files(judged.select("file_id", "repo", "words", "sketch_key", "sketch_size"), features.select("words", "sketch_key", "sketch_size", "sketch"))


def judged_files(files: DataFrame, file_text: DataFrame) -> DataFrame:
    """Each file with content: its layout statistics, each signal, and ``reason``, null for hand-written source.

    ``reason`` is the first that holds of ``minified``, ``data``, ``generated`` and ``copied``.
    """
    features, judged = file_table(files, file_text)
    copies = copied_files(judged.select("file_id", "repo", "words", "sketch_key", "sketch_size"), features.select("words", "sketch_key", "sketch_size", "sketch"))
    code = F.col("lang") != "text"
    path = F.coalesce(F.col("path"), F.lit(""))
    lang = F.col("lang")
    generated = F.col("made_mark") | ~F.col("hand_mark") & code & (path.rlike(GENERATED_PATH) | (F.col("accessor_share") >= ACCESSOR_SHARE))
    copied = F.col("copy_mark") | path.rlike(VENDORED_PATH) | F.col("copy_similarity").isNotNull()
    reason = F.coalesce(layout_reason(lang, path), F.when(generated, "generated").when(copied, "copied"))
    return judged.drop("sketch_key", "sketch_size").join(copies, "file_id", "left").withColumn("reason", reason)

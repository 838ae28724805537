"""Registered queries of the engine, each over whole tables, and their SQL where it can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.durable import staged
from corvane.functions import textops as X
from corvane.functions.lang import detect_lang
from corvane.functions.paths import basename, dirname, ignored, normalized, parse_ignore, source_priority, to_posix
from corvane.operators import bm25
from corvane.operators.budget import fit_to_budget
from corvane.operators.chunking import chunk_ranges
from corvane.operators.graph import build_edges, neighbors, resolve_imports
from corvane.operators.imports import extract_imports
from corvane.operators.outline import file_outlines, lang_stats, outline_rows
from corvane.operators.ranges import sliced_texts, subtract_covered
from corvane.operators.symbols import extract_symbols
from corvane.parallel import spread
from corvane.plans import pack as packing
from corvane.plans import ranking
from corvane.plans.index import Index, build_index, numbered
from corvane.queries_sql import SQL  # noqa: F401
from corvane.sources.scan import BINARY_EXTENSIONS, scan_tree
from corvane.streaming.refresh import changed_files
from corvane.tables import table

REPO = ["repo"]
IGNORE = "# generated\n\ndocs/\r\n*.test.js\n!src/keep.test.js\n  /tools/**  \nlib/**/item\nsrc/*.md\ngen?\n"
MAX_SIZE = 8000


# Corpora of the data folder ------------------------------------------------------------------------------------------


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_id, doc_len, terms): the forward index of documents, each a chunk."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return bm25.forward_index(spread(docs, "chunk_id"), [])


def _newest(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The last scan of each path of each repo."""
    last = W.partitionBy("repo", "path").orderBy(F.desc("indexed_at"), F.desc("file_id"))
    files = table(spark, d, "files").where("repo is not null and path is not null").select("file_id", "repo", "path", "indexed_at", *columns)
    return files.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "indexed_at")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(repo, path, text, lang, size) of the last scan of each path."""
    both = _newest(spark, d).join(spread(table(spark, d, "file_text"), "file_id"), "file_id")
    return both.select("repo", "path", F.col("content").alias("text")).withColumn("lang", detect_lang(F.col("path")))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """(repo, chunk_id, path, start_line, end_line, symbol, text): candidates, each once, unreadable ones without text."""
    c = table(spark, d, "candidate").where("cand_id is not null and repo is not null").dropDuplicates(["cand_id"])
    return c.select("repo", F.col("cand_id").alias("chunk_id"), F.col("file").alias("path"), "start_line", "end_line", "symbol", F.col("code").alias("text"))


def _listed_imports(spark: SparkSession, d: str) -> DataFrame:
    """The imports of each file as listed, and then two that do resolve: the next path of the repo as it stands, and the
    third next without its extension, both written relative to the file."""
    w = W.partitionBy("repo").orderBy("path")
    up = F.concat(F.lit("./"), F.repeat(F.lit("../"), F.size(F.split("path", "/")) - 1))
    made = F.filter(
        F.array(F.concat(up, F.lead("path", 1).over(w)), F.concat(up, F.regexp_replace(F.lead("path", 3).over(w), r"\.(js|ts|py)$", ""))), lambda s: s.isNotNull()
    )
    specifiers = F.concat(F.coalesce("imports", F.array().cast("array<string>")), made)
    return _newest(spark, d, "imports").select("repo", "path", specifiers.alias("_s")).select("repo", "path", F.posexplode("_s").alias("ord", "specifier"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return build_edges(_listed_imports(spark, d), _newest(spark, d), REPO)


def _index(spark: SparkSession, d: str) -> Index:
    """An index whose chunks are the candidates, one corpus a repo."""
    chunks = _candidates(spark, d)
    forward = staged(bm25.forward_index(chunks, REPO), "forward")
    postings = bm25.postings(forward, REPO)
    files = _newest(spark, d)
    return Index(
        files=files, symbols=files, imports=files, chunks=chunks.drop("text").join(forward.select("chunk_id", "doc_len"), "chunk_id"), postings=postings,
        terms=bm25.term_df(postings, REPO), corpus=bm25.corpus_stats(forward, REPO), edges=_edges(spark, d), keys=REPO,
    )


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "task_run").select("task_id", "repo", "task", F.coalesce("top_n", F.lit(ranking.DEFAULT_TOP)).alias("top_n"), "budget")


def _score(c: str = "score") -> Column:
    return F.round(F.col(c), 6).alias(c)


# Text ----------------------------------------------------------------------------------------------------------------


def tokenize_tf(spark: SparkSession, d: str) -> DataFrame:
    """Term frequencies of documents."""
    return bm25.postings(_documents(spark, d), []).select(F.col("chunk_id").alias("doc_id"), "term", "tf")


def token_doc_len(spark: SparkSession, d: str) -> DataFrame:
    """Terms of each document, 0 for documents without any."""
    return _documents(spark, d).select(F.col("chunk_id").alias("doc_id"), "doc_len")


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return bm25.corpus_stats(_documents(spark, d), []).select("n", F.round("avgdl", 6).alias("avgdl"))


def term_df_top(spark: SparkSession, d: str) -> DataFrame:
    """The 100 terms of most documents."""
    return bm25.term_df(bm25.postings(_documents(spark, d), []), []).orderBy(F.desc("df"), "term").limit(100)


def raw_token_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Raw words of candidates by length."""
    words = table(spark, d, "candidate").select(F.explode(X.raw_words(F.col("code"))).alias("w"))
    return words.groupBy(F.length("w").alias("length")).agg(F.count(F.lit(1)).alias("words"))


def identifier_split(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of each distinct symbol name, in order."""
    names = table(spark, d, "files").select(F.explode("symbols.name").alias("name")).where("name is not null").distinct()
    return names.select("name", F.array_join(X.identifier_parts(F.col("name")), " ").alias("parts"))


def line_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.line_count(F.col("text")).alias("lines"))


def line_slice(spark: SparkSession, d: str) -> DataFrame:
    """The lines of each candidate, read from its file; as a hash."""
    c = table(spark, d, "candidate").select("cand_id", "file_id", "start_line", "end_line").distinct()
    cut = sliced_texts(c, table(spark, d, "file_text").select("file_id", F.col("content").alias("text")), ["file_id"])
    return c.join(cut, ["file_id", "start_line", "end_line"]).select("cand_id", X.content_hash(F.col("text")).alias("hash"))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_text").select("file_id", X.content_hash(F.col("content")).alias("hash"))


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidate").where("code is not null").select("cand_id", X.token_estimate(F.col("code")).alias("tokens"))


def numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of each candidate with their numbers; as a hash."""
    c = table(spark, d, "candidate").where("code is not null and start_line is not null").select("cand_id", "start_line", "code").distinct()
    return c.select("cand_id", X.content_hash(X.numbered_lines(F.col("code"), F.col("start_line"))).alias("hash"))


# Filters -------------------------------------------------------------------------------------------------------------


def lang_detect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("file_id", detect_lang(F.col("path")).alias("lang"))


def source_priorities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("file_id", source_priority(F.col("path")).alias("priority"))


def ignore_filter(spark: SparkSession, d: str) -> DataFrame:
    """Files that an ignore list leaves."""
    return table(spark, d, "files").where(~ignored(F.col("path"), parse_ignore(IGNORE))).select("file_id")


def binary_size_filter(spark: SparkSession, d: str) -> DataFrame:
    """Files of text extensions up to a size."""
    ext = F.lower(F.regexp_extract(basename(F.col("path")), r"(?<=.)\.[^.]*$", 0))
    return table(spark, d, "files").where(~ext.isin(*sorted(BINARY_EXTENSIONS)) & (F.col("size") <= MAX_SIZE)).select("file_id")


def subtree_files(spark: SparkSession, d: str) -> DataFrame:
    """Files at or under one directory."""
    return table(spark, d, "files").where((F.col("path") == "src") | F.col("path").startswith("src/")).select("file_id")


def posix_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths written with backslashes and a dot in front, as the tools take them."""
    written = F.concat(F.lit(".\\"), F.translate("path", "/", "\\"))
    return table(spark, d, "files").select("file_id", to_posix(written).alias("path"))


def file_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of all paths in order, as one corpus."""
    paths = table(spark, d, "files").where("path is not null").select("path").distinct()
    return numbered(paths, "path", "file_index")


# Symbols, imports and chunks -----------------------------------------------------------------------------------------


def _file_lines(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "files").select("file_id", "path").join(spread(table(spark, d, "file_text"), "file_id"), "file_id")
    return both.select("file_id", detect_lang(F.col("path")).alias("lang"), F.col("content").alias("text"))


def symbol_extract(spark: SparkSession, d: str) -> DataFrame:
    """Declarations of all files, with the lines they span."""
    return extract_symbols(_file_lines(spark, d), ["file_id"]).select("file_id", "name", "kind", "line", "end_line")


def import_extract(spark: SparkSession, d: str) -> DataFrame:
    return extract_imports(_file_lines(spark, d), ["file_id"])


def chunk_windows_60(spark: SparkSession, d: str, size: int = 60) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", X.line_count(F.col("text")).alias("lines"))
    none = docs.select("doc_id", F.lit("").alias("name"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("end_line")).where("false")
    return chunk_ranges(docs, none, ["doc_id"], size).select("doc_id", "chunk_index", "start_line", "end_line")


def chunk_windows_4(spark: SparkSession, d: str) -> DataFrame:
    return chunk_windows_60(spark, d, 4)


def chunk_with_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all files by their listed symbols."""
    files = table(spark, d, "files")
    sized = files.select("file_id", F.col("n_lines").alias("lines"))
    return chunk_ranges(sized, files.select("file_id", F.inline("symbols")), ["file_id"]).select("file_id", "chunk_index", "start_line", "end_line", "symbol")


def index_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the index built from the texts."""
    index = build_index(_texts(spark, d), REPO, keep=staged)
    return index.chunks.select("repo", "path", "chunk_index", "start_line", "end_line", "symbol", "doc_len")


def index_summary(spark: SparkSession, d: str) -> DataFrame:
    """Files, chunks and mean chunk length of each repo's index."""
    index = build_index(_texts(spark, d), REPO, keep=staged)
    files = index.files.groupBy("repo").agg(F.count(F.lit(1)).alias("files"))
    return files.join(index.corpus, "repo").select("repo", "files", F.col("n").alias("chunks"), F.round("avgdl", 6).alias("avgdl"))


# Graph ---------------------------------------------------------------------------------------------------------------


def path_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Where relative imports point."""
    i = _listed_imports(spark, d).where("specifier like '.%'")
    return i.select("repo", "path", "ord", normalized(F.concat(dirname(F.col("path")), F.lit("/"), F.col("specifier"))).alias("target"))


def import_resolve(spark: SparkSession, d: str) -> DataFrame:
    return resolve_imports(_listed_imports(spark, d), _newest(spark, d), REPO)


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


def _around(spark: SparkSession, d: str, depth: int) -> DataFrame:
    starts = _newest(spark, d).select("repo", F.col("path").alias("start"))
    return neighbors(_edges(spark, d), starts, REPO, depth).select("repo", "start", "direction", "path", "hops")


def neighbors_depth1(spark: SparkSession, d: str) -> DataFrame:
    return _around(spark, d, 1)


def neighbors_depth2(spark: SparkSession, d: str) -> DataFrame:
    return _around(spark, d, 2)


def neighbors_depth5(spark: SparkSession, d: str) -> DataFrame:
    return _around(spark, d, 5)


# Scores and ranks ----------------------------------------------------------------------------------------------------


def postings_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency, in its repo, of each term of each task."""
    index = _index(spark, d)
    terms = bm25.query_terms(_tasks(spark, d), REPO)
    return terms.join(index.terms, ["repo", "term"]).select("task_id", "term", "q_count", "df")


def _bm25(spark: SparkSession, d: str, tasks: DataFrame, **params: float) -> DataFrame:
    i = _index(spark, d)
    scores = bm25.bm25_scores(bm25.query_terms(tasks, REPO), i.postings, i.terms, i.chunks, i.corpus, REPO, **params)
    return scores.select("task_id", "chunk_id", _score())


def bm25_score(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, _tasks(spark, d))


def bm25_params(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, _tasks(spark, d), k1=1.2, b=0.5)


def bm25_dup_terms(spark: SparkSession, d: str) -> DataFrame:
    """Repeated task words weigh as often as they occur."""
    return _bm25(spark, d, _tasks(spark, d).withColumn("task", F.concat_ws(" ", "task", "task")))


def symbol_boost(spark: SparkSession, d: str) -> DataFrame:
    """Scores with the boost for matching symbols."""
    scored = ranking.score_chunks(_index(spark, d), _tasks(spark, d))
    return scored.select("task_id", "chunk_id", F.size("matched").alias("matches"), _score())


def graph_boost(spark: SparkSession, d: str) -> DataFrame:
    """Files next to the seeds of each task, and the seed file that reaches each first."""
    i = _index(spark, d)
    return ranking.graph_sources(ranking.score_chunks(i, _tasks(spark, d)), i.edges, REPO)


def rank_full(spark: SparkSession, d: str) -> DataFrame:
    """The best chunks of each task, as many as it asks for."""
    ranked = ranking.rank_tasks(_index(spark, d), _tasks(spark, d), top=F.col("top_n"))
    return ranked.select("task_id", "rank", "chunk_id", _score(), F.size("matched").alias("matches"), "graph_source", "priority")


def rank_with_tests(spark: SparkSession, d: str) -> DataFrame:
    """The same with tests and fixtures at full weight."""
    ranked = ranking.rank_tasks(_index(spark, d), _tasks(spark, d), top=F.col("top_n"), include_tests=True)
    return ranked.select("task_id", "rank", "chunk_id", _score())


def rank_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why each of the best chunks ranks where it does."""
    ranked = ranking.rank_tasks(_index(spark, d), _tasks(spark, d), top=F.col("top_n"))
    return ranked.select("task_id", "rank", F.array_join(ranking.reasons_col(), " ").alias("reasons"))


# Packs ---------------------------------------------------------------------------------------------------------------


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Recorded results, each once."""
    return table(spark, d, "rank_result").select("task_id", "pos", "cand_id", F.col("file").alias("path"), "start_line", "end_line").distinct()


def fit_budget(spark: SparkSession, d: str) -> DataFrame:
    """The recorded results of each task that fit its budget."""
    sizes = table(spark, d, "candidate").where("code is not null").select("cand_id", X.token_estimate(F.col("code")).alias("size")).distinct()
    items = _results(spark, d).join(sizes, "cand_id").join(_tasks(spark, d).select("task_id", "budget"), "task_id")
    return fit_to_budget(items, ["task_id"], ["pos"], "size", F.col("budget")).select("task_id", "pos", "used", "included")


def range_subtract(spark: SparkSession, d: str) -> DataFrame:
    """Lines that each recorded result adds to those before it, windows widened by ten lines so that they overlap."""
    wide = _results(spark, d).select("task_id", "path", "pos", F.greatest(F.lit(1), F.col("start_line") - 10).alias("start_line"), (F.col("end_line") + 10).alias("end_line"))
    return subtract_covered(wide, ["task_id", "path"], "pos").withColumnRenamed("rank", "pos")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    ranked = ranking.rank_tasks(_index(spark, d), _tasks(spark, d), top=F.col("top_n"))
    rows = packing.pack_rows(ranked, _texts(spark, d), REPO, float("1e18"))
    return fit_to_budget(rows.drop("used", "included").join(_tasks(spark, d).select("task_id", "budget"), "task_id"), ["task_id"], ["rank", "start_line"], "tokens", F.col("budget"))


def pack_included(spark: SparkSession, d: str) -> DataFrame:
    """What the pack of each task holds within its budget."""
    return _packed(spark, d).where("included").select("task_id", "rank", "path", "start_line", "end_line", "tokens", "used")


def pack_trimmed(spark: SparkSession, d: str) -> DataFrame:
    """Files that the pack of each task lost in whole or in part."""
    return packing.trimmed_files(_packed(spark, d)).select("task_id", "path", "fully", "pos")


def pack_text(spark: SparkSession, d: str) -> DataFrame:
    """The pack of each task as Markdown."""
    files = _newest(spark, d).withColumn("lang", detect_lang(F.col("path")))
    return packing.pack_texts(_packed(spark, d), table(spark, d, "task_run").select("task_id", "repo", "task", "budget"), files, REPO)


# Outlines ------------------------------------------------------------------------------------------------------------


def outline_tree(spark: SparkSession, d: str) -> DataFrame:
    """The tree of each repo, its lines numbered."""
    files = _newest(spark, d, "symbols")
    symbols = files.select("repo", "path", F.posexplode("symbols").alias("ord", "_s")).select("repo", "path", "ord", "_s.*")
    rows = outline_rows(files, symbols, REPO)
    n = F.row_number().over(W.partitionBy("repo").orderBy("sort_key"))
    return rows.select("repo", n.alias("pos"), "depth", "line")


def lang_statistics(spark: SparkSession, d: str) -> DataFrame:
    return lang_stats(_newest(spark, d).withColumn("lang", detect_lang(F.col("path"))), REPO)


def outline_files(spark: SparkSession, d: str) -> DataFrame:
    """The symbols of each file as its outline shows them."""
    symbols = _newest(spark, d, "symbols").select("repo", "path", F.posexplode("symbols").alias("ord", "_s")).select("repo", "path", "ord", "_s.*")
    return file_outlines(symbols, REPO)


# Sources and refresh -------------------------------------------------------------------------------------------------


def tree_scan(spark: SparkSession, d: str) -> DataFrame:
    """The engine's own source tree, through the tree scanner."""
    here = os.path.dirname(os.path.abspath(__file__))
    return scan_tree(spark, here).where("path like '%.py'").select("path", "size")


def rescans(spark: SparkSession, d: str) -> DataFrame:
    """What changed between the scans before 2024 and the last scan of each path."""
    last = W.partitionBy("repo", "path").orderBy(F.desc("indexed_at"), F.desc("file_id"))
    old = table(spark, d, "files").where("indexed_at < timestamp'2024-01-01'").withColumn("_n", F.row_number().over(last)).where("_n = 1").select("repo", "path", "hash")
    return changed_files(old, _newest(spark, d, "hash"), REPO)


_ALL: list[Callable[[SparkSession, str], DataFrame]] = [
    tokenize_tf, token_doc_len, corpus_stats, term_df_top, raw_token_lengths, identifier_split, line_counts, line_slice, content_hash, token_estimate, lang_detect,
    numbered_lines, posix_paths, file_numbers, source_priorities, ignore_filter, binary_size_filter, subtree_files, symbol_extract, import_extract, chunk_windows_60, chunk_windows_4, chunk_with_symbols, index_chunks,
    index_summary, path_normalize, import_resolve, graph_edges, neighbors_depth1, neighbors_depth2, neighbors_depth5, postings_lookup, bm25_score, bm25_params, bm25_dup_terms, symbol_boost,
    graph_boost, rank_full, rank_with_tests, rank_reasons, fit_budget, range_subtract, pack_included, pack_trimmed, pack_text, outline_tree, outline_files, lang_statistics, tree_scan, rescans,
]
QUERIES = {f.__name__: f for f in _ALL}

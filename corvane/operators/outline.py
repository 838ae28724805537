"""Outlines: a tree of directories and files with their symbols, and statistics by language."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from corvane.plans.index import Index


def symbol_summaries(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, path, summary): ``kind name`` of a file's symbols, in order."""
    rows = F.array_sort(F.collect_list(F.struct("ord", F.concat_ws(" ", "kind", "name").alias("s"))))
    return symbols.groupBy(*keys, "path").agg(F.array_join(F.transform(rows, lambda r: r["s"]), ", ").alias("summary"))


def outline_rows(files: DataFrame, symbols: DataFrame, keys: list[str], directory: str | None = None) -> DataFrame:
    """(keys…, sort_key, depth, line): the lines of the tree; order by ``sort_key`` within the keys.

    Directories come before files at each level, both by name; each level is indented by two spaces.  ``directory``
    limits the tree to the files at or under it.
    """
    f = files.select(*keys, "path")
    if directory:
        d = directory.rstrip("/")
        f = f.where((F.col("path") == d) | F.col("path").startswith(f"{d}/"))
    full = f.join(symbol_summaries(symbols, keys), [*keys, "path"], "left")
    parts = F.split("path", "/")
    n = F.size(parts)

    def key(upto: F.Column, last_is_file: bool) -> F.Column:
        shown = F.slice(parts, 1, upto)
        return F.transform(shown, lambda p, i: F.concat(F.when((i == upto - 1) & F.lit(last_is_file), F.lit("1")).otherwise(F.lit("0")), p))

    leaf = full.select(
        *keys,
        key(n, True).alias("sort_key"),
        (n - 1).alias("depth"),
        F.concat(F.element_at(parts, -1), F.when(F.col("summary").isNotNull(), F.concat(F.lit(" ("), F.col("summary"), F.lit(")"))).otherwise(F.lit(""))).alias("_text"),
    )
    level = f.where(n > 1).select(*keys, parts.alias("_p"), F.explode(F.sequence(F.lit(1), n - 1)).alias("_k"))
    dirs = level.select(
        *keys,
        F.transform(F.slice("_p", 1, F.col("_k")), lambda p: F.concat(F.lit("0"), p)).alias("sort_key"),
        (F.col("_k") - 1).alias("depth"),
        F.concat(F.element_at("_p", F.col("_k")), F.lit("/")).alias("_text"),
    ).distinct()
    return leaf.unionByName(dirs).select(*keys, "sort_key", "depth", F.concat(F.repeat(F.lit("  "), F.col("depth")), "_text").alias("line"))


def outline_repo(index: Index, directory: str | None = None) -> str:
    """The tree of a single corpus as text; a line that says so if nothing lies under ``directory``."""
    rows = outline_rows(index.files, index.symbols, [], directory).orderBy("sort_key").collect()
    if not rows and directory:
        return f"(no files under {directory.rstrip('/')})"
    return "\n".join(r["line"] for r in rows)


def file_outlines(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, path, ord, line): a line for each symbol of a file, in order."""
    span = F.concat(F.lit("  (L"), F.col("line").cast("string"), F.lit("-L"), F.col("end_line").cast("string"), F.lit(")"))
    return symbols.select(*keys, "path", "ord", F.concat(F.lit("  "), F.col("kind"), F.lit(" "), F.col("name"), span).alias("line"))


def outline_file(index: Index, path: str) -> str | None:
    """A file and its symbols with their lines, or None if it isn't indexed."""
    if not index.files.where(F.col("path") == path).limit(1).count():
        return None
    rows = file_outlines(index.symbols.where(F.col("path") == path), []).orderBy("ord").collect()
    return "\n".join([path, *(r["line"] for r in rows)])


def lang_stats(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, lang, files)."""
    return files.groupBy(*keys, "lang").agg(F.count(F.lit(1)).alias("files"))

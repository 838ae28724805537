"""The engine on a source tree: build, query, pack, outline, neighbours and statistics."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.config import Config, load_config
from corvane.durable import staged, staging
from corvane.operators import outline
from corvane.operators.graph import neighbors as graph_neighbors
from corvane.plans import pack as packing
from corvane.plans import ranking
from corvane.plans.index import Index, build_index
from corvane.sources.scan import safe_resolve, scan_tree
from corvane.sources.store import load_index, load_meta, load_texts, save_index


class NoIndex(RuntimeError):
    """A tree that has not been indexed."""


def session() -> SparkSession:
    """The running session, or a local one."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    return (
        SparkSession.builder.appName("corvane")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


class Engine:
    """One source tree and its index.  The index is read anew when another one has been saved."""

    def __init__(self, root: str | Path, spark: SparkSession | None = None):
        self.root = Path(root).resolve()
        self.spark = spark or session()
        self.config: Config = load_config(self.root)
        self._index: Index | None = None
        self._texts: DataFrame | None = None
        self._stamp: str | None = None

    def build(self, *, save: bool = True) -> Index:
        """Scan and index the tree; unless ``save`` is off, persist the index and use the persisted tables."""
        if save:
            with staging(self.spark):
                texts, index = self._built()
                save_index(self.root, index, texts)
            self._stamp = None
            return self.index
        self._texts, self._index = self._built()
        return self._index

    def _built(self) -> tuple[DataFrame, Index]:
        texts = staged(scan_tree(self.spark, self.root, self.config.max_file_size), "texts")
        return texts, build_index(texts, max_lines=self.config.chunk_max_lines, keep=staged)

    def build_if_missing(self) -> Index:
        return self.index if self._index is not None or load_meta(self.root, self.spark) is not None else self.build()

    @property
    def index(self) -> Index:
        meta = load_meta(self.root, self.spark)
        if meta is None:
            if self._index is None:
                raise NoIndex("This tree has no index yet; `corvane index` builds it.")
            return self._index
        if meta["folder"] != self._stamp:
            self._index, self._texts, self._stamp = load_index(self.spark, self.root), load_texts(self.spark, self.root), meta["folder"]
        return self._index

    @property
    def texts(self) -> DataFrame:
        self.index  # noqa: B018 - reads the texts that belong to the index
        return self._texts

    def query(self, task: str, *, top: int | None = None, include_tests: bool = False) -> list[ranking.Result]:
        with staging(self.spark):
            return ranking.rank(self.index, task, top=ranking.DEFAULT_TOP if top is None else top, include_tests=include_tests)

    def pack(self, task: str, *, budget: float | None = None, top: int | None = None, include_tests: bool = False) -> packing.Bundle:
        limit = self.config.budget if budget is None else budget
        with staging(self.spark):
            return packing.pack(self.index, self.texts, task, budget=limit, top=ranking.DEFAULT_TOP if top is None else top, include_tests=include_tests)

    def outline_file(self, path: str) -> str | None:
        return outline.outline_file(self.index, path)

    def outline_tree(self, directory: str | None = None) -> str:
        return outline.outline_repo(self.index, directory)

    def neighbors(self, path: str, depth: int = 1) -> dict[str, list[str]]:
        start = self.spark.range(1).select(F.lit(path).alias("start"))
        with staging(self.spark):
            rows = graph_neighbors(self.index.edges, start, [], depth).orderBy("direction", "pos").collect()
        return {d: [r["path"] for r in rows if r["direction"] == d] for d in ("imports", "imported_by")}

    def read(self, path: str, start: int | None = None, end: int | None = None, symbol: str | None = None) -> str:
        """Numbered lines of a file, by range or by the first symbol of a name."""
        if symbol:
            if not self.index.files.where(F.col("path") == path).limit(1).count():
                raise ValueError(f"not an indexed file: {path}")
            found = self.index.symbols.where((F.col("path") == path) & (F.col("name") == symbol)).orderBy("ord").limit(1).collect()
            if not found:
                raise ValueError(f'{path} declares no "{symbol}"')
            start, end = found[0]["line"], found[0]["end_line"]
        rows = safe_resolve(self.root, path).read_text("utf-8", "replace").split("\n")
        first = 1 if start is None else start
        last = len(rows) if end is None else end
        kept = rows[max(1, first) - 1 : max(0, min(last, len(rows)))] if first <= last else []
        if not kept or kept == [""] and len(kept) == 1:
            return ""
        return "\n".join(f"{first + i}: {row}" for i, row in enumerate(kept))

    def stats(self) -> tuple[int, int, list[tuple[str, int]]]:
        """Files, chunks, and files by language, most first."""
        langs = outline.lang_stats(self.index.files, []).orderBy(F.desc("files"), "lang").collect()
        return sum(r["files"] for r in langs), self.index.chunks.count(), [(r["lang"], r["files"]) for r in langs]


def query(root: str | Path, task: str, *, top: int | None = None, include_tests: bool = False) -> list[ranking.Result]:
    """The best chunks of an indexed tree for a task."""
    return Engine(root).query(task, top=top, include_tests=include_tests)


__all__ = ["Engine", "NoIndex", "query", "session"]

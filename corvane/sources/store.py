"""Persisting an index: Parquet tables in a folder of their own, to which a pointer file is switched; and a JSON document.

Everything goes through Hadoop's file systems, so the index may lie wherever Spark can write: a root without a
scheme is a folder of this machine, any other is taken as it stands.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from corvane.config import HOME
from corvane.plans.index import Index

VERSION = 1
POINTER = "current"
TABLES = ("files", "symbols", "imports", "chunks", "postings", "terms", "corpus", "edges")


class Folder:
    """The engine's folder under a root, on any file system."""

    def __init__(self, root: str | Path, spark: SparkSession):
        base = str(root) if "://" in str(root) else f"file://{Path(root).resolve()}"
        self.spark, self.base = spark, f"{base.rstrip('/')}/{HOME}"
        self._jvm = spark.sparkContext._jvm
        self._configuration = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._configuration)

    def _path(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def url(self, name: str) -> str:
        return f"{self.base}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self) -> list[str]:
        return [f.getPath().getName() for f in self._fs.listStatus(self._path(""))] if self._fs.exists(self._path("")) else []

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Readers see the file as it was or as it is now."""
        new = f"{name}.tmp-{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(new), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._configuration).rename(self._path(new), self._path(name), options)


def save_index(root: str | Path, index: Index, texts: DataFrame | None = None) -> str:
    """Write the tables to a new folder, then switch the pointer to it; readers see the old index or the new.

    The index before stays for those that still read it; older ones go.
    """
    spark = index.chunks.sparkSession
    home = Folder(root, spark)
    version = f"index-{uuid.uuid4().hex}"
    try:
        tables = index.tables() | ({"texts": texts.select(*index.keys, "path", "text")} if texts is not None else {})
        for name, df in tables.items():
            # Postings sorted by term: a query's terms then prune row groups.
            out = df.sortWithinPartitions("term") if name in ("postings", "terms") else df
            out.write.parquet(home.url(f"{version}/{name}"))
        counts = {n: spark.read.parquet(home.url(f"{version}/{t}")).count() for n, t in (("fileCount", "files"), ("chunkCount", "chunks"))}
        shown = str(root) if "://" in str(root) else str(Path(root).resolve())
        meta = {"version": VERSION, "root": shown, "createdAt": int(datetime.now(timezone.utc).timestamp() * 1000), "keys": index.keys} | counts
        home.write(f"{version}/meta.json", json.dumps(meta))
        before = home.read(POINTER)
        home.write(POINTER, version)
    except BaseException:
        home.remove(version)
        raise
    for name in home.names():
        if name.startswith("index-") and name not in (version, before):
            home.remove(name)
    return home.url(version)


def _current(home: Folder) -> str | None:
    version = home.read(POINTER)
    return version.strip() if version else None


def _parsed(text: str, shown: str) -> Any:
    try:
        return json.loads(text)
    except ValueError as e:
        raise ValueError(f"invalid JSON in {HOME}/{shown}: {e}") from e


def load_meta(root: str | Path, spark: SparkSession) -> dict[str, Any] | None:
    """What is known of the persisted index, ``folder`` among it; None if there is none."""
    home = Folder(root, spark)
    version = _current(home)
    text = home.read(f"{version}/meta.json") if version else None
    return None if text is None else _parsed(text, f"{version}/meta.json") | {"folder": home.url(version)}


def load_index(spark: SparkSession, root: str | Path) -> Index | None:
    """The persisted index, or None if there is none."""
    meta = load_meta(root, spark)
    if meta is None:
        return None
    return Index(**{n: spark.read.parquet(f"{meta['folder']}/{n}") for n in TABLES}, keys=meta["keys"])


def load_texts(spark: SparkSession, root: str | Path) -> DataFrame | None:
    home = Folder(root, spark)
    version = _current(home)
    return spark.read.parquet(home.url(f"{version}/texts")) if version and home.exists(f"{version}/texts") else None


def index_document(index: Index, meta: dict[str, Any]) -> dict[str, Any]:
    """The index of a single corpus as one nested document: files with their symbols, imports and chunks; postings by
    term; lengths and places by chunk; the graph by file.  For exchange; it holds the whole index in memory."""

    def rows(df: DataFrame, *order: str) -> list:
        return df.orderBy(*order).collect()

    files: dict[str, dict] = {}
    for r in rows(index.files, "path"):
        files[r["path"]] = {"path": r["path"], "lang": r["lang"], "size": r["size"], "lines": r["lines"], "hash": r["hash"], "symbols": [], "imports": [], "chunks": []}
    for r in rows(index.symbols, "path", "ord"):
        files[r["path"]]["symbols"].append({"name": r["name"], "kind": r["kind"], "line": r["line"], "endLine": r["end_line"]})
    for r in rows(index.imports, "path", "ord"):
        files[r["path"]]["imports"].append(r["specifier"])
    lengths: dict[str, int] = {}
    places: dict[str, dict] = {}
    for r in rows(index.chunks, "file_index", "chunk_index"):
        files[r["path"]]["chunks"].append({"id": r["chunk_id"], "startLine": r["start_line"], "endLine": r["end_line"], "symbol": r["symbol"]})
        lengths[r["chunk_id"]] = r["doc_len"]
        places[r["chunk_id"]] = {"file": r["path"], "startLine": r["start_line"], "endLine": r["end_line"], "symbol": r["symbol"]}
    postings: dict[str, list] = {}
    for r in rows(index.postings, "term", "chunk_id"):
        postings.setdefault(r["term"], []).append([r["chunk_id"], r["tf"]])
    graph: dict[str, dict[str, list]] = {"out": {}, "in": {}}
    for r in rows(index.edges, "src", "out_pos"):
        graph["out"].setdefault(r["src"], []).append(r["dst"])
    for r in rows(index.edges, "dst", "in_pos"):
        graph["in"].setdefault(r["dst"], []).append(r["src"])
    corpus = index.corpus.first()
    return {
        "version": VERSION, "root": meta["root"], "createdAt": meta["createdAt"], "fileCount": len(files), "chunkCount": len(places), "files": list(files.values()),
        "bm25": {
            "N": corpus["n"] if corpus else 0, "avgdl": corpus["avgdl"] if corpus else 0.0, "df": {r["term"]: r["df"] for r in rows(index.terms, "term")},
            "postings": postings, "docLen": lengths, "chunkMeta": places,
        },
        "graph": graph,
    }


def export_json(root: str | Path, index: Index) -> str:
    """Write the nested document, atomically, as ``index.json``."""
    spark = index.chunks.sparkSession
    meta = load_meta(root, spark) or {"root": str(root), "createdAt": int(datetime.now(timezone.utc).timestamp() * 1000)}
    home = Folder(root, spark)
    home.write("index.json", json.dumps(index_document(index, meta), indent=2, ensure_ascii=False))
    return home.url("index.json")


def import_json(spark: SparkSession, root: str | Path) -> Index | None:
    """The index of the nested document ``index.json``, None if there is none; it is read on the driver, as it was written."""
    text = Folder(root, spark).read("index.json")
    return None if text is None else index_of_document(spark, _parsed(text, "index.json"))


def index_of_document(spark: SparkSession, doc: dict[str, Any]) -> Index:
    """The tables of a nested document, the inverse of ``index_document``."""
    bm25, graph = doc["bm25"], doc["graph"]
    files, symbols, imports, chunks = [], [], [], []
    for n, f in enumerate(doc["files"]):
        files.append((f["path"], n, f["lang"], f["size"], f["lines"], f["hash"]))
        symbols += [(f["path"], i, s["name"], s["kind"], s["line"], s["endLine"]) for i, s in enumerate(f["symbols"])]
        imports += [(f["path"], i, s) for i, s in enumerate(f["imports"])]
        chunks += [(c["id"], f["path"], n, i, c["startLine"], c["endLine"], c["symbol"], bm25["docLen"].get(c["id"], 0)) for i, c in enumerate(f["chunks"])]
    importers = {dst: {src: i for i, src in enumerate(srcs)} for dst, srcs in graph["in"].items()}
    edges = [(src, dst, i, importers.get(dst, {}).get(src)) for src, dsts in graph["out"].items() for i, dst in enumerate(dsts)]
    tables = {
        "files": (files, "path string, file_index int, lang string, size long, lines int, hash string"),
        "symbols": (symbols, "path string, ord int, name string, kind string, line int, end_line int"),
        "imports": (imports, "path string, ord int, specifier string"),
        "chunks": (chunks, "chunk_id string, path string, file_index int, chunk_index int, start_line int, end_line int, symbol string, doc_len int"),
        "postings": ([(c, t, n) for t, listed in bm25["postings"].items() for c, n in listed], "chunk_id string, term string, tf int"),
        "terms": (list(bm25["df"].items()), "term string, df long"),
        "corpus": ([(bm25["N"], float(bm25["avgdl"]))], "n long, avgdl double"),
        "edges": (edges, "src string, dst string, out_pos int, in_pos int"),
    }
    return Index(**{name: spark.createDataFrame(rows, schema) for name, (rows, schema) in tables.items()}, keys=[])


def results_json(rows: list) -> str:
    """Ranked results as a JSON array."""
    return json.dumps(
        [{"file": r.file, "startLine": r.start_line, "endLine": r.end_line, "symbol": r.symbol, "score": r.score, "reasons": r.reasons} for r in rows], indent=2, ensure_ascii=False
    )


__all__ = ["Folder", "export_json", "import_json", "index_document", "index_of_document", "load_index", "load_meta", "load_texts", "results_json", "save_index"]

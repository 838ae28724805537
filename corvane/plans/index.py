"""From texts to an index: files, symbols, imports, chunks, postings, statistics and edges as tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.durable import staged
from corvane.functions.lang import detect_lang
from corvane.functions.textops import content_hash, tokenize
from corvane.operators import bm25
from corvane.operators.chunking import DEFAULT_MAX_LINES, ranges_of
from corvane.operators.graph import build_edges
from corvane.operators.imports import imports_of
from corvane.operators.symbols import symbols_of


@dataclass
class Index:
    """The tables of an index.  ``keys`` separate corpora; a single tree has none."""

    files: DataFrame  # keys…, path, file_index, lang, size, lines, hash
    symbols: DataFrame  # keys…, path, ord, name, kind, line, end_line
    imports: DataFrame  # keys…, path, ord, specifier
    chunks: DataFrame  # keys…, chunk_id, path, file_index, chunk_index, start_line, end_line, symbol, doc_len
    postings: DataFrame  # keys…, chunk_id, term, tf
    terms: DataFrame  # keys…, term, df
    corpus: DataFrame  # keys…, n, avgdl
    edges: DataFrame  # keys…, src, dst, out_pos, in_pos
    keys: list[str]

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "keys"}

    def cached(self) -> Index:
        """The index with its tables kept, in memory where there is room."""
        return Index(**{k: t.persist(StorageLevel.MEMORY_AND_DISK) for k, t in self.tables().items()}, keys=self.keys)


_ANALYSED = {
    "lines": (pa.int32(), "int"),
    "symbols": (pa.list_(pa.struct([("ord", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("end_line", pa.int32())])),
                "array<struct<ord:int,name:string,kind:string,line:int,end_line:int>>"),
    "imports": (pa.list_(pa.string()), "array<string>"),
    "chunks": (pa.list_(pa.struct([("chunk_index", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("symbol", pa.string()), ("doc_len", pa.int32()),
                                   ("terms", pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())])))])),
               "array<struct<chunk_index:int,start_line:int,end_line:int,symbol:string,doc_len:int,terms:array<struct<term:string,tf:int>>>>"),
}


def _analyse(max_lines: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines, symbols, imports and chunks with their terms of each text, in one pass over its lines; ``lang`` and ``text`` come last."""
    lines_type, symbols_type, imports_type, chunks_type = (t for t, _ in _ANALYSED.values())
    chunk_type = chunks_type.value_type
    terms_type = chunk_type.field("terms").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines: list[int] = []
            imports: list[list[str]] = []
            symbols: list[tuple] = []
            symbol_ends, chunk_ends, term_ends = [0], [0], [0]
            chunks: list[tuple] = []
            terms: list[str] = []
            counts: list[int] = []
            for lang, text in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                rows = text.split("\n")
                n_lines.append(len(rows))
                found = symbols_of(text, lang, rows)
                symbols += [(i, *s) for i, s in enumerate(found)]
                symbol_ends.append(len(symbols))
                imports.append(imports_of(text, lang))
                for i, (a, b, name) in enumerate(ranges_of(len(rows), [(s[0], s[2], s[3]) for s in found], max_lines)):
                    words = tokenize("\n".join(rows[a - 1 : b]))
                    tf = Counter(words)
                    terms += tf.keys()
                    counts += tf.values()
                    term_ends.append(len(terms))
                    chunks.append((i, a, b, name, len(words)))
                chunk_ends.append(len(chunks))
            listed = pa.ListArray.from_arrays(pa.array(term_ends, pa.int32()), pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int32())], fields=list(terms_type.value_type)))
            flat = [pa.array(c, f.type) for c, f in zip(list(zip(*chunks)) or [()] * 5, chunk_type)]
            flat_symbols = [pa.array(c, f.type) for c, f in zip(list(zip(*symbols)) or [()] * 5, symbols_type.value_type)]
            new = [
                pa.array(n_lines, lines_type),
                pa.ListArray.from_arrays(pa.array(symbol_ends, pa.int32()), pa.StructArray.from_arrays(flat_symbols, fields=list(symbols_type.value_type))),
                pa.array(imports, imports_type),
                pa.ListArray.from_arrays(pa.array(chunk_ends, pa.int32()), pa.StructArray.from_arrays([*flat, listed], fields=list(chunk_type))),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*batch.schema.names[:-1], *_ANALYSED])

    return run


def build_index(
    texts: DataFrame, keys: list[str] | None = None, *, max_lines: float | None = DEFAULT_MAX_LINES, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df
) -> Index:
    """Index of (keys…, path, text[, lang][, size]); a path is unique within its keys, rows with null text are left out.

    One pass over each text, in its own row, gives all that the index holds of it, so texts are neither shuffled nor
    read again.  ``keep`` is applied to the table of that pass and to the numbers of the files; ``staged`` there computes
    each of them once.
    """
    keys = keys or []
    t = texts.where(F.col("text").isNotNull() & F.col("path").isNotNull())
    if "lang" not in t.columns:
        t = t.withColumn("lang", detect_lang(F.col("path")))
    if "size" not in t.columns:
        t = t.withColumn("size", F.octet_length("text").cast("long"))
    t = t.select(*keys, "path", "size", content_hash(F.col("text")).alias("hash"), "lang", "text")
    passed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.schema.fields if f.name != "text")
    analysed = keep(t.mapInArrow(_analyse(max_lines), f"{passed}, " + ", ".join(f"{n} {ddl}" for n, (_, ddl) in _ANALYSED.items())), "analysed")
    base = analysed.select(*keys, "path", "lang", "size", "lines", "hash")
    if keys:
        position = F.row_number().over(W.partitionBy(*keys).orderBy("path")) - 1
        files = base.withColumn("file_index", position)
    else:  # one corpus: number the paths by range partition, not in one window
        files = numbered(base, "path", "file_index")
    files = keep(files, "files")
    name = F.concat_ws(":", *keys, "file_index", "chunk_index") if keys else F.concat_ws(":", "file_index", "chunk_index")
    chunks = analysed.select(*keys, "path", F.inline("chunks")).join(files.select(*keys, "path", "file_index"), [*keys, "path"]).withColumn("chunk_id", name)
    imports = analysed.select(*keys, "path", F.posexplode("imports").alias("ord", "specifier"))
    postings = bm25.postings(chunks.select(*keys, "chunk_id", "terms"), keys)
    return Index(
        files=files.select(*keys, "path", "file_index", "lang", "size", "lines", "hash"),
        symbols=analysed.select(*keys, "path", F.inline("symbols")),
        imports=imports,
        chunks=chunks.select(*keys, "chunk_id", "path", "file_index", "chunk_index", "start_line", "end_line", "symbol", "doc_len"),
        postings=postings,
        # Counted in the files' own rows: these need no numbers of files.
        terms=bm25.term_df(analysed.select(*keys, F.inline("chunks")).select(*keys, F.inline("terms")), keys),
        corpus=bm25.corpus_stats(analysed.select(*keys, F.explode("chunks.doc_len").alias("doc_len")), keys),
        edges=build_edges(imports, files, keys),
        keys=keys,
    )


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with its rank in ``order`` from 0: ranks within the ranges of a sort, shifted by the sizes of the ranges before."""
    ranged = staged(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranged")  # read twice, with one set of bounds
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    within = F.row_number().over(W.partitionBy("_part").orderBy(order)) - 1
    # As many rows as shuffle partitions.
    return ranged.withColumn("_within", within).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_within")).cast("int")).drop("_part", "_before", "_within")

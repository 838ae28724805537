"""The registered queries against their SQL on a small table folder."""

import importlib
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from corvane.queries import QUERIES
from corvane.queries_sql import SQL

D = "/root/testdata/sf0.001"
NAMES = [
    "tokenize_tf", "identifier_split", "token_estimate", "lang_detect", "source_priorities", "ignore_filter", "symbol_extract", "chunk_with_symbols", "graph_edges", "bm25_score", "rank_full", "pack_trimmed", "pack_text", "outline_tree", "outline_files", "rank_reasons",
    "import_extract", "numbered_lines", "posix_paths", "file_numbers", "neighbors_depth5", "tree_scan", "index_chunks", "line_slice",
]


def rows(columns, data):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple((v is not None, round(v, 6) if isinstance(v, float) else v) for v in (r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in "files file_text candidate task_run rank_result included_chunk documents".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = QUERIES[name](spark, D)
    want = con.execute(SQL[name])
    assert rows(df.columns, map(tuple, df.collect())) == rows([c[0] for c in want.description], want.fetchall())


def test_registry(spark):
    names = set(entry.queries())
    assert set(QUERIES) <= names and set(entry.oracle_sql()) <= names
    assert entry.entry(spark).count() > 0


def test_entry_without_the_subpackage(monkeypatch):
    real = importlib.import_module

    def missing(name, *a):
        if name.startswith("corvane.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name="corvane.llm")
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", missing)
    assert set(entry.queries()) == set(QUERIES)


def test_the_rest_works_with_the_subpackage_deleted(tmp_path):
    """A copy without the training-data operators and their tests registers and runs the engine's own queries."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(here, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache", ".hypothesis"))
    code = (
        "import __spark_entry__ as e; from pyspark.sql import SparkSession; from corvane.queries import QUERIES; assert set(e.queries()) == set(QUERIES); "
        f"print(e.queries()['lang_statistics'](SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(), '{D}').count())"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0 and int(out.stdout.split()[-1]) > 0, out.stderr[-2000:]

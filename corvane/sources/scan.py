"""A data source that scans a source tree: names, sizes and text of the files worth indexing.

Spark's own file listing hides names that start with ``.`` or ``_`` and follows
links; this one does neither.  The driver walks the tree once, pruning ignored
directories before it enters them and dropping files by name and size; the
contents are read, and sniffed for binary data, where the partitions run.

    spark.dataSource.register(TreeSource)
    spark.read.format("source_tree").option("maxFileSize", 1000000).load(root)
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvane.config import Config
from corvane.functions.paths import ALWAYS_PRUNED, ignore_regex, parse_ignore

# Extensions that are binary whatever they hold.
BINARY_EXTENSIONS = frozenset(
    ".png .jpg .jpeg .gif .bmp .webp .tiff .ico .pdf .zip .gz .bin .exe .wasm .woff .woff2 .ttf .otf .eot .mp4 .mp3 .mov .avi .webm .ogg .wav "
    ".flac .tar .7z .rar .jar .class .pyc .so .dylib .dll .o .a .node .db .sqlite .sqlite3".split()
)
SNIFFED_BYTES = 8192
PARTITION_BYTES = 32 << 20
SCHEMA = "path string, size long, text string"


class PathEscape(ValueError):
    """A path that leads out of its root."""


def safe_resolve(root: str | Path, relative: str) -> Path:
    """The file at ``relative`` under ``root``; links and ``..`` may not lead out of it."""
    base = Path(root).resolve()
    if os.path.isabs(relative):
        raise PathEscape(f"path escapes root: {relative}")
    target = Path(os.path.normpath(base / relative))
    for p in (target, target.resolve()):
        if p != base and base not in p.parents:
            raise PathEscape(f"path escapes root: {relative}")
    return target


def ignore_patterns(root: str | Path) -> list[str]:
    """Patterns of the ignore file at the root; none if there is no such file."""
    try:
        return parse_ignore(safe_resolve(root, ".gitignore").read_text("utf-8", "replace"))
    except FileNotFoundError:
        return []


def list_tree(root: str | Path, max_file_size: int = Config.max_file_size) -> list[tuple[str, int]]:
    """(path, size) of the candidate files, in path order."""
    base = str(root)
    left_out = re.compile(ignore_regex(ignore_patterns(root))).match
    found: list[tuple[str, int]] = []

    def visit(directory: str, prefix: str, top: bool) -> None:
        try:
            entries = list(os.scandir(directory))
        except OSError as e:
            if top:
                raise OSError(f"cannot read directory {directory}: {e}") from e
            return
        for entry in entries:
            path = prefix + entry.name
            if entry.is_symlink():
                continue
            if entry.is_dir(follow_symlinks=False):
                if entry.name not in ALWAYS_PRUNED and not left_out(path) and not left_out(path + "/"):
                    visit(entry.path, path + "/", False)
            elif entry.is_file(follow_symlinks=False) and not left_out(path) and os.path.splitext(entry.name)[1].lower() not in BINARY_EXTENSIONS:
                try:
                    size = entry.stat(follow_symlinks=False).st_size
                except OSError:
                    continue
                if size <= max_file_size:
                    found.append((path, size))

    visit(base, "", True)
    return sorted(found)


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(None)
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.max_file_size = int(options.get("maxFileSize", Config.max_file_size))

    def partitions(self) -> list[InputPartition]:
        out: list[_Files] = []
        room = 0
        for path, size in list_tree(self.root, self.max_file_size):
            if not out or size > room:
                out.append(_Files([]))
                room = PARTITION_BYTES
            out[-1].files.append((path, size))
            room -= size
        return out or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple[str, int, str]]:
        for path, size in partition.files:
            try:
                data = safe_resolve(self.root, path).read_bytes()
            except OSError:
                continue
            if b"\0" not in data[:SNIFFED_BYTES]:
                yield path, size, data.decode("utf-8", "replace")


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> _Reader:
        return _Reader(self.options)


def scan_tree(spark: SparkSession, root: str | Path, max_file_size: int = Config.max_file_size) -> DataFrame:
    """(path, size, text) of the files of a tree."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("source_tree").option("maxFileSize", max_file_size).load(str(root))

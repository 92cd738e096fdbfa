"""A data source of folders: skips before it reads, and lists empty folders too.

``spark.read.format("folders")`` with options ``path`` (a path, or a URI that Arrow's file systems know), ``skip`` (a
pattern of folder names), ``suffixes`` (comma-separated, any case; none: all files), ``content`` (``false``: names and
lengths only) and ``parts``. The driver lists level by level until there are ``parts`` folders to deal out, so it holds
the folders of one level; tasks walk what is below. A folder that is skipped is never listed, nor its files opened.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codelattice.functions import ids, paths

SCHEMA = "path string, is_folder boolean, length long, content binary"
ARROW = pa.schema([("path", pa.string()), ("is_folder", pa.bool_()), ("length", pa.int64()), ("content", pa.binary())])
HIDDEN = r"\..*"
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 23  # rows and bytes after which a task hands its rows on


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store that a path or URI names, and the path there."""
    path = re.sub(r"^file:(?=/(?!//))", "", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Walk:
    """What to list and read below a folder."""

    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/") or "/"
        self.skip = options.get("skip") or None
        self.suffixes = tuple(s.strip().lower() for s in options.get("suffixes", "").split(",") if s.strip())
        self.content = options.get("content", "true").lower() != "false"

    def listed(self, store: fs.FileSystem, folder: str) -> tuple[list[str], list[fs.FileInfo]]:
        """Folders to go on with and files wanted in ``folder``, by name. Links to folders are not followed."""
        found = sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda f: f.path)
        local = isinstance(store, fs.LocalFileSystem)
        below = [
            f.path for f in found if f.type == fs.FileType.Directory
            and not (self.skip and re.fullmatch(self.skip, f.base_name)) and not (local and os.path.islink(f.path))]
        files = [f for f in found if f.type == fs.FileType.File and (not self.suffixes or f.base_name.lower().endswith(self.suffixes))]
        return below, files


class Share(InputPartition):
    """Folders of a task, and of each whether it goes on below."""

    def __init__(self, folders: list[tuple[str, bool]]):
        self.folders = folders


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.walk, self.parts = Walk(options), int(options.get("parts", "64"))

    def partitions(self) -> list[Share]:
        store, root = opened(self.walk.root)
        done, level = [], [root]
        while level and len(level) < self.parts:
            done += [(folder, False) for folder in level]
            level = [below for folder in level for below in self.walk.listed(store, folder)[0]]
        todo = done + [(folder, True) for folder in level]
        return [Share(todo[k :: self.parts]) for k in range(min(self.parts, len(todo)))]

    def _rows(self, share: Share) -> Iterator[tuple]:
        store, root = opened(self.walk.root)
        todo = list(share.folders)
        while todo:
            folder, deep = todo.pop()
            below, files = self.walk.listed(store, folder)
            if folder != root:
                yield folder, True, 0, None
            for f in files:
                content = None
                if self.walk.content:
                    with store.open_input_stream(f.path) as stream:
                        content = stream.read()
                yield f.path, False, f.size, content
            if deep:
                todo += [(b, True) for b in below]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in self._rows(partition):
            rows.append(row)
            size += len(row[3] or b"")
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class Folders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def read_folders(spark: SparkSession, root: str, skip: str | None = None, suffixes: tuple[str, ...] = (), content: bool = True) -> DataFrame:
    """``path, is_folder, length, content`` of folders and files below ``root``, in no order."""
    spark.dataSource.register(Folders)
    read = spark.read.format("folders").option("content", str(content).lower()).option("suffixes", ",".join(suffixes))
    return (read.option("skip", skip) if skip else read).load(root)


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """``path, language, length, file_hash, text`` of all source files below ``root``; skipped folders are not read."""
    skip = "|".join([HIDDEN, *map(re.escape, paths.PRUNED_FOLDERS)])
    files = read_folders(spark, root, skip, tuple(paths.EXTENSION_LANGUAGE)).where(~F.col("is_folder"))
    return files.select(
        "path", paths.language_of(F.col("path")).alias("language"), "length", F.sha2("content", 256).alias("file_hash"), F.decode("content", "UTF-8").alias("text"))


def list_workspace(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Folders, empty ones as well, and source files below ``root`` with stable ids; hidden folders are skipped, no file is read."""
    found = read_folders(spark, root, HIDDEN, tuple(paths.EXTENSION_LANGUAGE), content=False)
    below = F.substr("path", F.lit(len(opened(root)[1].rstrip("/")) + 2))
    path = F.col("path")
    named = found.select(below.alias("path"), "is_folder")
    rows = named.select(ids.path_id(path).alias("id"), "path", paths.base_name(path).alias("name"), ids.path_id(paths.dir_name(path)).alias("directory"), "is_folder")
    return rows.where("is_folder").select("id", "path", "name"), rows.where("NOT is_folder").select("id", "path", "name", "directory")


def write_files(files: DataFrame, root: str) -> int:
    """Write ``text`` (null: empty) to ``path`` below ``root``, a file per row, from the tasks; returns how many.

    A file that is there is written anew, so a task may run twice. ``path`` is relative and not null.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root)
        for batch in batches:
            for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                full = f"{base.rstrip('/')}/{path}"
                store.create_dir(full.rpartition("/")[0], recursive=True)
                with store.open_output_stream(full) as stream:
                    stream.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    return files.select("path", "text").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0

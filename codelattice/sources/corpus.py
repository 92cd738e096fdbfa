"""Reading a file corpus."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.functions import ids, paths


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """``path, language, length, file_hash, text`` of all source files below ``root``.

    The listing and the reads are Spark's own. Its file source filters by name, length and time only, so source
    files in folders that a scan skips are read and then dropped. Where those are large, name the wanted folders:
    ``root`` may be a glob such as ``/ws/{src,lib}``, with paths below the folder before its first wildcard.
    """
    any_case = ["".join(f"[{c}{c.upper()}]" for c in ext[1:]) for ext in paths.EXTENSION_LANGUAGE]
    glob = "*.{" + ",".join(any_case) + "}"
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
        .load(root)
    )
    # binaryFile reports URIs such as file:/a/b; keep the path.
    local = raw.withColumn("path", F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?", ""))
    base = re.split(r"/[^/]*[*?{\[]", root, maxsplit=1)[0]
    return source_paths(local, base).select(
        "path", paths.language_of(F.col("path")).alias("language"), "length",
        F.sha2(F.col("content"), 256).alias("file_hash"), F.decode("content", "UTF-8").alias("text"),
    )


def source_paths(files: DataFrame, root: str) -> DataFrame:
    """Rows whose ``path`` is a source file and not in a skipped folder below ``root``."""
    path = F.col("path")
    return files.where(paths.language_of(path).isNotNull() & ~paths.pruned_below(root, path))


def workspace_inventory(files: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Distinct folders and source files below ``root`` with stable ids; only hidden folders are skipped."""
    path = F.col("path")
    seen = files.where(~paths.pruned_below(root, path, hidden_only=True)).select(
        F.substr(path, F.lit(len(root.rstrip("/")) + 2)).alias("path")
    )
    above = paths.ancestors(path)
    folders = seen.select(F.explode(F.slice(above, F.lit(1), F.size(above) - 1)).alias("a")).select("a.path", "a.name").distinct()
    sources = seen.where(paths.language_of(path).isNotNull()).select(
        ids.path_id(path).alias("id"), "path", paths.base_name(path).alias("name"),
        ids.path_id(paths.dir_name(path)).alias("directory"),
    )
    return folders.select(ids.path_id(path).alias("id"), "path", "name"), sources

"""Folder trees as closure rows: every row carries its own path, so no recursion is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.functions import paths
from codelattice.operators import nodes as N
from codelattice.operators.skew import hot_keys, skew_join

TYPE_RANK = {"directory": 0, "file": 1, "method": 2}


def path_tree(nodes: DataFrame) -> DataFrame:
    """``id, parent_id, name, type, path, line`` of all folders, files and leaves that ``nodes`` implies.

    Folder ids are ``dir:path``, file ids ``file:path``; empty path segments are dropped.
    """
    path = F.col("file_path")
    above = paths.ancestors(path)
    filed = nodes.where((path != "") & (F.size(above) > 0))
    files = filed.select(path.alias("path")).distinct()
    up = paths.ancestors(F.col("path"))
    folders = (
        files.select(F.explode(F.slice(up, F.lit(1), F.size(up) - 1)).alias("a")).select("a.path", "a.name").distinct()
    )

    def parent(prefixes: Column) -> Column:
        return F.when(F.size(prefixes) > 1, F.concat(F.lit("dir:"), F.element_at(prefixes, -2)["path"])).otherwise(F.lit(""))

    folder_rows = folders.select(
        F.concat(F.lit("dir:"), "path").alias("id"), parent(up).alias("parent_id"), "name", F.lit("directory").alias("type"),
        "path", F.lit(0).alias("line"))
    file_rows = files.select(
        F.concat(F.lit("file:"), "path").alias("id"), parent(up).alias("parent_id"), F.element_at(up, -1)["name"].alias("name"),
        F.lit("file").alias("type"), "path", F.lit(0).alias("line"))
    leaves = filed.select(
        "id", F.concat(F.lit("file:"), path).alias("parent_id"), F.col("label").alias("name"), F.lit("method").alias("type"),
        path.alias("path"), F.col("line").cast("int").alias("line"))
    return folder_rows.unionByName(file_rows).unionByName(leaves)


def tree_sorted(tree: DataFrame, locale_aware: bool = False) -> DataFrame:
    """Children of each parent: folders, files, then leaves, by name (binary order unless locale aware)."""
    rank = F.lit(3)
    for kind, value in TYPE_RANK.items():
        rank = F.when(F.col("type") == kind, value).otherwise(rank)
    name = F.collate("name", "UNICODE_CI") if locale_aware else F.col("name")
    return tree.withColumn("type_rank", rank).orderBy("parent_id", "type_rank", name, "id")


def strict_ancestors() -> Column:
    """Ids of all rows above a tree row, from its type and path alone."""
    up = paths.ancestors(F.col("path"))
    folders = F.transform(F.slice(up, F.lit(1), F.size(up) - 1), lambda a: F.concat(F.lit("dir:"), a["path"]))
    file = F.array(F.concat(F.lit("file:"), "path"))
    return F.when(F.col("type") == "method", F.concat(folders, file)).otherwise(folders)


def compact_chains(tree: DataFrame) -> DataFrame:
    """Folders with single-folder chains merged: ``id, path, name, parent_id``.

    A folder whose only child is a folder merges into it. The merged row has the id and path of the
    deepest one and the names of all joined by ``/``.
    """
    folders = tree.where(F.col("type") == "directory")
    children = tree.where(F.col("parent_id") != "").groupBy(F.col("parent_id").alias("id")).agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.col("type") == "directory").alias("_folder"))
    kept = folders.join(children, "id", "left").where(F.coalesce(~((F.col("_n") == 1) & F.col("_folder")), F.lit(True)))
    kept = kept.select("id", "path")
    up = paths.ancestors(F.col("path"))
    # Per kept folder, the deepest kept one above it: that is the parent, and its depth cuts the name.
    above = kept.select("id", F.explode(F.slice(up, F.lit(1), F.size(up) - 1)).alias("a")).select(
        F.col("id").alias("child"), F.concat(F.lit("dir:"), "a.path").alias("id"), "a.depth")
    nearest = skew_join(above, kept.select("id"), "id", "left_semi", hot=hot_keys(above, "id")).groupBy(F.col("child").alias("id")).agg(
        F.max(F.struct("depth", F.col("id").alias("parent_id"))).alias("p"))
    depth = F.coalesce("p.depth", F.lit(0))
    names = F.transform(F.slice(up, depth + 1, F.size(up) - depth), lambda a: a["name"])
    return kept.join(nearest, "id", "left").select(
        "id", "path", F.array_join(names, "/").alias("name"), F.coalesce("p.parent_id", F.lit("")).alias("parent_id"))


def search_tree(tree: DataFrame, text: str) -> DataFrame:
    """Rows of the tree left by a search.

    A row stays if its name contains ``text`` in any case or something below it does. A hit with no hit
    below it shows all that is below it.
    """
    if not text:
        return tree
    hits = tree.where(F.contains(F.lower("name"), F.lit(text.lower())))
    over = hits.select(F.explode(strict_ancestors()).alias("id")).distinct()
    lowest = hits.select("id").join(over, "id", "left_anti")
    below = tree.select("id", F.explode(strict_ancestors()).alias("above"))
    # Top folders are above most rows, so they are looked for and spread.
    inside = skew_join(below, lowest.select(F.col("id").alias("above")), "above", "left_semi", hot=hot_keys(below, "above")).select("id")
    shown = hits.select("id").unionByName(over).unionByName(inside).distinct()
    return tree.join(shown, "id", "left_semi")


def file_tree(
    real_dirs: DataFrame, files: DataFrame, virtual_dirs: DataFrame, symbols: DataFrame, annotations: DataFrame
) -> DataFrame:
    """Folders, files and the methods of each file: ``part, id, path, name, is_virtual, line, type, description``.

    Read in order of ``path, line`` within a part. Files without symbols stay.
    """
    none, zero = F.lit(""), F.lit(0)

    def row(df, part, kind, virtual, name="name", path="path", line=zero, description=none):
        return df.select(F.lit(part).alias("part"), "id", F.col(path).alias("path"), F.col(name).alias("name"), F.lit(virtual).alias("is_virtual"),
                         line.alias("line"), kind.alias("type"), description.alias("description"))

    methods = N.nodes_by_file(symbols, annotations, files.select(F.col("path").alias("file_path")))
    return (
        row(real_dirs, "directory", F.lit("directory"), False)
        .unionByName(row(virtual_dirs, "directory", F.lit("directory"), True))
        .unionByName(row(files, "file", F.lit("file"), False))
        .unionByName(row(methods, "method", F.col("type"), False, "label", "file_path", F.col("line"), F.col("description")))
    )

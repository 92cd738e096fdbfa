"""From what a user points at to rows of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.operators.edges import connected_edges
from codelattice.operators.nodes import CLASS_TYPES
from codelattice.operators.skew import skew_join


def class_of_file(nodes: DataFrame, *more_types: str) -> DataFrame:
    """The class or interface node of each file, the least id where a file has several."""
    real = nodes.where(F.col("type").isin(*CLASS_TYPES, *more_types) & ~F.col("is_virtual"))
    return real.groupBy("file_path").agg(F.min("id").alias("_class"))


def container_of(asked: DataFrame, nodes: DataFrame, files: DataFrame, directories: DataFrame) -> DataFrame:
    """``id, container_id``: class node of the same file, else the file, for methods and fields; folder for classes."""
    by_path = files.select(F.col("path").alias("file_path"), F.col("id").alias("_file"), F.col("directory").alias("_dir"))
    known = by_path.join(directories.select(F.col("id").alias("_dir")).withColumn("_real_dir", F.lit(True)), "_dir", "left")
    joined = skew_join(skew_join(asked, class_of_file(nodes), "file_path", "left"), known, "file_path", "left")
    folder = F.when(F.col("_real_dir"), F.col("_dir"))
    container = F.when(F.col("type").isin("method", "field"), F.coalesce("_class", "_file")).when(
        F.col("type").isin(*CLASS_TYPES), folder)
    return joined.select("id", F.coalesce(container, F.lit("")).alias("container_id"))


def selected_nodes(picks: DataFrame, nodes: DataFrame, files: DataFrame, directories: DataFrame) -> DataFrame:
    """Graph row ``pick_id, id, label, type, file_path`` for each tree item ``id, type, name, path``.

    By id; else a file's class node, then the file row; else a directory's node, its row, or a row made
    up from the item. Items that lead nowhere drop out.
    """
    def row(*columns):
        return F.struct(*[c.alias(n) for c, n in zip(columns, ("id", "label", "type", "file_path"))])

    whole = row(F.col("id"), F.col("label"), F.col("type"), F.col("file_path"))
    by_id = nodes.select(F.col("id").alias("pick_id"), whole.alias("_node"))
    in_file = nodes.where(F.col("type").isin("file", *CLASS_TYPES) & ~F.col("is_virtual")).groupBy(
        F.col("file_path").alias("path")).agg(F.min_by(whole, F.col("id")).alias("_class"))
    a_dir = nodes.where((F.col("type") == "directory") & ~F.col("is_virtual")).groupBy(
        F.col("file_path").alias("path")).agg(F.min_by(whole, F.col("id")).alias("_dirnode"))
    file_row = files.select("path", row(F.col("id"), F.col("name"), F.lit("class"), F.col("path")).alias("_file"))
    dir_row = directories.select("path", row(F.col("id"), F.col("name"), F.lit("directory"), F.col("path")).alias("_dir"))
    made_up = row(F.col("pick_id"), F.col("name"), F.lit("directory"), F.col("path"))
    joined = picks.withColumnRenamed("id", "pick_id").withColumnRenamed("type", "pick_type").join(by_id, "pick_id", "left")
    for side in (in_file, file_row, a_dir, dir_row):
        joined = skew_join(joined, side, "path", "left")
    chosen = F.coalesce(
        F.col("_node"),
        F.when(F.col("pick_type") == "file", F.coalesce("_class", "_file")),
        F.when(F.col("pick_type") == "directory", F.coalesce(F.col("_dirnode"), F.col("_dir"), made_up)),
    )
    return joined.select("pick_id", chosen.alias("row")).where(F.col("row").isNotNull()).select("pick_id", "row.*")


def selection_edges(selected: DataFrame, edges: DataFrame, visible: DataFrame) -> DataFrame:
    """Edges that adding the selected nodes brings on display; nodes already there add none."""
    new = selected.select("id").distinct().join(visible.select("id"), "id", "left_anti")
    return connected_edges(edges, new, visible)

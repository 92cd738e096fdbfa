"""The node set: indexed symbols and planned nodes seen as one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.functions import ids, paths
from codelattice.operators.skew import matchable, skew_join

NODE_COLUMNS = [
    "id", "label", "type", "file_path", "line", "is_virtual", "materialized", "virtual_class_id", "virtual_directory"
]
CLASS_TYPES = ("class", "interface")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def real_nodes(symbols: DataFrame) -> DataFrame:
    """Symbols in the shape of graph nodes."""
    return symbols.select(
        "id", F.col("name").alias("label"), F.col("kind").alias("type"), text_or_empty("file_path").alias("file_path"),
        F.coalesce("line", F.lit(0)).cast("int").alias("line"), F.lit(False).alias("is_virtual"),
        F.lit(False).alias("materialized"), F.lit("").alias("virtual_class_id"), F.lit("").alias("virtual_directory"),
    )


def planned_nodes(virtual: DataFrame) -> DataFrame:
    """Planned nodes in the shape of graph nodes, under their planned file."""
    return virtual.select(
        "id", "label", "type",
        paths.planned_file_path(F.col("virtual_directory"), F.col("label")).alias("file_path"),
        F.lit(0).alias("line"), F.lit(True).alias("is_virtual"),
        F.col("materialized").cast("boolean").alias("materialized"),
        text_or_empty("virtual_class_id").alias("virtual_class_id"),
        text_or_empty("virtual_directory").alias("virtual_directory"),
    )


def unmaterialised(virtual: DataFrame, symbols: DataFrame) -> DataFrame:
    """Drop planned nodes that are marked as built and whose label is now a symbol name."""
    built = F.col("materialized").cast("boolean")
    names = symbols.select(F.col("name").alias("label")).distinct()
    return virtual.where(~built).unionByName(skew_join(virtual.where(built), names, "label", "left_anti"))


def annotate_nodes(nodes: DataFrame, annotations: DataFrame, details: bool = False) -> DataFrame:
    """Attach description and remarks by node id, with ``details`` code snippet and custom properties too; empty where a node has none."""
    texts = ["description", "ai_remarks", *(["code_snippet", "custom_properties"] if details else [])]
    notes = annotations.select(F.col("node_id").alias("id"), *texts, F.lit(True).alias("_noted"))
    return nodes.join(notes, "id", "left").select(
        *nodes.columns, F.coalesce("_noted", F.lit(False)).alias("annotated"), *[text_or_empty(c).alias(c) for c in texts])


def class_files(nodes: DataFrame) -> DataFrame:
    """One file per class name among real nodes: that of the last node by (label, id)."""
    return (
        nodes.where(~F.col("is_virtual") & (F.col("file_path") != ""))
        .select(paths.class_of_label(F.col("label")).alias("class_name"), "file_path", "label", "id")
        .where(F.col("class_name") != "")
        .groupBy("class_name")
        .agg(F.max_by("file_path", F.struct("label", "id")).alias("class_file"))
    )


def adopt_real_files(virtual_rows: DataFrame, files: DataFrame) -> DataFrame:
    """Put planned rows of a class that exists in code into that class's file."""
    keyed = virtual_rows.withColumn("class_name", paths.class_of_label(F.col("label")))
    placed = skew_join(keyed, files, "class_name", "left")
    return placed.withColumn("file_path", F.coalesce("class_file", "file_path")).select(*virtual_rows.columns)


def graph_nodes(symbols: DataFrame, virtual: DataFrame, annotations: DataFrame) -> DataFrame:
    """All nodes on display: symbols and unbuilt planned nodes, annotated, planned ones filed by class."""
    real = real_nodes(symbols)
    planned = adopt_real_files(planned_nodes(unmaterialised(virtual, symbols)), class_files(real))
    return annotate_nodes(real.unionByName(planned), annotations)


def node_count(symbols: DataFrame, virtual: DataFrame) -> DataFrame:
    shown = symbols.select("id").unionByName(unmaterialised(virtual, symbols).select("id"))
    return shown.agg(F.count(F.lit(1)).alias("total"))


def parent_id() -> Column:
    """Container of a node, empty if it stands alone."""
    is_class = F.col("type").isin(*CLASS_TYPES)
    virtual = F.col("is_virtual")
    return (
        F.when(~virtual & ~is_class & (F.col("file_path") != ""), ids.path_id(F.col("file_path")))
        .when(virtual & (F.col("virtual_class_id") != ""), F.col("virtual_class_id"))
        .when(
            virtual & (F.col("type") == "class") & (F.col("virtual_directory") != ""),
            ids.path_id(F.col("virtual_directory")),
        )
        .otherwise(F.lit(""))
    )


def with_parents(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("parent_id", parent_id())


def directory_nodes(directories: DataFrame) -> DataFrame:
    """Planned directories as graph nodes; their id is the hash of their path."""
    return directories.select(
        ids.path_id(F.col("path")).alias("id"), F.col("name").alias("label"), F.lit("directory").alias("type"),
        F.lit("").alias("file_path"), F.lit(0).alias("line"), F.lit(True).alias("is_virtual"),
        F.lit("").alias("parent_id"),
    )


def search_nodes(
    symbols: DataFrame, virtual: DataFrame, annotations: DataFrame, text: str, limit: int = 50
) -> DataFrame:
    """Nodes whose label contains ``text`` in any case, by label; at most ``limit``.

    ``%`` and ``_`` in the text are wildcards. Built planned nodes are found too.
    """
    pattern = "%" + text.replace("\\", "\\\\") + "%"
    pool = real_nodes(symbols).unionByName(planned_nodes(virtual)).where(F.col("label").ilike(pattern))
    top = pool.orderBy("label", "id").limit(limit)
    return annotate_nodes(top, annotations).orderBy("label", "id")


def nodes_by_file(symbols: DataFrame, annotations: DataFrame, files: DataFrame) -> DataFrame:
    """Real nodes of the given files (``file_path``), annotated."""
    rows = skew_join(real_nodes(symbols), files.select("file_path").distinct(), "file_path", "left_semi")
    return annotate_nodes(rows, annotations)


def lookup_nodes(symbols: DataFrame, virtual: DataFrame, annotations: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per wanted ``id``: the symbol, else the planned node, else ``found`` is false.

    A planned node takes the file of the first symbol, by (name, id), named ``Class.…`` in any case.
    """
    keys = wanted.select("id").distinct()
    real = real_nodes(symbols).join(keys, "id", "left_semi")
    members = (
        symbols.where((F.instr("name", ".") > 0) & (F.col("file_path") != ""))
        .groupBy(F.lower(F.substring_index("name", ".", 1)).alias("_class"))
        .agg(F.min_by("file_path", F.struct("name", "id")).alias("_file"))
    )
    planned = planned_nodes(virtual).join(keys, "id", "left_semi").join(real.select("id"), "id", "left_anti")
    planned = skew_join(
        planned.withColumn("_class", F.lower(paths.class_of_label(F.col("label")))), members, "_class", "left"
    ).withColumn("file_path", F.coalesce("_file", "file_path")).select(*NODE_COLUMNS)
    hits = annotate_nodes(real.unionByName(planned), annotations).withColumn("found", F.lit(True))
    empty = {c: "" for c in ("label", "type", "file_path", "virtual_class_id", "virtual_directory", "description", "ai_remarks")}
    return keys.join(hits, "id", "left").na.fill(empty).na.fill(0, ["line"]).na.fill(
        False, ["is_virtual", "materialized", "annotated", "found"]
    )


def files_of(nodes: DataFrame) -> DataFrame:
    """Distinct files of real nodes with id, name and directory id."""
    path = F.col("path")
    return (
        nodes.where(~F.col("is_virtual") & (F.col("file_path") != ""))
        .select(F.col("file_path").alias("path"))
        .distinct()
        .select(
            ids.path_id(path).alias("id"), "path", paths.base_name(path).alias("name"),
            ids.path_id(paths.dir_name(path)).alias("directory"),
        )
    )


def directories_of(files: DataFrame) -> DataFrame:
    """Distinct immediate folders of a file table."""
    path = F.col("path")
    return (
        files.select(paths.dir_name(F.col("path")).alias("path"))
        .distinct()
        .select(ids.path_id(path).alias("id"), "path", paths.base_name(path).alias("name"))
    )


def file_rows(files: DataFrame) -> DataFrame:
    """File rows as graph node rows."""
    return files.select(
        "id", F.col("name").alias("label"), F.lit("class").alias("type"), F.col("path").alias("file_path"),
        F.lit(0).alias("line"), F.lit(False).alias("is_virtual"), F.col("directory").alias("parent_id"),
    )


def directory_rows(directories: DataFrame) -> DataFrame:
    """Directory rows as graph node rows."""
    return directories.select(
        "id", F.col("name").alias("label"), F.lit("directory").alias("type"), F.col("path").alias("file_path"),
        F.lit(0).alias("line"), F.lit(False).alias("is_virtual"), F.lit("").alias("parent_id"),
    )


def display_type() -> Column:
    """Display class of a node row."""
    kind = F.col("type")
    planned = (
        F.when(kind == "class", F.lit("virtual-class"))
        .when(kind == "directory", F.lit("virtual-directory"))
        .otherwise(F.lit("virtual"))
    )
    return (
        F.when(F.col("is_virtual"), planned)
        .when(kind == "directory", F.lit("directory"))
        .when(kind.isin(*CLASS_TYPES), F.lit("file"))
        .when(kind == "field", F.lit("field"))
        .otherwise(F.lit("method"))
    )


# Display classes that can hold other nodes.
CONTAINER_TYPES = ("directory", "file", "virtual-directory", "virtual-class")


def effective_parents(visible: DataFrame, files: DataFrame) -> DataFrame:
    """``id, display_type, parent`` for visible nodes; ``parent`` is empty unless it is a visible container.

    A real node without a parent falls back to its file (methods, fields) or its folder (classes).
    """
    typed = visible.withColumn("display_type", display_type())
    by_path = files.select(F.col("path").alias("_path"), F.col("id").alias("_file"), F.col("directory").alias("_dir"))
    real = ~F.col("is_virtual") & (F.col("file_path") != "")
    typed = typed.withColumn("_path", matchable(F.col("file_path"), real, F.col("id")))
    fallback = (
        F.when(real & F.col("display_type").isin("method", "field"), F.col("_file"))
        .when(real & (F.col("display_type") == "file"), F.col("_dir"))
    )
    named = F.coalesce(F.nullif("parent_id", F.lit("")), fallback)
    wanted = skew_join(typed, by_path, "_path", "left").withColumn("parent", matchable(named, named.isNotNull(), F.col("id")))
    boxes = (
        typed.where(F.col("display_type").isin(*CONTAINER_TYPES))
        .select(F.col("id").alias("parent"), F.lit(True).alias("_box")).distinct()
    )
    kept = F.col("_box") & (F.col("parent") != F.col("id"))
    return skew_join(wanted, boxes, "parent", "left").select(
        *visible.columns, "display_type", F.when(kept, F.col("parent")).otherwise(F.lit("")).alias("parent")
    )

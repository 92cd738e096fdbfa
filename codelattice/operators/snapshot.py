"""Snapshots: capture, restore and reconciliation with newer data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.functions import ids
from codelattice.operators.nodes import CLASS_TYPES, text_or_empty
from codelattice.operators.skew import first_per_key, matchable, skew_join


def context_type() -> Column:
    """Type a node is stored under: a class row that only stands for its file becomes ``file``."""
    stands_for_file = (
        ~F.col("is_virtual") & F.col("type").isin(*CLASS_TYPES) & (F.col("line") == 0) & (F.col("file_path") != "")
        & (F.col("label") == F.regexp_extract("file_path", r"([^/\\]*)$", 1))
    )
    return F.when(stands_for_file, F.lit("file")).otherwise(F.col("type"))


def placeholder_class() -> Column:
    """A file kept in the older way, as a class or interface with a path and no line."""
    return F.col("type").isin(*CLASS_TYPES) & (F.col("file_path") != "") & (F.coalesce("line", F.lit(0)) == 0)


def symbol_backed() -> Column:
    """True if a snapshot node stands for a symbol, not for a file or directory."""
    return ~(F.col("type").isin("directory", "file") | placeholder_class())


NODE_KEY = ["snapshot_id", "id"]


def _virtual_ids(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("is_virtual")).select(*NODE_KEY).distinct()


def context_candidates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``snapshot_id, id`` of everything a snapshot expects to find among the symbols."""
    virtual = _virtual_ids(nodes)
    context = nodes.where(~F.col("is_virtual") & (F.col("id") != "")).join(virtual, NODE_KEY, "left_anti")
    containers = context.where(~symbol_backed()).select(*NODE_KEY).distinct()
    ends = edges.select("snapshot_id", F.col("source_id").alias("id")).unionByName(
        edges.select("snapshot_id", F.col("target_id").alias("id"))
    ).where(F.col("id") != "").distinct()
    ends = ends.join(virtual.unionByName(containers), NODE_KEY, "left_anti")
    return context.where(symbol_backed()).select(*NODE_KEY).unionByName(ends).distinct()


def stale_context(nodes: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """``snapshot_id, id`` of expected symbols that are gone."""
    return skew_join(context_candidates(nodes, edges), symbols.select("id"), "id", "left_anti").select(*NODE_KEY)


def known_context(nodes: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """``snapshot_id, id`` of expected symbols that are there."""
    return skew_join(context_candidates(nodes, edges), symbols.select("id"), "id", "left_semi").select(*NODE_KEY)


def restorable_edges(nodes: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Snapshot edges that can be brought back, with ``planned`` true if an end is a planned node.

    An edge between real symbols needs both of them; one with a planned end always comes back.
    """
    virtual = _virtual_ids(nodes).withColumn("_v", F.lit(True))
    known = known_context(nodes, edges, symbols).withColumn("_k", F.lit(True))
    state = known.join(virtual, NODE_KEY, "full_outer")
    out = edges
    for end in ("source_id", "target_id"):
        side = state.select("snapshot_id", F.col("id").alias(end), F.col("_v").alias(f"_v_{end}"), F.col("_k").alias(f"_k_{end}"))
        out = skew_join(out, side, ["snapshot_id", end], "left")
    no = F.lit(False)
    planned = F.coalesce("_v_source_id", no) | F.coalesce("_v_target_id", no)
    both = F.coalesce("_k_source_id", no) & F.coalesce("_k_target_id", no)
    return out.where(planned | both).select(*edges.columns, planned.alias("planned"))


def missing_edges(restorable: DataFrame, calls: DataFrame) -> DataFrame:
    """Manual calls to add so that every restorable edge exists; none on a second run.

    Between real symbols any call will do; an edge with a planned end needs a manual one.
    """
    pair = ["caller_id", "callee_id"]
    wanted = restorable.select(F.col("source_id").alias("caller_id"), F.col("target_id").alias("callee_id"), "planned").distinct()
    have = calls.groupBy(*pair).agg(F.max(F.col("call_type") == "manual").alias("_manual"))
    real = skew_join(wanted.where(~F.col("planned")), have, pair, "left_anti")
    planned = skew_join(wanted.where("planned"), have.where("_manual"), pair, "left_anti")
    return real.unionByName(planned).select(*pair).distinct().select(
        *pair, F.lit("manual").alias("call_type"), F.lit("").alias("file_path"), F.lit(0).alias("line")
    )


def restore_stats(nodes: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per snapshot: planned nodes and edges brought back, and distinct symbols missing."""
    count, zero = F.count(F.lit(1)).cast("bigint"), F.lit(0).cast("bigint")
    restored = nodes.groupBy("snapshot_id").agg(F.count_if("is_virtual").alias("restored_nodes"))
    linked = restorable_edges(nodes, edges, symbols).groupBy("snapshot_id").agg(count.alias("restored_edges"))
    gone = stale_context(nodes, edges, symbols).groupBy("snapshot_id").agg(count.alias("missing_context_nodes"))
    joined = restored.join(linked, "snapshot_id", "full_outer").join(gone, "snapshot_id", "full_outer")
    names = ["restored_nodes", "restored_edges", "missing_context_nodes"]
    return joined.select("snapshot_id", *[F.coalesce(n, zero).alias(n) for n in names])


def _load_order() -> Column:
    return F.struct("snapshot_id", (~F.col("is_virtual")).alias("later"), "seq")


def _stored(table: DataFrame, rows: DataFrame, key: str, now: int, first: tuple[str, ...] = ()) -> DataFrame:
    """``table`` with ``rows`` written over it by ``key``; all its columns stay.

    Columns of ``rows`` win, but for those in ``first``, which a stored row keeps. Times of creation and
    change are set where the table has them.
    """
    told = [c for c in rows.columns if c != key]
    given = rows.select(key, *[F.col(c).alias(f"_new_{c}") for c in told], F.lit(True).alias("_hit"))
    both = table.withColumn("_had", F.lit(True)).join(given, key, "full_outer")
    had, hit = F.coalesce("_had", F.lit(False)), F.coalesce("_hit", F.lit(False))

    def value(c: str) -> Column:
        old = F.col(c)
        if c in told:
            return F.when(hit & ~had if c in first else hit, F.col(f"_new_{c}")).otherwise(old)
        if c == "created_at":
            return F.when(had, old).otherwise(F.lit(now).cast(table.schema[c].dataType))
        if c == "updated_at":
            return F.when(hit, F.lit(now).cast(table.schema[c].dataType)).otherwise(old)
        return old

    return both.select(*[value(c).alias(c) for c in table.columns])


def restore(
    nodes: DataFrame,
    edges: DataFrame,
    symbols: DataFrame,
    calls: DataFrame,
    virtual: DataFrame,
    annotations: DataFrame,
    edge_annotations: DataFrame,
    now: int = 0,
    back: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """New overlay tables after loading the given snapshots, in order of snapshot id.

    ``back`` is what :func:`restorable_edges` gives; remarks and calls both read it, so who needs both may store it first.

    A planned node comes back unbuilt, without a folder, and keeps its class only if that is in the
    snapshot. Notes go to planned nodes and to symbols that still exist. Other stored columns stay as they
    are; what is written carries the time ``now``.
    """
    virtual_ids = _virtual_ids(nodes)
    parents = virtual_ids.select("snapshot_id", F.col("id").alias("_parent"), F.col("id").alias("_class"))
    parent = matchable(F.col("parent_id"), text_or_empty("parent_id") != "", F.col("id"))
    planned = skew_join(nodes.where("is_virtual").withColumn("_parent", parent), parents, ["snapshot_id", "_parent"], "left")
    row = F.struct("label", "type", F.col("_class").alias("virtual_class_id"))
    loaded = planned.groupBy("id").agg(F.max_by(row, _load_order()).alias("r")).select(
        "id", "r.label", "r.type", "r.virtual_class_id", F.lit(None).cast("string").alias("virtual_directory"),
        F.lit(False).alias("materialized"),
    )

    known = known_context(nodes, edges, symbols)
    spoken = nodes.where((text_or_empty("description") != "") | (text_or_empty("ai_remarks") != ""))
    noted = spoken.where("is_virtual").unionByName(spoken.where(~F.col("is_virtual")).join(known, NODE_KEY, "left_semi"))
    notes = noted.groupBy(F.col("id").alias("node_id")).agg(
        F.max_by(F.struct(text_or_empty("description").alias("description"), text_or_empty("ai_remarks").alias("ai_remarks")), _load_order()).alias("r")
    ).select("node_id", "r.*")

    back = restorable_edges(nodes, edges, symbols) if back is None else back
    remarks = back.where(text_or_empty("remarks") != "").groupBy(
        ids.edge_id(F.col("source_id"), F.col("target_id")).alias("edge_id"), "source_id", "target_id"
    ).agg(F.max_by("remarks", F.struct("snapshot_id", "seq")).alias("remarks"))
    told = remarks.select(
        "edge_id", F.col("source_id").alias("source_node_id"), F.col("target_id").alias("target_node_id"), "remarks", F.lit(0).alias("call_count"))
    added = missing_edges(back, calls)
    if "created_at" in calls.columns:
        added = added.withColumn("created_at", F.lit(now).cast(calls.schema["created_at"].dataType))
    return {
        "virtual_nodes": _stored(virtual.withColumn("materialized", F.col("materialized").cast("boolean")), loaded, "id", now),
        "node_annotations": _stored(annotations, notes, "node_id", now),
        "edge_annotations": _stored(edge_annotations, told, "edge_id", now, first=("source_node_id", "target_node_id", "call_count")),
        "method_calls": calls.unionByName(added, allowMissingColumns=True),
    }


def capture(view_nodes: DataFrame, view_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snapshot rows from the nodes and edges on display, each with ``snapshot_id`` and ``seq``."""
    nodes = view_nodes.select(
        "snapshot_id", "seq", "id", "label", F.when(F.col("is_virtual"), F.col("type")).otherwise(context_type()).alias("type"),
        "file_path", "line", "is_virtual", "parent_id", text_or_empty("description").alias("description"),
        text_or_empty("ai_remarks").alias("ai_remarks"),
    )
    edges = view_edges.select(
        "snapshot_id", "seq", F.col("source").alias("source_id"), F.col("target").alias("target_id"), text_or_empty("remarks").alias("remarks")
    )
    return nodes, edges


def snapshot_counts(snapshots: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per snapshot: planned nodes, context nodes and edges."""
    a = nodes.groupBy(F.col("snapshot_id").alias("id")).agg(
        F.count_if("is_virtual").alias("virtual_nodes"), F.count_if(~F.col("is_virtual")).alias("context_nodes"))
    b = edges.groupBy(F.col("snapshot_id").alias("id")).agg(F.count(F.lit(1)).alias("edges"))
    zero = F.lit(0).cast("bigint")
    return snapshots.select("id").join(a, "id", "left").join(b, "id", "left").select(
        "id", *[F.coalesce(c, zero).alias(c) for c in ("virtual_nodes", "context_nodes", "edges")])


# --- reconciliation -------------------------------------------------------------------------------


def reconcile_nodes(nodes: DataFrame, fresh_nodes: DataFrame, files: DataFrame, directories: DataFrame) -> DataFrame:
    """Each snapshot node against the fresh graph.

    Adds ``resolved_id``, the display columns, ``stale``, and ``first``, true for the one row per
    snapshot and resolved id that is shown. By node id; else folders and files by id, then by path;
    else a stale placeholder. ``fresh_nodes`` has ``id, label, type, file_path, line, description,
    ai_remarks, annotated``.
    """
    def put(df, prefix):
        return df.select(*[F.col(c).alias(f"_{prefix}_{c}") for c in df.columns])

    n = put(fresh_nodes.select("id", "label", "type", "file_path", "line", "annotated", "description", "ai_remarks"), "n")
    d1, d2 = put(directories.select("id", "path", "name"), "di"), put(directories.select("id", "path", "name"), "dp")
    f1, f2 = put(files.select("id", "path", "name"), "fi"), put(files.select("id", "path", "name"), "fp")
    has_path = F.col("file_path") != ""
    is_dir = ~F.col("is_virtual") & (F.col("type") == "directory")
    is_file = ~F.col("is_virtual") & ((F.col("type") == "file") | placeholder_class())
    joined = (
        nodes.withColumn("_dir_id", matchable(F.col("id"), is_dir, F.col("id")))
        .withColumn("_dir_path", matchable(F.col("file_path"), is_dir & has_path, F.col("id")))
        .withColumn("_file_id", matchable(F.col("id"), is_file, F.col("id")))
        .withColumn("_file_path", matchable(F.col("file_path"), is_file & has_path, F.col("id")))
        .join(n, F.col("id") == F.col("_n_id"), "left")
        .join(d1, F.col("_dir_id") == F.col("_di_id"), "left").join(d2, F.col("_dir_path") == F.col("_dp_path"), "left")
        .join(f1, F.col("_file_id") == F.col("_fi_id"), "left").join(f2, F.col("_file_path") == F.col("_fp_path"), "left")
    )

    said_any = (text_or_empty("description") != "") | (text_or_empty("ai_remarks") != "")
    own = (said_any.alias("annotated"), text_or_empty("description").alias("description"), text_or_empty("ai_remarks").alias("ai_remarks"))

    def row(rid, label, kind, path, line, stale, notes=own):
        return F.struct(rid.alias("resolved_id"), label.alias("r_label"), kind.alias("r_type"), path.alias("r_file_path"),
                        line.cast("int").alias("r_line"), F.lit(stale).alias("stale"),
                        *[c.alias(f"r_{k}") for c, k in zip(notes, ("annotated", "description", "ai_remarks"))])

    c = F.col
    by_node = F.when(c("_n_id").isNotNull(), row(c("_n_id"), c("_n_label"), c("_n_type"), c("_n_file_path"), c("_n_line"), False,
                                               (c("_n_annotated"), c("_n_description"), c("_n_ai_remarks"))))

    def container(prefix, kind):
        return F.when(c(f"_{prefix}_id").isNotNull(), row(c(f"_{prefix}_id"), c(f"_{prefix}_name"), F.lit(kind), c(f"_{prefix}_path"), F.lit(0), False))

    kind = F.when(c("type") == "file", F.lit("class")).otherwise(F.coalesce(F.nullif("type", F.lit("")), F.lit("method")))
    stale = row(c("id"), c("label"), kind, text_or_empty("file_path"), F.coalesce("line", F.lit(0)), True)
    chosen = F.coalesce(by_node, container("di", "directory"), container("dp", "directory"), container("fi", "class"), container("fp", "class"), stale)
    order = F.struct((~F.col("is_virtual")).alias("later"), "seq")
    rows = joined.select("snapshot_id", "seq", "id", "is_virtual", chosen.alias("r")).select("snapshot_id", "seq", "id", "is_virtual", "r.*")
    first = rows.groupBy("snapshot_id", "resolved_id").agg(F.min(order).alias("_first"))
    return rows.join(first, ["snapshot_id", "resolved_id"]).withColumn("first", order == F.col("_first")).drop("_first")


def reconcile_edges(edges: DataFrame, reconciled: DataFrame, fresh_edges: DataFrame) -> DataFrame:
    """Snapshot edges with ends moved to the resolved ids, one per pair, against the fresh edges.

    A fresh edge keeps its count, and its remark if it has one; an edge that is gone is stale with count 1.
    """
    order = F.struct((~F.col("is_virtual")).alias("later"), "seq")
    moved = reconciled.groupBy(*NODE_KEY).agg(F.max_by("resolved_id", order).alias("to"))
    shown = reconciled.select("snapshot_id", F.col("resolved_id").alias("id")).distinct()
    out = edges
    for end, name in (("source_id", "source"), ("target_id", "target")):
        step = moved.select("snapshot_id", F.col("id").alias(end), F.col("to").alias(f"_{name}"))
        out = skew_join(out, step, ["snapshot_id", end], "left").withColumn(name, F.coalesce(f"_{name}", end)).drop(f"_{name}")
        out = skew_join(out, shown.withColumnRenamed("id", name), ["snapshot_id", name], "left_semi")
    one = first_per_key(out.select("snapshot_id", "source", "target", "remarks", "seq"), ["snapshot_id", "source", "target"], "seq")
    keyed = one.withColumn("edge_id", ids.edge_id(F.col("source"), F.col("target"))).withColumnRenamed("remarks", "_own")
    fresh = fresh_edges.select("edge_id", "call_count", F.col("remarks").alias("_fresh"))
    return skew_join(keyed, fresh, "edge_id", "left").select(
        "snapshot_id", "edge_id", "source", "target", F.coalesce("call_count", F.lit(1)).cast("bigint").alias("call_count"),
        F.coalesce(F.nullif("_fresh", F.lit("")), "_own", F.lit("")).alias("remarks"), F.col("call_count").isNull().alias("stale"),
    )

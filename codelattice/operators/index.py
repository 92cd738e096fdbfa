"""Index tables as pure functions: old table and change in, new table out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.functions import ids
from codelattice.operators.skew import last_per_key, skew_join


def id_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``id, change``: added, removed or kept, between two sets of ids."""
    a = old.select(F.col("id")).distinct().withColumn("_old", F.lit(True))
    b = new.select(F.col("id")).distinct().withColumn("_new", F.lit(True))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("kept")
    return a.join(b, "id", "full_outer").select("id", change.alias("change"))


# --- upserts --------------------------------------------------------------------------------------


def upsert_last_wins(table: DataFrame, batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Insert or replace: per key the last row of the batch, else the stored row, as a whole."""
    latest = last_per_key(batch, keys, order).select(*table.columns)
    return table.join(latest, list(keys), "left_anti").select(*table.columns).unionByName(latest)


def upsert_keep_created(writes: DataFrame, keys: Sequence[str], order: str, created: str) -> DataFrame:
    """Fold a log of upserts: last values win, the first ``created`` stays."""
    rest = [c for c in writes.columns if c not in (*keys, created)]
    folded = writes.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.col(order)).alias("_row"), F.min_by(created, F.col(order)).alias(created)
    )
    return folded.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest], created)


def patch_annotations(table: DataFrame, patches: DataFrame, fields: Sequence[str], order: str) -> DataFrame:
    """Field-wise patch. A NULL field in a patch means "not given"; an empty string does overwrite.

    Keyed by ``node_id``; several patches of one node apply in ``order``. Other columns of ``table`` stay.
    """
    given = [
        F.max_by(F.struct(F.col(f).alias("v")), F.when(F.col(f).isNotNull(), F.col(order))).alias(f"_{f}") for f in fields
    ]
    merged = patches.groupBy("node_id").agg(*given)
    value = {f: F.coalesce(F.col(f"_{f}.v"), F.col(f), F.lit("")).alias(f) for f in fields}
    return table.join(merged, "node_id", "full_outer").select(*[value.get(c, c) for c in table.columns])


def patch_nodes(virtual: DataFrame, patches: DataFrame) -> DataFrame:
    """Update planned nodes: label and type only if not empty, class and folder always, built flag if given.

    One patch per ``id``, with columns ``label, type, virtual_class_id, virtual_directory, materialized``.
    """
    new = patches.select("id", *[F.col(c).alias(f"_{c}") for c in ("label", "type", "virtual_class_id", "virtual_directory", "materialized")], F.lit(True).alias("_patched"))
    patched = F.col("_patched")
    changed = {
        "label": F.coalesce(F.nullif("_label", F.lit("")), F.col("label")),
        "type": F.coalesce(F.nullif("_type", F.lit("")), F.col("type")),
        "virtual_class_id": F.when(patched, F.nullif("_virtual_class_id", F.lit(""))).otherwise(F.col("virtual_class_id")),
        "virtual_directory": F.when(patched, F.nullif("_virtual_directory", F.lit(""))).otherwise(F.col("virtual_directory")),
        "materialized": F.coalesce("_materialized", "materialized"),
    }
    joined = virtual.join(new, "id", "left")
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in virtual.columns])


# --- calls and symbols ----------------------------------------------------------------------------


def is_manual() -> Column:
    return F.col("call_type") == "manual"


def append_calls(calls: DataFrame, batch: DataFrame) -> DataFrame:
    """Add a batch of calls; repeats are kept."""
    return calls.unionByName(batch.select(*calls.columns))


def replace_index(
    calls: DataFrame, new_symbols: DataFrame, new_calls: DataFrame, order: str, rebuild: bool = False
) -> tuple[DataFrame, DataFrame]:
    """New symbols and calls after a full index run.

    Symbols are replaced, the last of equal ids winning. Manual calls survive unless ``rebuild``.
    """
    kept = calls.limit(0) if rebuild else calls.where(is_manual())
    return last_per_key(new_symbols, ["id"], order), append_calls(kept, new_calls)


def clear_index(symbols: DataFrame, calls: DataFrame, rebuild: bool = False, by_type: bool = False) -> tuple[DataFrame, DataFrame]:
    """Drop all symbols and the indexed calls, or with ``rebuild`` every call.

    A call counts as indexed if it has a file; with ``by_type``, if its type is not manual.
    """
    keep = F.lit(False) if rebuild else (is_manual() if by_type else F.col("file_path") == "")
    return symbols.limit(0), calls.where(keep)


def purge_files(table: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of ``table`` that are not of the given files (``file_path``)."""
    return skew_join(table, files.select("file_path").distinct(), "file_path", "left_anti")


def delete_manual_edges(calls: DataFrame, edge_annotations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete user-made calls for the edges ``gone`` (``edge_id``), and their remarks in any case."""
    eid = F.col("edge_id")
    pairs = gone.select(ids.edge_source(eid).alias("caller_id"), ids.edge_target(eid).alias("callee_id")).distinct()
    manual = skew_join(calls.where(is_manual()), pairs, ["caller_id", "callee_id"], "left_anti")
    left = calls.where(~is_manual()).unionByName(manual)
    return left, edge_annotations.join(gone.select("edge_id").distinct(), "edge_id", "left_anti")


def _untouched(table: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        table = skew_join(table, nodes.withColumnRenamed("id", c), c, "left_anti")
    return table


def delete_virtual_cascade(
    virtual: DataFrame, annotations: DataFrame, edge_annotations: DataFrame, calls: DataFrame, gone: DataFrame
) -> dict[str, DataFrame]:
    """Delete planned nodes with their notes, the remarks on their edges and their user-made calls."""
    drop = gone.select("id").distinct()
    manual = _untouched(calls.where(is_manual()), drop, "caller_id", "callee_id")
    return {
        "virtual_nodes": _untouched(virtual, drop, "id"),
        "node_annotations": _untouched(annotations, drop, "node_id"),
        "edge_annotations": _untouched(edge_annotations, drop, "source_node_id", "target_node_id"),
        "method_calls": calls.where(~is_manual()).unionByName(manual),
    }


def clear_overlay(
    virtual: DataFrame, annotations: DataFrame, edge_annotations: DataFrame, calls: DataFrame, directories: DataFrame
) -> dict[str, DataFrame]:
    """Remove everything users laid over the index; notes on real nodes stay."""
    planned = virtual.select("id").distinct()
    made = calls.where(is_manual()).select(ids.edge_id(F.col("caller_id"), F.col("callee_id")).alias("edge_id")).distinct()
    remarks = edge_annotations.join(made, "edge_id", "left_anti")
    return {
        "virtual_nodes": virtual.limit(0),
        "virtual_directories": directories.limit(0),
        "node_annotations": _untouched(annotations, planned, "node_id"),
        "edge_annotations": _untouched(remarks, planned, "source_node_id", "target_node_id"),
        "method_calls": calls.where(~is_manual()),
    }


def endpoint_ids(symbols: DataFrame, virtual: DataFrame, directories: DataFrame) -> DataFrame:
    """Every id an edge may be drawn to."""
    hashed = directories.select(ids.path_id(F.col("path")).alias("id"))
    return symbols.select("id").unionByName(virtual.select("id")).unionByName(hashed).distinct()


def create_manual_edges(requests: DataFrame, endpoints: DataFrame, edge_annotations: DataFrame) -> tuple[DataFrame, ...]:
    """Turn edge requests (``request_id, source_id, target_id, remarks``) into user-made calls.

    Returns accepted requests as ``edge_id, …, call_count, remarks`` answers, the calls to append, and
    the rejected requests, whose ends are not both known. The count in an answer is the stored one.
    """
    src = endpoints.withColumnRenamed("id", "source_id")
    dst = endpoints.withColumnRenamed("id", "target_id")
    good = skew_join(skew_join(requests, src, "source_id", "left_semi"), dst, "target_id", "left_semi")
    rejected = requests.join(good.select("request_id"), "request_id", "left_anti")
    calls = good.select(
        F.col("source_id").alias("caller_id"), F.col("target_id").alias("callee_id"), F.lit("manual").alias("call_type"),
        F.lit("").alias("file_path"), F.lit(0).alias("line"),
    )
    # A remark stored by an earlier request of the same run is the stored one for the answer.
    edge = good.withColumn("edge_id", ids.edge_id(F.col("source_id"), F.col("target_id")))
    spoken = edge.where(F.col("remarks") != "").groupBy("edge_id").agg(F.max_by("remarks", "request_id").alias("_new"))
    stored = edge_annotations.select("edge_id", F.col("remarks").alias("_old"), F.col("call_count").alias("_count"))
    answers = edge.select("request_id", "edge_id").join(spoken, "edge_id", "left").join(stored, "edge_id", "left").select(
        "request_id", "edge_id", F.coalesce("_count", F.lit(1)).cast("int").alias("call_count"), F.lit(True).alias("is_manual"),
        F.coalesce("_new", "_old", F.lit("")).alias("remarks"),
    )
    return answers, calls, rejected


def create_virtual_nodes(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New planned nodes (``request_id, label, type, virtual_class_id, virtual_directory``) and the rejects.

    Ids derive from the request, so a rerun gives the same ones. Empty text becomes NULL.
    """
    good = (F.coalesce("label", F.lit("")) != "") & (F.coalesce("type", F.lit("")) != "")
    created = requests.where(good).select(
        F.concat(F.lit("vnode_"), F.substring(F.sha2(F.concat_ws(":", "request_id", "label", "type"), 256), 1, 32)).alias("id"),
        "label", "type", F.nullif("virtual_class_id", F.lit("")).alias("virtual_class_id"),
        F.nullif("virtual_directory", F.lit("")).alias("virtual_directory"), F.lit(False).alias("materialized"),
    )
    return created, requests.where(~good)


def create_directories(requests: DataFrame, directories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New planned directories (``request_id, path, name, parent_path``) and the rejects.

    A path may exist once: the first request for it wins, and none if it is already there.
    """
    first = requests.groupBy("path").agg(F.min("request_id").alias("request_id"))
    fresh = first.join(directories.select("path"), "path", "left_anti")
    won = requests.join(fresh, ["path", "request_id"], "left_semi")
    created = won.select(
        F.concat(F.lit("vdir_"), F.substring(F.sha2(F.concat_ws(":", "request_id", "path"), 256), 1, 32)).alias("id"),
        "path", "name", F.nullif("parent_path", F.lit("")).alias("parent_path"),
    )
    return created, requests.join(fresh, ["path", "request_id"], "left_anti")


def delete_by_key(table: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows left after deleting the given keys, and the keys that were not there."""
    wanted = gone.select(key).distinct()
    return table.join(wanted, key, "left_anti"), wanted.join(table.select(key), key, "left_anti")


def apply_prompts(snapshots: DataFrame, generated: DataFrame) -> DataFrame:
    """``id, prompt, is_custom``: the custom text of a snapshot, else the generated one."""
    custom = F.nullif("custom_prompt", F.lit(""))
    return snapshots.join(generated, "id", "left").select(
        "id", F.coalesce(custom, "generated", F.lit("")).alias("prompt"), custom.isNotNull().alias("is_custom")
    )


def override_prompts(snapshots: DataFrame, changes: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Set (``prompt``) or clear (NULL) custom texts by snapshot ``id``; unknown ids come back as rejects."""
    last = changes.groupBy("id").agg(F.max_by(F.struct("prompt"), order).alias("_change"))
    new = F.when(F.col("_change").isNotNull(), F.col("_change.prompt")).otherwise(F.col("custom_prompt"))
    out = snapshots.join(last, "id", "left").withColumn("custom_prompt", new).select(*snapshots.columns)
    return out, last.select("id").join(snapshots.select("id"), "id", "left_anti")


# --- incremental ----------------------------------------------------------------------------------


def cache_state(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """``file_path, state``: same, changed, new or gone, by fingerprint (``file_path, file_hash``)."""
    old = manifest.select("file_path", F.col("file_hash").alias("_old"))
    new = current.select("file_path", F.col("file_hash").alias("_new"))
    state = (
        F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone")
        .when(F.col("_old") == F.col("_new"), "same").otherwise("changed")
    )
    return old.join(new, "file_path", "full_outer").select("file_path", state.alias("state"))


CALLABLE_KINDS = ("method", "constructor", "function")


def unit_diff(old: DataFrame, new: DataFrame, strict_reference: bool = False) -> DataFrame:
    """``id, change``: changed (new or other hash), removed, or same; units are ``id, kind, body_hash``.

    With ``strict_reference`` functions on the old side are not looked at, so they always count as
    changed and never as removed.
    """
    kinds = CALLABLE_KINDS[:2] if strict_reference else CALLABLE_KINDS
    a = old.where(F.col("kind").isin(*kinds)).select("id", F.col("body_hash").alias("_old"))
    b = new.select("id", F.col("body_hash").alias("_new"))
    change = (
        F.when(F.col("_new").isNull(), "removed")
        .when(F.col("_old").isNull() | (F.col("_old") != F.col("_new")), "changed").otherwise("same")
    )
    return a.join(b, "id", "full_outer").select("id", change.alias("change"))


def apply_file_delta(
    symbols: DataFrame,
    calls: DataFrame,
    manifest: DataFrame,
    files: DataFrame,
    new_symbols: DataFrame,
    diff: DataFrame,
    new_calls: DataFrame,
    order: str,
) -> dict[str, DataFrame]:
    """New tables after some files were saved.

    ``files`` (``file_path, file_hash``) names the saved files, ``new_symbols`` all their symbols,
    ``diff`` (``id, change``) the outcome of :func:`unit_diff`, and ``new_calls`` the calls of changed
    units. Manual calls are never touched. Further columns of ``manifest`` come from ``files`` where it has them.
    """
    fresh = last_per_key(new_symbols, ["id"], order).select(*symbols.columns)
    kept = skew_join(symbols, files.select("file_path").distinct(), "file_path", "left_anti")
    kept = kept.join(fresh.select("id"), "id", "left_anti").select(*symbols.columns)
    stale = diff.where(F.col("change").isin("changed", "removed")).select("id").distinct()
    removed = diff.where(F.col("change") == "removed").select("id").distinct()
    indexed = skew_join(calls.where(~is_manual()), stale.withColumnRenamed("id", "caller_id"), "caller_id", "left_anti")
    indexed = skew_join(indexed, removed.withColumnRenamed("id", "callee_id"), "callee_id", "left_anti")
    told = [c for c in manifest.columns if c in files.columns]
    seen = files.where((F.col("file_path") != "") & (F.coalesce("file_hash", F.lit("")) != "")).select(*told)
    return {
        "symbols": kept.unionByName(fresh),
        "method_calls": calls.where(is_manual()).unionByName(indexed).unionByName(new_calls.select(*calls.columns)),
        "manifest": manifest.join(seen, "file_path", "left_anti").unionByName(seen, allowMissingColumns=True).select(*manifest.columns),
    }


def indexed_files(symbols: DataFrame, manifest: DataFrame) -> DataFrame:
    """Distinct paths that the index knows."""
    both = symbols.select("file_path").unionByName(manifest.select("file_path"))
    return both.where(F.col("file_path") != "").distinct()


def stale_files(indexed: DataFrame, corpus: DataFrame) -> DataFrame:
    """Indexed paths that the corpus no longer has."""
    return indexed.join(corpus.select("file_path").distinct(), "file_path", "left_anti")


def mark_materialised(virtual: DataFrame, symbols: DataFrame, ignore_parameters: bool = False) -> DataFrame:
    """Set ``materialized`` where the label is the name of one of the given symbols.

    With ``ignore_parameters`` a symbol also matches by its name without ``(…)``.
    """
    names = symbols.select(F.col("name").alias("label"))
    if ignore_parameters:
        names = names.unionByName(symbols.select(F.substring_index("name", "(", 1).alias("label")))
    hit = names.distinct().withColumn("_hit", F.lit(True))
    built = F.col("materialized").cast("boolean") | F.coalesce("_hit", F.lit(False))
    return skew_join(virtual, hit, "label", "left").withColumn("materialized", built).select(*virtual.columns)

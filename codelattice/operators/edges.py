"""Edges: resolving call endpoints, rolling calls up, and walking the graph."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.functions import ids
from codelattice.operators.nodes import text_or_empty
from codelattice.operators.skew import HOT_SHARE, skew_join
from codelattice.session import cut_lineage, stored


def endpoint_keys(nodes: DataFrame, directories: DataFrame | None = None) -> DataFrame:
    """``key, node_id``: what a call may name, by label or id, and the node it means.

    Where several nodes answer to a key the last one wins, in the order of nodes by (label, id), each
    with its label before its id, and then directories by path.
    """
    def claims(df: DataFrame, group: int, name: Column, node: Column, place: Column) -> DataFrame:
        """Two rows per node: its name, then its id, both for ``node``."""
        def claim(key: Column, slot: int) -> Column:
            order = F.struct(F.lit(group).alias("g"), place.alias("a"), node.alias("b"), F.lit(slot).alias("s"))
            return F.struct(key.alias("key"), node.alias("node_id"), order.alias("ord"))

        return df.select(F.inline(F.array(claim(name, 0), claim(node, 1))))

    table = claims(nodes, 0, F.col("label"), F.col("id"), F.col("label"))
    if directories is not None:
        path = F.col("path")
        table = table.unionByName(claims(directories, 1, F.col("name"), ids.path_id(path), path))
    return table.groupBy("key").agg(F.max_by("node_id", "ord").alias("node_id"))


@dataclass(frozen=True)
class Hubs:
    """Callers and callees that own a large share of the counted pairs; see ``hot_keys``."""

    callers: Sequence[str] = ()
    callees: Sequence[str] = ()


def find_hubs(pairs: DataFrame, share: float = HOT_SHARE) -> Hubs:
    """Look for hubs, to pass to the roll-up of a graph that may have them; one job, at most ``1 / share`` values an end."""
    ends = pairs.select(F.inline(F.array(
        F.struct(F.lit(True).alias("calling"), F.col("caller_id").alias("id")), F.struct(F.lit(False).alias("calling"), F.col("callee_id").alias("id")))))
    counts = ends.groupBy("calling", "id").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("calling").agg(F.sum("n").alias("total"))
    hot = counts.where("id IS NOT NULL").join(total, "calling").where(F.col("n") >= F.col("total") * F.lit(share))
    found = hot.select("calling", "id").collect()
    return Hubs([r.id for r in found if r.calling], [r.id for r in found if not r.calling])


def call_pairs(calls: DataFrame) -> DataFrame:
    """Calls counted per written (caller, callee); the first, map-side step of every roll-up."""
    return calls.groupBy("caller_id", "callee_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("call_type") == "manual").alias("manual")
    )


def counted(calls: DataFrame, share: float = HOT_SHARE) -> tuple[DataFrame, Hubs]:
    """Counted pairs, written once, and their hubs."""
    pairs = cut_lineage(call_pairs(calls))
    return pairs, find_hubs(pairs, share)


def resolve_endpoints(pairs: DataFrame, keys: DataFrame, hot: Hubs | None = None) -> DataFrame:
    """Add ``source`` and ``target``; rows with an unknown end are dropped."""
    hot = hot or Hubs()
    callers = keys.select(F.col("key").alias("caller_id"), F.col("node_id").alias("source"))
    callees = keys.select(F.col("key").alias("callee_id"), F.col("node_id").alias("target"))
    known = skew_join(pairs, callers, "caller_id", hot=hot.callers)
    return skew_join(known, callees, "callee_id", hot=hot.callees)


def annotate_edges(edges: DataFrame, edge_annotations: DataFrame) -> DataFrame:
    """Attach remarks by edge id; empty where there are none."""
    notes = edge_annotations.select("edge_id", "remarks")
    return edges.join(notes, "edge_id", "left").select(*edges.columns, text_or_empty("remarks").alias("remarks"))


def roll_up(pairs: DataFrame, keys: DataFrame, *by: str, hot: Hubs | None = None) -> DataFrame:
    """Directed edges, one row each, with call count and manual flag from counted pairs.

    They come out partitioned by ``edge_id``, so that a join with remarks needs no shuffle of its own. An edge has
    no more than four pairs, by id or label at each end, so there is nothing to count before the shuffle.
    """
    named = resolve_endpoints(pairs, keys, hot).withColumn("edge_id", ids.edge_id(F.col("source"), F.col("target")))
    return (
        named.repartition("edge_id").groupBy(*by, "edge_id", "source", "target")
        .agg(F.sum("n").alias("call_count"), F.max("manual").alias("is_manual"))
    )


def edge_rollup(
    calls: DataFrame,
    nodes: DataFrame,
    directories: DataFrame | None,
    edge_annotations: DataFrame,
    hot: Hubs | None = None,
) -> DataFrame:
    """The call graph as weighted, annotated, directed edges."""
    pairs, hubs = counted(calls)
    return annotate_edges(roll_up(pairs, endpoint_keys(nodes, directories), hot=hot or hubs), edge_annotations)


def both_ways(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs ``a, b`` in both directions, in one pass over ``df``."""
    here, there = F.col(a), F.col(b)
    return df.select(F.inline(F.array(F.struct(here.alias(a), there.alias(b)), F.struct(there.alias(a), here.alias(b)))))


def neighbour_ids(calls: DataFrame, edge_annotations: DataFrame, seeds: DataFrame) -> DataFrame:
    """``seed_id, id``: other ends of calls and annotated edges at each seed, in either direction.

    Links are filtered by the seeds before anything else, so few seeds cost one scan.
    """
    links = calls.select(F.col("caller_id").alias("a"), F.col("callee_id").alias("b")).unionByName(
        edge_annotations.select(F.col("source_node_id").alias("a"), F.col("target_node_id").alias("b")))
    wanted = seeds.select(F.col("id").alias("a")).distinct()
    near = skew_join(both_ways(links, "a", "b"), wanted, "a", "left_semi")
    return near.select(F.col("a").alias("seed_id"), F.col("b").alias("id")).distinct()


def _touching(calls: DataFrame, seed_nodes: DataFrame, known: DataFrame, hubs: Hubs | None, sift: bool) -> DataFrame:
    """Counted calls between known ends, a row for each seed they touch: ``seed_id, out``, all columns of ``resolve_endpoints``.

    A call between a seed's id and its label touches it once, as an outgoing one. Calls are counted and resolved once for both
    directions and all seeds, and fan out to seeds last, so a label of m seeds makes m rows for each pair that names it.
    """
    hubs = hubs or Hubs()
    seeds = seed_nodes.select(F.col("id").alias("seed_id"), F.col("label").alias("_label")).distinct()
    names = seeds.select("*", F.explode(F.array_distinct(F.array("seed_id", "_label"))).alias("key"))
    if sift:
        ours, out = names.select("key").distinct(), calls
        for end in ("caller_id", "callee_id"):
            out = skew_join(out, ours.select(F.col("key").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
        calls = out.where("_caller_id OR _callee_id").select(*calls.columns)
    placed = resolve_endpoints(call_pairs(calls), known, hubs)
    shown = ["seed_id", "out", *placed.columns]
    caller = F.col("caller_id")
    leaving = skew_join(placed, names.withColumnRenamed("key", "caller_id"), "caller_id", hot=hubs.callers)
    coming = skew_join(placed, names.withColumnRenamed("key", "callee_id"), "callee_id", hot=hubs.callees)
    coming = coming.where(~caller.eqNullSafe(F.col("seed_id")) & ~caller.eqNullSafe(F.col("_label")))
    return leaving.withColumn("out", F.lit(True)).select(*shown).unionByName(coming.withColumn("out", F.lit(False)).select(*shown))


def neighbourhood_edges(
    calls: DataFrame, seed_nodes: DataFrame, nodes: DataFrame, hubs: Hubs | None = None, sift: bool = True
) -> DataFrame:
    """Rolled-up edges between each seed and its neighbours, with the neighbour on the far end.

    ``seed_nodes`` has ``id, label``, a row for each id; a call touches a seed if it names the seed's id or label. Result:
    ``seed_id, edge_id, source, target, call_count, is_manual`` and ``other_id``. ``hubs`` are of ``calls``. With ``sift``
    calls that no seed touches go first, so few seeds cost one scan; where nearly all nodes are seeds, do without.
    """
    parts = _touching(calls, seed_nodes, endpoint_keys(nodes), hubs, sift).select("seed_id", "source", "target", "out", "n", "manual")
    # An edge of a seed has no more than four pairs, so there is nothing to count before the shuffle.
    sides = parts.repartition("seed_id", "source", "target").groupBy("seed_id", "source", "target").agg(*[
        f(F.when(F.col("out") == side, F.col(c))).alias(f"{c}_{name}") for c, f in (("n", F.sum), ("manual", F.max)) for side, name in ((True, "out"), (False, "in"))])

    def side(name: str, other: str) -> Column:
        return F.struct(F.col(other).alias("other_id"), F.col(f"n_{name}").alias("call_count"), F.col(f"manual_{name}").alias("manual"))

    n_out, n_in, zero, no = F.col("n_out"), F.col("n_in"), F.lit(0), F.lit(False)
    loop = F.struct(
        F.col("target").alias("other_id"), (F.coalesce(n_out, zero) + F.coalesce(n_in, zero)).alias("call_count"),
        (F.coalesce("manual_out", no) | F.coalesce("manual_in", no)).alias("manual"))
    both = F.when(F.col("source") == F.col("target"), F.array(loop)).when(n_in.isNull(), F.array(side("out", "target"))).when(
        n_out.isNull(), F.array(side("in", "source"))).otherwise(F.array(side("out", "target"), side("in", "source")))
    return sides.select("seed_id", "source", "target", F.inline(both)).select(
        "seed_id", "source", "target", "other_id", "call_count", F.coalesce("manual", no).alias("is_manual"), ids.edge_id(F.col("source"), F.col("target")).alias("edge_id"))


def merge_neighbourhood_edges(found: DataFrame) -> DataFrame:
    """One row per seed and edge, whichever end was the seed's."""
    return found.groupBy("seed_id", "edge_id", "source", "target").agg(
        F.sum("call_count").alias("call_count"), F.max("is_manual").alias("is_manual")
    )


def neighbourhood_node_ids(
    calls: DataFrame, seed_nodes: DataFrame, nodes: DataFrame, hubs: Hubs | None = None, sift: bool = True
) -> DataFrame:
    """``seed_id, id``: each seed and its neighbours among ``nodes``, once each; see :func:`neighbourhood_edges`.

    Whether a neighbour is met again on another edge does not matter here, so nothing is rolled up per edge.
    """
    other = F.when(F.col("out"), F.col("target")).otherwise(F.col("source"))
    near = _touching(calls, seed_nodes, endpoint_keys(nodes), hubs, sift).select("seed_id", other.alias("id"))
    return near.unionByName(seed_nodes.select(F.col("id").alias("seed_id"), "id")).repartition("seed_id", "id").distinct()


def neighbourhood_files(
    calls: DataFrame, seed_nodes: DataFrame, nodes: DataFrame, hubs: Hubs | None = None, sift: bool = True
) -> DataFrame:
    """``seed_id, path``: files of the real nodes among each seed and its neighbours, once each.

    Names bring the file of their node along, so that neighbours need not be brought together and looked up once more.
    """
    real = nodes.where(~F.col("is_virtual") & (F.col("file_path") != "")).select(F.col("id").alias("node_id"), F.col("file_path").alias("path"))
    known = endpoint_keys(nodes).join(real, "node_id", "left").select("key", F.struct("node_id", "path").alias("node_id"))
    path = F.when(F.col("out"), F.col("target.path")).otherwise(F.col("source.path"))
    near = _touching(calls, seed_nodes, known, hubs, sift).select("seed_id", path.alias("path")).where("path IS NOT NULL")
    own = seed_nodes.select(F.col("id").alias("node_id")).join(real, "node_id").select(F.col("node_id").alias("seed_id"), "path")
    return near.unionByName(own).distinct()


def khop_nodes(edges: DataFrame, seeds: DataFrame, k: int, checkpoint_every: int = 3) -> DataFrame:
    """``id, hop``: nodes within ``k`` undirected steps of the seeds and the least number of steps."""
    adjacency = both_ways(edges, "source", "target").toDF("id", "other")  # what a step reaches is made distinct, so equal edges do no harm
    reached = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    frontier = reached
    for hop in range(1, k + 1):
        step = skew_join(adjacency, frontier.select("id"), "id", "left_semi")
        frontier = (
            step.select(F.col("other").alias("id")).distinct()
            .join(reached.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))
        )
        if hop < k:
            frontier = stored(frontier)  # read by the next step, to leave out what is known, and in the result
        reached = reached.unionByName(frontier)
        if hop % checkpoint_every == 0 and hop < k:
            reached = cut_lineage(reached)
            frontier = reached.where(F.col("hop") == hop)
    return reached


def khop_edges(edges: DataFrame, reached: DataFrame, k: int) -> DataFrame:
    """Edges that expanding every node closer than ``k`` steps brings in."""
    opened = reached.where(F.col("hop") < k).select("id")
    at_source = opened.withColumnRenamed("id", "source")
    by_source = skew_join(edges, at_source, "source", "left_semi")
    rest = skew_join(edges, at_source, "source", "left_anti")
    return by_source.unionByName(skew_join(rest, opened.withColumnRenamed("id", "target"), "target", "left_semi"))


def induced_edges(edges: DataFrame, node_ids: DataFrame) -> DataFrame:
    """Edges whose two ends are both in ``node_ids``."""
    kept = node_ids.select("id").distinct()
    part = skew_join(edges, kept.withColumnRenamed("id", "source"), "source", "left_semi")
    return skew_join(part, kept.withColumnRenamed("id", "target"), "target", "left_semi")


def connected_edges(edges: DataFrame, focus: DataFrame, node_ids: DataFrame) -> DataFrame:
    """Edges at a node of ``focus`` whose other end is in ``node_ids``."""
    tagged = focus.select("id", F.lit(True).alias("at"), F.lit(False).alias("kept")).unionByName(
        node_ids.select("id", F.lit(False).alias("at"), F.lit(True).alias("kept")))
    roles = tagged.groupBy("id").agg(F.max("at").alias("at"), F.max("kept").alias("kept"))

    def side(end: str) -> DataFrame:
        return roles.select(F.col("id").alias(end), F.col("at").alias(f"_{end}_at"), F.col("kept").alias(f"_{end}_kept"))

    found = skew_join(skew_join(edges, side("source"), "source"), side("target"), "target")
    joined = F.col("_source_at") & F.col("_target_kept") | F.col("_target_at") & F.col("_source_kept")
    return found.where(joined).select(*edges.columns)


def merge_new(existing: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """Append rows of ``batch`` whose key is not present yet; repeats inside the batch stay."""
    return existing.unionByName(batch.join(existing.select(key).distinct(), key, "left_anti").select(*existing.columns))


def remove_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges left after the nodes ``gone`` (``id``) are removed."""
    drop = gone.select("id").distinct()
    part = skew_join(edges, drop.withColumnRenamed("id", "source"), "source", "left_anti")
    return skew_join(part, drop.withColumnRenamed("id", "target"), "target", "left_anti")


def view_edges(edges: DataFrame, visible: DataFrame) -> DataFrame:
    """Edges between visible nodes, flagged if a user made them or an end is planned."""
    shown = visible.groupBy("id").agg(F.max("is_virtual").alias("planned"))
    src = shown.select(F.col("id").alias("source"), F.col("planned").alias("_s"))
    dst = shown.select(F.col("id").alias("target"), F.col("planned").alias("_t"))
    marked = skew_join(skew_join(edges, src, "source"), dst, "target")
    return marked.select(*edges.columns, (F.col("is_manual") | F.col("_s") | F.col("_t")).alias("user_created"))


def refresh_view(previous: DataFrame, fresh_nodes: DataFrame, fresh_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a view after new data came in.

    Nodes still present are renewed, folder and file placeholders stay, everything else goes.
    """
    seen = previous.select("id").distinct()
    renewed = fresh_nodes.join(seen, "id", "left_semi")
    boxes = previous.where(F.col("type").isin("directory", "file")).join(renewed.select("id"), "id", "left_anti")
    nodes = renewed.unionByName(boxes.select(*fresh_nodes.columns))
    return nodes, induced_edges(fresh_edges, nodes)

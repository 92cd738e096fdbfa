"""Snapshot trees and reports, as ordered rows of text.

A report is a table of lines with a sort key, so a snapshot of any size is formatted in parallel;
``write_report`` turns it into ordered text files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.operators.nodes import text_or_empty
from codelattice.operators.ranks import numbered, running_sum
from codelattice.operators.skew import first_per_key, skew_join
from codelattice.session import stored

KEY = ["snapshot_id", "id"]


def virtual_tree(nodes: DataFrame) -> DataFrame:
    """Planned nodes with ``depth``, ``order`` (sort key of the walk) and ``flat``.

    Roots have no parent; children follow their parent by label. Nodes under an absent parent, or above themselves, are
    left out. A snapshot without any root is a flat list. Ids name nodes: rows that repeat one stand together.

    Pointers to ancestors double their reach with each round, so a tree of depth d takes some log(d) rounds. They carry
    how many nodes are below each node, which gives each its place among its siblings, and then the sum of those
    places, which is the node's place in the walk.
    """
    planned = nodes.where("is_virtual")
    roots = planned.where(text_or_empty("parent_id") == "").select("snapshot_id").distinct()
    shape = stored(first_per_key(planned.select(*KEY, "label", text_or_empty("parent_id").alias("parent")), KEY, "label", "parent").join(roots, "snapshot_id", "left_semi"))
    known = shape.select("snapshot_id", F.col("id").alias("parent"), F.lit(True).alias("_known"))
    linked = skew_join(shape, known, ["snapshot_id", "parent"], "left")
    up = F.when(F.coalesce("_known", F.lit(False)), F.col("parent"))
    start = linked.select(*KEY, up.alias("up"), ((F.col("parent") != "") & up.isNull()).alias("lost"), F.lit(1).cast("bigint").alias("below"), up.isNotNull().cast("int").alias("depth"))
    count, rounds, found = shape.count(), 0, start
    while 2**rounds <= count:  # what still has an ancestor after that is above itself
        open_, rounds = found.where("up is not null"), rounds + 1
        gained = open_.groupBy("snapshot_id", F.col("up").alias("id")).agg(F.sum("below").alias("_gained"))
        above = found.select("snapshot_id", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("lost").alias("_lost"), F.col("depth").alias("_depth"))
        nearer = skew_join(found, above, ["snapshot_id", "up"], "left")
        found = stored(skew_join(nearer, gained, KEY, "left").select(
            *KEY, F.col("_up").alias("up"), (F.col("lost") | F.coalesce("_lost", F.lit(False))).alias("lost"),
            (F.col("below") + F.coalesce("_gained", F.lit(0))).alias("below"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")))
        if found.where("up is not null").isEmpty():
            break
    kept = shape.join(found.where("up is null and not lost").select(*KEY, "below", "depth"), KEY)
    ahead = running_sum(kept, ["snapshot_id", "parent"], ["label", "id"], F.col("below"), "ahead")
    place = stored(ahead.select(*KEY, F.nullif("parent", F.lit("")).alias("up"), "depth", (F.col("ahead") + (F.col("parent") != "").cast("int")).alias("place")))
    for _ in range(rounds):
        above = place.select("snapshot_id", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("place").alias("_place"))
        place = stored(skew_join(place, above, ["snapshot_id", "up"], "left").select(
            *KEY, F.col("_up").alias("up"), "depth", (F.col("place") + F.coalesce("_place", F.lit(0))).alias("place")))

    def key(number):
        return F.array(F.struct(_sortable(number).alias("label"), F.col("id")))

    walked = planned.join(place.select(*KEY, "depth", "place"), KEY).select(*planned.columns, "depth", key(F.col("place")).alias("order"), F.lit(False).alias("flat"))
    rootless = planned.join(roots, "snapshot_id", "left_anti")
    return walked.unionByName(rootless.select("*", F.lit(0).alias("depth"), key(F.col("seq")).alias("order"), F.lit(True).alias("flat")))


def _sortable(number: Column) -> Column:
    """A bigint as text that sorts like the number, negative ones included."""
    shifted = number.bitwiseAND(F.lit(2**63 - 1))  # a negative number without its sign bit
    return F.concat(F.when(number < 0, "0").otherwise("1"), F.lpad(shifted.cast("string"), 19, "0"))


# The texts of a report.
ADVICE = "*Use this context to inform your response. Proceed with whatever the user asked.*"
USAGE = (
    "**Usage:** Use the virtual nodes, context nodes, and relationships above to inform your understanding. "
    "Respond to the user's actual request (e.g., generate, explain, refactor, add tests)."
)
PLANNED_TITLE, NO_PLANNED = "## Virtual Design", "No virtual nodes."
PLANNED_INTRO = "Methods/classes to implement or refine:"
CONTEXT_TITLE, NO_CONTEXT = "## Context Nodes (Existing Code)", "No context nodes."
CONTEXT_INTRO = "Reference these existing implementations for patterns and integration:"
RELATION_TITLE, NO_RELATION = "## Relationships", "No relationships defined."
RELATION_INTRO = "How components connect:"
NO_FILE = "(no file)"


def _lines(df: DataFrame, section: int, items: list[tuple[str, Column | str, Column | None]], *order: Column) -> DataFrame:
    """Rows for a fixed run of lines per row of ``df``: ``(kind, text, condition)``, in this order."""
    entries = [
        F.when(F.lit(True) if cond is None else cond, F.struct(F.lit(i).alias("step"), F.lit(kind).alias("kind"),
               (F.lit(text) if isinstance(text, str) else text).alias("line")))
        for i, (kind, text, cond) in enumerate(items)
    ]
    key = F.array(*[F.struct(c.cast("string").alias("label"), F.lit("").alias("id")).cast("struct<label:string,id:string>") for c in order]) if order else F.array().cast("array<struct<label:string,id:string>>")
    return df.select("snapshot_id", F.lit(section).alias("section"), key.alias("order"), F.explode(F.array_compact(F.array(*entries))).alias("e")).select(
        "snapshot_id", "section", "order", "e.step", "e.kind", "e.line")


def _labels(nodes: DataFrame) -> DataFrame:
    """Label per node id; a context node's label overrides a planned one's."""
    return nodes.groupBy(*KEY).agg(F.max_by("label", F.struct((~F.col("is_virtual")).alias("later"), "seq")).alias("_label"),
                                   F.max("is_virtual").alias("_virtual"))


def _edge_texts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with shown labels and whether each end is planned."""
    labels, out = _labels(nodes), edges
    for end, name in (("source_id", "source"), ("target_id", "target")):
        side = labels.select("snapshot_id", F.col("id").alias(end), F.col("_label").alias(f"_{name}"), F.col("_virtual").alias(f"{name}_virtual"))
        out = skew_join(out, side, ["snapshot_id", end], "left").withColumn(
            f"{name}_label", F.coalesce(F.nullif(f"_{name}", F.lit("")), end)
        ).withColumn(f"{name}_virtual", F.coalesce(f"{name}_virtual", F.lit(False))).drop(f"_{name}")
    return out


def _related(texts: DataFrame) -> DataFrame:
    """``snapshot_id, id, seq, line``: one line per edge at a node."""
    mark = F.lit(" (virtual)")
    out = F.concat(F.lit("→ "), "target_label", F.when(F.col("target_virtual"), mark).otherwise(""))
    into = F.concat(F.lit("← "), "source_label", F.when(F.col("source_virtual"), mark).otherwise(""))
    loops = F.col("source_id") != F.col("target_id")
    return texts.select("snapshot_id", F.col("source_id").alias("id"), "seq", out.alias("line")).unionByName(
        texts.where(loops).select("snapshot_id", F.col("target_id").alias("id"), "seq", into.alias("line")))


def report_lines(snapshots: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``snapshot_id, section, order, step, kind, line`` for each snapshot (``id, name``).

    Sorted by the first four columns the lines are the report. A node's related edges are one line each.
    """
    counts = nodes.groupBy("snapshot_id").agg(F.count_if("is_virtual").alias("v"), F.count_if(~F.col("is_virtual")).alias("c"))
    linked = edges.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("e"))
    head = snapshots.withColumnRenamed("id", "snapshot_id").join(counts, "snapshot_id", "left").join(linked, "snapshot_id", "left").na.fill(0, ["v", "c", "e"])

    def part(n, text):
        return F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(text)))

    summary = F.concat_ws(", ", part("v", " virtual node(s)"), part("c", " context node(s)"), part("e", " relationship(s)"))
    total = F.when(summary == "", F.lit("Empty snapshot.")).otherwise(F.concat(summary, F.lit(".")))
    named = text_or_empty("name") != ""
    parts = [
        _lines(head, 0, [
            ("title", F.concat(F.lit("# Graph Snapshot: "), "snapshot_id"), None), ("gap", "", None),
            ("name", F.concat(F.lit("**Name:** "), "name"), named), ("gap", "", named),
            ("summary", F.concat(F.lit("**Summary:** "), total), None), ("gap", "", None), ("advice", ADVICE, None), ("gap", "", None),
            ("rule", "---", None), ("gap", "", None)]),
        *[
            _lines(head, section, [
                ("heading", title, None), ("gap", "", None), ("none", empty, F.col(n) == 0), ("intro", intro, F.col(n) > 0), ("gap", "", None)])
            for section, title, empty, intro, n in (
                (1, PLANNED_TITLE, NO_PLANNED, PLANNED_INTRO, "v"), (3, CONTEXT_TITLE, NO_CONTEXT, CONTEXT_INTRO, "c"),
                (5, RELATION_TITLE, NO_RELATION, RELATION_INTRO, "e"))
        ],
        _lines(head.where("e > 0"), 7, [("gap", "", None)]),
        _lines(head, 8, [("rule", "---", None), ("gap", "", None), ("usage", USAGE, None)]),
    ]

    texts = _edge_texts(edges, nodes)
    parts += _planned_lines(virtual_tree(nodes), _related(texts))

    context = nodes.where(~F.col("is_virtual")).withColumn("_file", F.when(text_or_empty("file_path") == "", F.lit(NO_FILE)).otherwise(F.col("file_path")))
    item = F.concat(
        F.lit("- **"), "label", F.lit("**"), F.when(F.col("line") > 0, F.concat(F.lit(" (line "), F.col("line").cast("string"), F.lit(")"))).otherwise(""),
        F.lit(" — "), "type", F.when(text_or_empty("description") != "", F.concat(F.lit(": "), "description")).otherwise(""))
    files = context.select("snapshot_id", "_file").distinct()
    position = _sortable(F.col("seq"))
    parts += [
        _lines(files, 4, [("file", F.concat(F.lit("**File:** `"), "_file", F.lit("`")), None)], F.col("_file"), F.lit("")),
        _lines(context, 4, [("context", item, None)], F.col("_file"), position),
        _lines(files, 4, [("gap", "", None)], F.col("_file"), F.lit("~")),
    ]
    badge = (
        F.when(F.col("source_virtual") & F.col("target_virtual"), " (virtual → virtual)").when(F.col("source_virtual"), " (virtual → context)")
        .when(F.col("target_virtual"), " (context → virtual)").otherwise(""))
    relation = F.concat(F.lit("- `"), "source_label", F.lit("` → `"), "target_label", F.lit("`"), badge,
                        F.when(text_or_empty("remarks") != "", F.concat(F.lit(" — "), "remarks")).otherwise(""))
    parts.append(_lines(texts, 6, [("relation", relation, None)], position))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


CHUNK = 100_000


def _numbered(rows: DataFrame) -> DataFrame:
    """Add ``nr``, the position of a row in its snapshot by ``seq``, counting in chunks of ``seq``.

    No task orders more than one chunk, however large a snapshot is.
    """
    by_chunk = Window.partitionBy("snapshot_id", "_chunk").orderBy("seq")
    over_chunks = Window.partitionBy("snapshot_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunked = rows.withColumn("_chunk", F.floor(F.col("seq") / CHUNK))
    before = chunked.groupBy("snapshot_id", "_chunk").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(over_chunks), F.lit(0)))
    placed = chunked.withColumn("_in", F.row_number().over(by_chunk)).join(before.drop("_n"), ["snapshot_id", "_chunk"])
    return placed.withColumn("nr", (F.col("_in") + F.col("_before")).cast("bigint")).select(*rows.columns, "nr")


def _planned_lines(tree: DataFrame, related: DataFrame) -> list[DataFrame]:
    """Lines of the planned nodes; steps below 10 come before a node's related edges, 99 after them."""
    flat, depth = F.col("flat"), F.col("depth")
    root, klass, leaf = ~flat & (depth == 0), ~flat & (depth == 1), ~flat & (depth >= 2)
    told, remarked = text_or_empty("description") != "", text_or_empty("ai_remarks") != ""
    filed, deep = text_or_empty("file_path") != "", flat | leaf

    def say(name, value):
        plain, strong = F.concat(F.lit(f"- {name}: "), value), F.concat(F.lit(f"- **{name}:** "), value)
        return F.when(flat, strong).otherwise(plain)

    quoted = F.concat(F.lit("`"), "file_path", F.lit("`"))
    items = [
        ("planned", F.concat(F.lit("### 📁 "), "label", F.lit(" *(virtual directory)*")), root), ("gap", "", root),
        ("planned", F.concat(F.lit("#### 📦 "), "label", F.lit(" *(virtual class)*")), klass),
        ("planned", F.concat(F.lit("##### "), "label", F.lit(" *(virtual "), "type", F.lit(")*")), leaf),
        ("planned", F.concat(F.lit("### "), F.col("nr").cast("string"), F.lit(". "), "label", F.lit(" *(virtual)*")), flat),
        ("note", say("Type", F.col("type")), deep), ("note", F.when(flat, F.concat(F.lit("- **Target file:** "), quoted)).otherwise(F.concat(F.lit("- Target file: "), quoted)), deep & filed),
        ("note", say("Description", F.col("description")), told), ("gap", "", root & told),
        ("note", say("AI Remarks", F.col("ai_remarks")), remarked & ~root),
    ]
    listed = _numbered(tree.where("flat")).unionByName(tree.where(~flat).withColumn("nr", F.lit(0).cast("bigint")))
    base = listed.withColumnRenamed("order", "walk")
    entries = [
        F.when(F.lit(True) if cond is None else cond, F.struct(F.lit(i).alias("step"), F.lit(kind).alias("kind"),
               (F.lit(text) if isinstance(text, str) else text).alias("line"))) for i, (kind, text, cond) in enumerate(items)
    ]
    entries.append(F.when(~root, F.struct(F.lit(99).alias("step"), F.lit("gap").alias("kind"), F.lit("").alias("line"))))
    own = base.select("snapshot_id", F.lit(2).alias("section"), F.col("walk").alias("order"), F.explode(F.array_compact(F.array(*entries))).alias("e")).select(
        "snapshot_id", "section", "order", "e.step", "e.kind", "e.line")
    title = F.when(flat, F.lit("- **Related:** ")).otherwise(F.lit("- Related: "))
    edges = related.join(base.where(flat | (depth >= 1)).select(*KEY, "walk", "flat"), KEY).select(
        "snapshot_id", F.lit(2).alias("section"), F.col("walk").alias("order"), F.lit(10).alias("step"), F.lit("related").alias("kind"),
        F.concat(title, "line").alias("line"))
    return [own, edges]


LINE_ORDER = ["section", "order", "step", "line"]
FIXED_LINES, NODE_LINES = 30, 11  # at most, of a report without nodes and edges, and of a node without its edges


def most_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``snapshot_id, most``: a snapshot's report (:func:`report_lines`) has at most that many lines, told by its rows alone."""
    copies = nodes.where("is_virtual").groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n")).groupBy("snapshot_id").agg(F.max("_n").alias("_copies"))
    kinds = nodes.select("snapshot_id", F.lit(1).alias("_node"), F.lit(0).alias("_edge")).unionByName(
        edges.select("snapshot_id", F.lit(0).alias("_node"), F.lit(1).alias("_edge")))
    rows = kinds.groupBy("snapshot_id").agg(F.sum("_node").alias("_nodes"), F.sum("_edge").alias("_edges")).join(copies, "snapshot_id", "left")
    related = 2 * F.coalesce("_copies", F.lit(0))  # an edge is listed at each row that has the id of one of its ends
    return rows.select("snapshot_id", (FIXED_LINES + NODE_LINES * F.col("_nodes") + (1 + related) * F.col("_edges")).alias("most"))


def numbered_lines(lines: DataFrame, most: DataFrame | None = None, whole: int = CHUNK) -> DataFrame:
    """``snapshot_id, line_no, kind, line``: the reports' lines, counted from 1 in each snapshot.

    ``most`` (:func:`most_lines`) bounds the lines of each snapshot. Those of at most ``whole`` lines are sorted by one task
    each; only the lines of larger ones, and all without ``most``, are dealt by ranges, for which they are made twice.
    """
    columns = ["snapshot_id", "line_no", "kind", "line"]

    def ranged(some: DataFrame) -> DataFrame:
        return numbered(some, ["snapshot_id"], LINE_ORDER, "line_no").select(*columns)

    def sorted_whole(some: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("snapshot_id").orderBy(*LINE_ORDER))
        return some.select("snapshot_id", place.cast("bigint").alias("line_no"), "kind", "line")

    if most is None:
        return ranged(lines)
    large = stored(most.where(F.col("most") > whole).select("snapshot_id"))
    if large.isEmpty():
        return sorted_whole(lines)
    return sorted_whole(lines.join(large, "snapshot_id", "left_anti")).unionByName(ranged(lines.join(large, "snapshot_id", "left_semi")))


def write_report(lines: DataFrame, path: str) -> None:
    """Write the lines as text, one folder per snapshot, in report order across its files."""
    order = ["snapshot_id", *LINE_ORDER]
    (
        lines.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("snapshot_id", "line").write.mode("overwrite").partitionBy("snapshot_id").text(path)
    )

"""Merkle manifest of a table, with levels of the trees as concatenated hex strings.

Rows are leaves, numbered within their group. An aligned block of leaves keeps each of its levels as one string of
hex digests: fixed-width substrings of a level are hashed to the next, and what flanks a digest in its run are its
siblings. The roots of blocks are the leaves of the next round, until each group has one root; the groups' roots
are the leaves of one more tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.llm.common import written

FANOUT = 8
LEVELS = 3  # that a block keeps
BLOCK = FANOUT**LEVELS  # leaves of a block
WIDTH = 64  # hex digits of a digest
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_ROW_BITS = 33  # that monotonically_increasing_id gives to the row in its partition


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def group_key(value: Column) -> Column:
    """Text that sorts as ``value`` does, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place in its ``group`` by ``order`` (nulls first), and ``n``, the rows of the group.

    Rows are dealt by ranges, and counted by range: no group comes to one task. Equal rows are dealt by a number of
    their own, so they may fill many ranges.
    """
    dealt = rows.withColumn("_salt", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "_salt")]
    ranged = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt")
    placed = written(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part, row = F.shiftright("_at", _ROW_BITS), F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    # a row for each range that holds some of a group: as many as there are ranges and groups together, at most
    spans = placed.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(F.min(row).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    mine = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_rows").over(mine.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = spans.select(F.col("_group").alias(group), "_part", F.sum("_rows").over(mine).alias("n"), (before - F.col("_first")).alias("_shift"))
    joined = placed.withColumn("_part", part).join(offsets, [group, "_part"])
    return joined.withColumn("pos", row + F.col("_shift")).drop("_at", "_part", "_shift")


def _digests(level: Column, start: Column, count: Column) -> Column:
    """``count`` digests of a level from the ``start``-th on; fewer, where the level ends."""
    return F.substring(level.cast("binary"), (start * WIDTH + 1).cast("int"), (count * WIDTH).cast("int")).cast("string")


def _parents(level: Column) -> Column:
    """The next level: a digest of each run of ``FANOUT``."""
    runs = F.sequence(F.lit(0), F.floor((F.octet_length(level) - 1) / (FANOUT * WIDTH)).cast("int"))
    return F.array_join(F.transform(runs, lambda r: digest(_digests(level, r * FANOUT, F.lit(FANOUT)))), "")


def blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """Aligned blocks of ``nodes`` (``g``, ``n``, ``pos``, ``digest`` and ``payload``).

    ``items`` holds the payload in order; ``l0`` to ``l2`` are the levels, null above the block's ``height``; ``node``
    is its root. A group of one block stops where one digest is left; else all blocks have ``LEVELS`` levels above.
    """
    block = F.floor(F.col("pos") / BLOCK).cast("long")
    items = F.array_sort(F.collect_list(F.struct("pos", "digest", *payload)))
    rows = nodes.groupBy("g", "n", block.alias("block")).agg(items.alias("items"))
    height = F.when(F.col("n") <= 1, 0)
    for k in range(1, LEVELS):
        height = height.when(F.col("n") <= FANOUT**k, k)
    rows = rows.withColumn("height", height.otherwise(LEVELS)).withColumn("l0", F.array_join(F.col("items.digest"), ""))
    for k in range(1, LEVELS + 1):
        rows = rows.withColumn(f"l{k}", F.when(F.col("height") >= k, _parents(F.col(f"l{k - 1}"))))
    rows = rows.withColumn("node", F.coalesce(*[F.col(f"l{k}") for k in range(LEVELS, -1, -1)]))
    kept = F.transform("items", lambda x: F.struct(x["pos"].alias("pos"), *[x[c].alias(c) for c in payload]))
    return written(rows.select("g", "n", "block", "height", kept.alias("items"), *[f"l{k}" for k in range(LEVELS)], "node"))


def trees(nodes: DataFrame, payload: list[str]) -> list[DataFrame]:
    """Blocks of all rounds: those of the nodes, those of the blocks' roots, and so on to one block for each group."""
    rounds = [blocks(nodes, payload)]
    most = rounds[0].agg(F.max("n")).first()[0] or 0
    while most > BLOCK:
        most = -(-most // BLOCK)
        roots = rounds[-1].select("g", F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("block").alias("pos"), F.col("node").alias("digest"))
        rounds.append(blocks(roots, []))
    return rounds


def segments(pos: Column) -> Column:
    """What stands left and right of the digest at ``pos`` and of those above it in their runs, up to the block's root."""
    found, at = [], F.pmod(pos, F.lit(BLOCK)).cast("int")
    for k in range(LEVELS):
        level, place = F.col(f"l{k}"), F.pmod(at, F.lit(FANOUT))
        found.append(F.struct(
            _digests(level, at - place, place).alias("left"), _digests(level, at + 1, F.lit(FANOUT - 1) - place).alias("right")))
        at = F.floor(at / FANOUT).cast("int")
    return F.slice(F.array(*found), F.lit(1), F.col("height"))


def paths(rounds: list[DataFrame], above: DataFrame, payload: list[str]) -> DataFrame:
    """Each node's ``path`` of segments, lowest first, continued by its group's ``path`` in ``above`` (``g``, ``path``, ...)."""
    extra = [c for c in above.columns if c not in ("g", "path")]
    ahead = above.withColumn("pos", F.lit(0).cast("long"))
    for k, level in reversed(list(enumerate(rounds))):
        mine = payload if k == 0 else []
        joined = level.join(ahead.withColumnRenamed("pos", "block"), ["g", "block"])
        each = joined.withColumn("item", F.explode("items")).withColumn("pos", F.col("item.pos"))
        own = _digests(F.col("l0"), F.pmod("pos", F.lit(BLOCK)), F.lit(1))
        ahead = each.select(
            "g", "pos", F.concat(segments(F.col("pos")), "path").alias("path"), *extra, *([own.alias("digest")] if k == 0 else []), *[F.col(f"item.{c}").alias(c) for c in mine])
    return ahead


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``path`` give."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", order: str = "doc_id", arrived: dict[str, Column] | None = None) -> DataFrame:
    """Leaf, path and roots of every row, and the root that the row gives as it ``arrived``.

    A row's leaf is the digest of its ``columns``. Leaves of a ``group`` ascend by ``order``, then by leaf; null is the
    first, both as a group and in the order. ``arrived`` names columns that were changed since, with what they are
    now; null there means unchanged. Returns ``order``, ``group``, ``pos``, ``leaf``, ``subroot``, ``root``, ``path``
    (left and right siblings, lowest level first), ``proof`` (their digests in a row) and ``folded_root``.

    Rows that repeat all columns are leaves of their own, next to each other. Other columns are ignored. An empty
    table has no rows.
    """
    arrived = arrived or {}
    now = [field(F.coalesce(arrived[c], F.col(c).cast("string")) if c in arrived else F.col(c)) for c in columns]
    changed = F.exists(F.array(F.lit(None).cast("string"), *arrived.values()), lambda x: x.isNotNull())
    leaves = written(docs.select(
        group_key(F.col(group)).alias("g"), F.col(order).alias("key"), F.col(group).alias("group"), digest(*[field(F.col(c)) for c in columns]).alias("digest"),
        F.when(changed, digest(*now)).alias("arrived")))
    payload = ["key", "group", "arrived"]
    rounds = trees(numbered(leaves, "g", ["key", "digest"]), payload)
    groups = rounds[-1].select(F.col("g").alias("name"), F.col("node").alias("digest"), F.lit("").alias("g"))
    top = trees(numbered(groups, "g", ["name"]), ["name"])
    root = top[-1].select("node").first()
    empty = F.array().cast("array<struct<left:string,right:string>>")
    start = top[-1].select("g", empty.alias("path"))
    above = written(paths(top, start, ["name"]).select(F.col("name").alias("g"), F.col("digest").alias("subroot"), "path"))
    found = paths(rounds, above, payload).withColumnRenamed("digest", "leaf")
    return found.select(
        F.col("key").alias(order), F.col("group").alias(group), "pos", "leaf", "subroot", F.lit(root.node if root else None).cast("string").alias("root"), "path",
        F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "").alias("proof"),
        folded(F.coalesce("arrived", "leaf"), F.col("path")).alias("folded_root"))


def folded_text(docs_id: str = "doc_id", every: int = 3) -> Column:
    """``text`` with A-Z lower-cased where ``every`` divides the crc32 of the id as text; else null, also for null ids."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.pmod(F.crc32(F.col(docs_id).cast("string").cast("binary")), F.lit(every)) == 0
    return F.when(hit, F.translate(F.col("text"), upper, upper.lower()))


def manifest_report(docs: DataFrame) -> DataFrame:
    """The digest columns per document, with the tampering of :func:`folded_text`."""
    whole = docs.select(*[F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in COLUMNS])
    rows = manifest(whole, arrived={"text": folded_text()})
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

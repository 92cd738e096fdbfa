"""Exact top-k inner products by the threshold algorithm over sorted lists, one list per dimension.

Vectors are dealt to shards, queries to blocks; each pair of a shard and a block is one task. A shard sorts its
vectors along every dimension. For a query, all lists are read from their best end, a step at a time; vectors
met for the first time are scored in full, and reading stops when no unread vector can reach the kth score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 10
SHARD = 8192  # vectors of a task
BLOCK = 1024  # queries of a task
STEP = 32
FOUND = "query_id long, query_row long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """``vec_id`` and ``v``, the integers floor(scale * x); vectors that are null, or hold null, NaN or infinity, go."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(sound)
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(wide, lambda x: F.floor(x * scale)).alias("v")))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for k, v in enumerate(rows):
        out[k, : len(v)] = v
    return out


def threshold_search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int, lists: np.ndarray | None = None) -> list[tuple[int, int]]:
    """The ``k`` best ``(score, id)`` of the rows of ``x`` for ``q``; the smaller id wins ties. Rows of id ``own`` don't count.

    ``lists`` has, per dimension, the rows in rising order of that component.
    """
    n, dims = x.shape
    lists = np.argsort(x, axis=0, kind="stable") if lists is None else lists
    used = np.flatnonzero(q)
    seen = np.zeros(n, bool)
    rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, step = 0, STEP
    while at < n:
        end = min(n, at + step)
        if len(used):
            met = np.concatenate([lists[at:end, d] if q[d] < 0 else lists[n - end : n - at, d] for d in used])
        else:
            met = np.arange(at, end)
        flags = np.zeros(n, bool)
        flags[met] = True
        fresh = np.flatnonzero(flags & ~seen)
        seen |= flags
        if len(fresh):
            rows = np.concatenate([rows, fresh])
            scores = np.concatenate([scores, x[fresh] @ q])
            mine = ids[rows] != own
            rows, scores = rows[mine], scores[mine]
            best = np.lexsort((ids[rows], -scores))[:k]
            rows, scores = rows[best], scores[best]
        at = end
        step *= 2
        if at < n and len(rows) == k:
            edge = [x[lists[at - 1, d], d] if q[d] < 0 else x[lists[n - at, d], d] for d in used]
            if int(np.dot(np.array(edge, np.int64), q[used])) < scores[-1]:  # at equality a smaller id may be unread
                break
    return list(zip(scores.tolist(), ids[rows].tolist(), strict=True))


def _search(k: int):
    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            width = max(left["v"].map(len).max(), right["v"].map(len).max())
            x, q = _matrix(left["v"], width), _matrix(right["v"], width)
            ids = left["vec_id"].to_numpy()
            lists = np.argsort(x, axis=0, kind="stable")
            for row, query, vector in zip(right["query_row"].tolist(), right["query_id"].tolist(), q, strict=True):
                out += [(query, row, vec, score) for score, vec in threshold_search(x, ids, vector, query, k, lists)]
        return pd.DataFrame(out, columns=["query_id", "query_row", "vec_id", "score"]).astype("int64")

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = K, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The ``k`` best rows of ``vectors`` for each row that ``is_query`` picks: query_id, rank, vec_id, score.

    ``vectors`` has ``vec_id`` and ``embedding``; rows with a null id take no part. Ranks count from 1, ties go
    to the smaller id, a query that is repeated is answered once per row. Components that shorter vectors lack
    are 0. Rows of the query's own id are no candidates.
    """
    sound = quantised(vectors)
    queries = sound.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v"))
    n = sound.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    shards, blocks = max(1, -(-n[0] // shard)), max(1, -(-n[1] // block))
    numbered = queries.withColumn("query_row", F.monotonically_increasing_id())
    left = sound.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = numbered.select(
        "query_id", "query_row", "v", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(_search(k), FOUND)
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

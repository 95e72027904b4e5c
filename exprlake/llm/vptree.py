"""Approximate nearest neighbours by vantage-point trees, one per shard.

Vectors fall into shards of about SHARD_ROWS by hash and queries into blocks of about QUERY_ROWS. A (shard, block) pair is
one task of bounded size: it builds the shard's tree over unit vectors under the Euclidean distance (which orders
pairs as the cosine does) and walks it with all queries of the block at once. A subtree is left out for a query
when the triangle inequality puts it farther than factor times the query's k-th distance so far: factor one is
exact, smaller factors look at less. Each pair returns k rows a query, and one ranking over them is the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exprlake.llm.common import stage
from exprlake.llm.vectors import cosine, matrix, unit, usable

#: Vectors to a shard, queries to a block, vectors to a leaf, and spare candidates that are ranked again exactly.
SHARD_ROWS, QUERY_ROWS, LEAF, SPARE = 8_192, 8_192, 256, 3


class VantagePointTree:
    """Nodes as (vantage row, radius, inner node, outer node), or (rows,) for a leaf."""

    def __init__(self, x: np.ndarray):
        self.x, self.nodes = x, []
        self.root = self._build(np.arange(len(x)))

    def _build(self, rows: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append((rows,))
        if len(rows) <= LEAF:
            return at
        # of a few rows, the one whose distances spread most
        few = rows[:: max(1, len(rows) // 8)][:8]
        d = _distance(self.x[few], self.x[rows])
        best = int(d.std(axis=1).argmax())
        vantage, d = few[best], d[best]
        radius = float(np.median(d))
        inside = (d < radius) & (rows != vantage)
        outside = (d >= radius) & (rows != vantage)
        if not inside.any() or not outside.any():
            return at  # all at one distance: a leaf
        self.nodes[at] = (int(vantage), radius, self._build(rows[inside]), self._build(rows[outside]))
        return at

    def search(self, q: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the k nearest of every query (-1: fewer), rows of the query's own id left out, and how many rows were looked at."""
        best = np.full((len(q), k), -np.inf)
        rows = np.full((len(q), k), -1)
        seen = np.zeros(len(q), np.int64)

        def offer(active: np.ndarray, at: np.ndarray, s: np.ndarray) -> None:
            """Take the scores s of the rows at, in ascending order of ids, that are as good as a query's k-th best so far."""
            seen[active] += len(at)
            s = np.where(ids[at][None, :] == own[active][:, None], -np.inf, np.round(s, 12))
            hit = np.flatnonzero((np.isfinite(s) & (s >= best[active, -1][:, None])).any(axis=1))
            if not len(hit):
                return
            active, s = active[hit], s[hit]
            first = np.argsort(-s, axis=1, kind="stable")[:, :k]  # equal scores stay in the order of ids
            both = np.hstack([best[active], np.take_along_axis(s, first, 1)])
            which = np.hstack([rows[active], at[first]])
            order = np.lexsort((np.where(which >= 0, ids[which], np.iinfo(np.int64).max), -both), axis=1)[:, :k]
            best[active], rows[active] = np.take_along_axis(both, order, 1), np.take_along_axis(which, order, 1)

        def visit(node: int, active: np.ndarray) -> None:
            if not len(active):
                return
            if len(self.nodes[node]) == 1:
                at = self.nodes[node][0]
                offer(active, at, q[active] @ self.x[at].T)
                return
            vantage, radius, inner, outer = self.nodes[node]
            s = q[active] @ self.x[vantage]
            offer(active, np.array([vantage]), s[:, None])
            d = np.sqrt(np.maximum(0, 2 - 2 * s))
            near_inner = d < radius
            for first, second, mine in ((inner, outer, near_inner), (outer, inner, ~near_inner)):
                visit(first, active[mine])
                reach = np.sqrt(np.maximum(0, 2 - 2 * np.maximum(best[active[mine], -1], -1)))
                visit(second, active[mine][np.abs(d[mine] - radius) <= factor * reach + 1e-6])

        visit(self.root, np.arange(len(q)))
        return np.where(np.isfinite(best), rows, -1), seen


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * a @ b.T))


def nearest(df: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), key, score: the k rows of df of largest cosine for every row of queries.

    A query's own row (equal key) is no candidate; ties go to the smaller key. Vectors that are null, empty, zero or hold
    null or non-finite components take no part, nor do rows with a null key; vectors of different length are not compared.
    Of queries with one key, the one of the smallest hash counts; repeated rows of df are candidates each. Fewer
    candidates than k give fewer rows. Only two columns are read, so other columns never clash.
    """
    items = df.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    asked = queries.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    asked = asked.groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    items = stage(items.withColumn("dim", F.size("v")), "vectors")
    asked = stage(asked.withColumn("dim", F.size("v")), "queries")
    shards = max(1, -(-items.count() // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    items = items.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(shard: pa.Table, block: pa.Table) -> pa.Table:
        out = {"query_id": [], "id": [], "score": []}
        if len(shard) and len(block):
            shard = shard.sort_by("id")
            x, q = matrix(shard["v"]), matrix(block["v"])
            ids, own = shard["id"].to_numpy(), block["id"].to_numpy()
            rows, _ = VantagePointTree(unit(x)).search(unit(q), own, ids, k + SPARE, factor)
            a, b = np.nonzero(rows >= 0)
            at = rows[a, b]
            out = {"query_id": own[a], "id": ids[at], "score": cosine(q[a], x[at])}
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "id": pa.array(out["id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    on = ["dim", "shard", "block"]
    found = items.groupBy(on).cogroup(asked.groupBy(on)).applyInArrow(search, "query_id long, id long, score double")
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", turn).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")

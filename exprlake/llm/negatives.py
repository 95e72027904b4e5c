"""Hard negatives by lists that a cluster of anchors shares.

Anchors are dealt into blocks and clustered by direction inside each block (spherical k-means). In a shard of candidates every cluster sorts
the candidates once by an upper bound of their inner product with any of its members of length one: |x| cos(max(0, angle(x, c) - b)),
where c is the cluster's centroid and b the largest angle of a member with it. Each member walks that list from the top
and stops as soon as its length times the next bound is below what it still needs, which proves that nothing
behind can count. All arithmetic that decides is on integers.

Positives come first, from the shards of the anchor's own label; negatives then from all shards, with a window of scores for each positive.
A (block, shard) pair is one task of bounded size and returns a few rows an anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exprlake.llm.cells import spherical_kmeans
from exprlake.llm.common import stage
from exprlake.llm.vectors import matrix

#: Candidates of a shard, anchors of a block, members of a cluster, candidates of a step along a list.
SHARD_ROWS, BLOCK_ROWS, MEMBERS, STEP = 8_192, 16_384, 128, 1_024
LOW, HIGH = 1 - (1 << 63), (1 << 63) - 1


def complete(vector: str) -> Column:
    """Not null, and every component a finite number; zero and empty vectors are complete."""
    v = F.col(vector)
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def whole(vector: str, scale: int) -> Column:
    """floor(scale * x) of every component, as integers in doubles."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one (any direction for zero) and the lengths of x."""
    if not x.shape[1]:
        return np.ones((len(x), 1)), np.zeros(len(x))
    peak = np.abs(x).max(axis=1)
    y = x / np.where(peak > 0, peak, 1)[:, None]
    y[peak == 0, 0] = 1.0
    size = np.sqrt((y * y).sum(axis=1))
    return y / size[:, None], size * peak


def _vectors(column, dim: int) -> np.ndarray:
    return matrix(column) if dim else np.zeros((len(column), 0))


def _products(q: np.ndarray, x: np.ndarray, exact: type) -> np.ndarray:
    """Inner products as integers; exact is a type in which no sum of products rounds, or int where none is wide enough (sums beyond 64 bits stop there)."""
    if exact is int:
        wide = np.vectorize(int, otypes=[object])
        s = wide(q) @ wide(x).T if q.shape[1] else np.zeros((len(q), len(x)), object)
        return np.clip(s, LOW + 1, HIGH - 1).astype(np.int64)
    return q.astype(exact) @ x.astype(exact).T


def share(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """percent of the integers score, rounded down or up, without overflow."""
    sign = -1 if up else 1
    score = sign * score
    return sign * (score // 100 * percent + score % 100 * percent // 100)


class Best:
    """The k best (score, id) of every row: larger scores first, then smaller ids."""

    def __init__(self, rows: int, k: int):
        self.score, self.id = np.full((rows, k), LOW, np.int64), np.full((rows, k), HIGH, np.int64)

    def needed(self, first_id: int) -> np.ndarray:
        """The least score by which a candidate with an id from first_id on could enter."""
        last = self.score[:, -1]
        return np.where(last == LOW, LOW, last + (self.id[:, -1] < first_id))

    def offer(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        rows = np.unique(row)
        row = np.concatenate([np.repeat(rows, k), row])
        score, ids = np.concatenate([self.score[rows].ravel(), score]), np.concatenate([self.id[rows].ravel(), ids])
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        start = np.flatnonzero(np.r_[True, np.diff(row) != 0])
        place = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
        keep = place < k
        self.score[row[keep], place[keep]], self.id[row[keep], place[keep]] = score[keep], ids[keep]


def walk(q: dict, x: dict, k: int, windows: list[tuple[np.ndarray, np.ndarray]], differ: bool) -> tuple[list[Best], int]:
    """For every window (least and largest score of each anchor), the k best candidates, and how many products were made.

    q holds the anchors' v, id, label and cluster, x the candidates' v, id and label. A candidate with the anchor's id doesn't count, nor, if differ, one
    with its label."""
    (qu, qn), (xu, xn) = _directions(q["v"]), _directions(x["v"])
    most = qn.max() * xn.max() * 1.01
    exact = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else int
    best = [Best(len(qn), k) for _ in windows]
    made = 0
    for cluster in np.unique(q["cluster"]):
        mine = np.flatnonzero(q["cluster"] == cluster)
        centre = qu[mine].sum(axis=0)
        size = np.sqrt(centre @ centre)
        centre = centre / size if size > 1e-9 else qu[mine[0]]
        angle = lambda u: np.arccos(np.clip(u @ centre, -1, 1))  # noqa: B023, E731
        spread = angle(qu[mine]).max()
        bound = xn * (np.cos(np.maximum(0, angle(xu) - spread - 1e-6)) + 1e-9)
        order = np.lexsort((x["id"], -bound))  # copies have one bound, so their smallest ids come first
        for start in range(0, len(order), STEP):
            at = order[start : start + STEP]
            ids = x["id"][at]
            need = [np.maximum(low[mine], b.needed(ids.min())[mine] if start else LOW) for b, (low, _) in zip(best, windows, strict=True)]
            least = np.min(need, axis=0)
            go = least.astype(float) <= qn[mine] * bound[at[0]] + 0.5
            if not go.any():
                break  # of the members, none needs what follows
            active, made = mine[go], made + int(go.sum()) * len(at)
            s = _products(q["v"][active], x["v"][at], exact)
            top = np.max([high[active] for _, high in windows], axis=0)
            a, c = np.nonzero((s >= least[go].astype(s.dtype)[:, None]) & (s <= top.astype(s.dtype)[:, None]))
            ok = ids[c] != q["id"][active[a]]
            if differ:
                ok &= x["label"][at[c]] != q["label"][active[a]]
            a, c = a[ok], c[ok]
            s = s[a, c].astype(np.int64)
            for b, n, (_, high) in zip(best, need, windows, strict=True):
                hit = (s >= n[go][a]) & (s <= high[active[a]])
                if hit.any():
                    b.offer(active[a[hit]], s[hit], ids[c[hit]])
    return best, made


def _clustered(anchors: DataFrame, *keys: str) -> DataFrame:
    """anchors with the number of their cluster inside their block."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in anchors.schema)}, cluster int"

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        u, _ = _directions(_vectors(table["v"], table["dim"][0].as_py()))
        centres = spherical_kmeans(u, max(1, len(u) // MEMBERS))
        return table.append_column("cluster", pa.array((u @ centres.T).argmax(axis=1).astype(np.int32)))

    return anchors.groupBy(*keys).applyInArrow(fit, schema)


def _side(table: pa.Table) -> dict:
    """Columns of a block or a shard as arrays; labels are numbers or their places among all labels."""
    return {"v": _vectors(table["v"], table["dim"][0].as_py()), "id": table["id"].to_numpy(), **({"cluster": table["cluster"].to_numpy()} if "cluster" in table.column_names else {})}


def hard_negatives(df: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of every row of anchors among df.

    vector holds integers (see whole()); a score is the inner product, larger ones come first, then smaller keys. An anchor's positives are its first
    rows of the same label, other than itself; a positive's negatives are the first rows of another label that
    score at least `least` and at most `most` percent of it. Fewer rows than asked for give all there are. Rows with a null key, label or vector, or with
    a null or non-finite component, take no part; vectors of different length are not compared. Of anchors with one key, the one of the
    smallest hash counts; repeated rows of df are candidates each, but rows with the anchor's key are not. The result is exact: lists are
    left only where nothing behind can count. Only three columns are read, so other columns never clash. An empty
    table gives no rows.
    """
    taking = F.col(key).isNotNull() & F.col(label).isNotNull() & complete(vector)
    parts = (F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"), F.size(vector).alias("dim"))
    items = stage(df.where(taking).select(*parts), "candidates")
    asked = anchors.where(taking).select(*parts)
    asked = asked.groupBy("id").agg(F.min_by(F.struct("label", "v", "dim"), F.xxhash64("label", "v")).alias("x")).select("id", "x.*")
    asked = stage(asked, "anchors")
    ceil = lambda n, size: F.ceil(n / size).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")

    # positives: blocks and shards inside each label that has anchors
    shards = items.groupBy("dim", "label").agg(ceil(F.count("*"), SHARD_ROWS).alias("shards"))
    blocks = asked.groupBy("dim", "label").agg(ceil(F.count("*"), BLOCK_ROWS).alias("blocks"))
    grid = stage(blocks.join(shards, ["dim", "label"]), "grid")
    left = _clustered(asked.join(grid, ["dim", "label"]).withColumn("block", dealt(F.col("blocks"), 3)).drop("blocks"), "dim", "label", "block")
    left = left.withColumn("shard", every(F.col("shards"))).drop("shards")
    right = items.join(grid, ["dim", "label"]).withColumn("shard", dealt(F.col("shards"), 5)).withColumn("block", every(F.col("blocks"))).drop("shards", "blocks")

    def alike(block: pa.Table, shard: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 3
        if len(block) and len(shard):
            q, x = _side(block), _side(shard)
            found, _ = walk(q, x, positives, [(np.full(len(block), LOW), np.full(len(block), HIGH))], differ=False)
            row, at = np.nonzero(found[0].score != LOW)
            out = [q["id"][row], found[0].id[row, at], found[0].score[row, at]]
        return pa.table(dict(zip(("anchor", "id", "score"), map(pa.array, out), strict=True)))

    on = ["dim", "label", "block", "shard"]
    near = left.groupBy(on).cogroup(right.groupBy(on)).applyInArrow(alike, "anchor long, id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    near = near.withColumn("place", place).where(F.col("place") <= positives)
    mine = stage(near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("near")), "positives")

    # negatives: blocks of all anchors that have positives against all shards
    sizes = items.groupBy("dim").agg(ceil(F.count("*"), SHARD_ROWS).alias("shards"))
    blocks = asked.groupBy("dim").agg(ceil(F.count("*"), BLOCK_ROWS).alias("blocks"))
    grid2 = stage(blocks.join(sizes, "dim"), "grid")
    with_near = asked.join(mine.withColumnRenamed("anchor", "id"), "id").join(grid2, "dim").withColumn("block", dealt(F.col("blocks"), 7)).drop("blocks")
    left = _clustered(with_near, "dim", "block").withColumn("shard", every(F.col("shards"))).drop("shards")
    right = items.join(grid2, "dim").withColumn("shard", dealt(F.col("shards"), 9)).withColumn("block", every(F.col("blocks"))).drop("shards", "blocks")

    def unlike(block: pa.Table, shard: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 6
        if len(block) and len(shard):
            q, x = _side(block), _side(shard)
            names = pa.chunked_array([*block["label"].chunks, *shard["label"].chunks]).combine_chunks().dictionary_encode()
            codes = names.indices.to_numpy()
            q["label"], x["label"] = codes[: len(block)], codes[len(block) :]
            near = block["near"].combine_chunks()
            items = near.flatten()
            count = np.diff(near.offsets.to_numpy())
            row, at = np.repeat(np.arange(len(block)), count), items.field("place").to_numpy() - 1
            ids, scores = np.full((len(block), positives), HIGH), np.zeros((len(block), positives), np.int64)
            ids[row, at], scores[row, at] = items.field("id").to_numpy(), items.field("score").to_numpy()
            there = np.zeros(ids.shape, bool)
            there[row, at] = True
            windows = [(np.where(there[:, p], share(scores[:, p], least, True), HIGH), np.where(there[:, p], share(scores[:, p], most, False), LOW)) for p in range(positives)]
            found, _ = walk(q, x, negatives, windows, differ=True)
            rows = []
            for p, best in enumerate(found):
                row, at = np.nonzero(best.score != LOW)
                rows.append((q["id"][row], np.full(len(row), p + 1), ids[row, p], best.id[row, at], scores[row, p], best.score[row, at]))
            out = [np.concatenate(c) for c in zip(*rows, strict=True)]
        return pa.table(dict(zip(("anchor_id", "place", "positive_id", "negative_id", "positive_score", "negative_score"), map(pa.array, out), strict=True)))

    on = ["dim", "block", "shard"]
    far = left.groupBy(on).cogroup(right.groupBy(on)).applyInArrow(unlike, "anchor_id long, place long, positive_id long, negative_id long, positive_score long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return far.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

"""Embedding near-dedup: spherical k-means cells and blocked cosine products.

Equal vectors of one label fall to one class with a count. Centroids are fitted on a bounded sample by spherical k-means; a
label has as many cells as its vectors need for about CELL_ROWS residents each, in powers of two.
Every vector lives in the cell of its nearest centroid. A vector within the threshold angle of it can live in a further cell
only if the bisecting plane is not farther than that angle; it visits those cells whose plane is not farther than
reach times the angle. With reach one each resident meets all its partners in its home cell; a smaller reach misses only pairs
whose difference points almost straight at another centroid. A cell is cut into blocks of at most about BLOCK rows, and each pair of a block of
residents and a block of members is one product of bounded size, which returns the residents' link counts and the
edges of its local components, never a list of all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprlake.llm.common import components, release, stage
from exprlake.llm.vectors import cosine, matrix, unit, usable

#: Vectors of the fitting sample on average, rows to a cell, most cells of a label, rows to a block, rounds of k-means.
SAMPLE, CELL_ROWS, CELLS, BLOCK, ROUNDS = 20_000, 1_000, 2_048, 2_048, 12
#: Share of the threshold angle within which cells are visited: in 64 dimensions 0.5 is four standard deviations of a random difference.
REACH = 0.5


def spherical_kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """k unit centroids of the unit rows of x; a cell that empties takes the row farthest from its centroid."""
    c = x[:: max(1, len(x) // k)][:k].copy()
    for _ in range(ROUNDS):
        s = x @ c.T
        home = s.argmax(axis=1)
        new = np.zeros_like(c)
        np.add.at(new, home, x)
        size = np.sqrt((new * new).sum(axis=1))
        for j in np.flatnonzero(size < 1e-12):
            far = int(s[np.arange(len(x)), home].argmin())
            new[j], size[j] = x[far], 1.0
            s[far] = 1.0
        new = new / size[:, None]
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def _centroids(classes: DataFrame, dim: int, n: int, sizes: list[int]) -> dict[tuple[int, int], np.ndarray]:
    """Centroids of the vectors of one length for every number of cells."""
    found = {(dim, 1): np.zeros((1, dim))}
    if max(sizes) > 1:
        sample = classes.where(F.col("dim") == dim)
        if n > SAMPLE:
            sample = sample.where(F.pmod(F.xxhash64("f", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * SAMPLE / n))
        rows = sample.select("f", "f2", "v").toArrow().sort_by([("f", "ascending"), ("f2", "ascending")])  # about SAMPLE rows
        x = unit(matrix(rows["v"]))
        found |= {(dim, k): spherical_kmeans(x, k) for k in sizes if k > 1}
    return found


def near_groups(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98, reach: float = REACH) -> DataFrame:
    """Per row: key, n_links, component (smallest key reachable by links), kept (the key is the component's).

    Rows link when their labels are equal and not null and the cosine is least or more; with reach one all such pairs are found,
    with less those that the cells bring together. Vectors that are null, empty, zero
    or hold null or non-finite components, and rows without a label, link with nothing; so do vectors of different
    length. Equal rows link with each other. A row with a null key takes part; a component's key is its smallest that
    is not null. Only three columns are read, so other columns never clash. An empty table gives no rows.
    """
    rows = df.select(F.col(key).alias("key"), F.col(vector).alias("v"), F.col(label).alias("label"))
    taking = F.col("label").isNotNull() & usable("v")
    rows = rows.select("key", "v", "label", taking.alias("in"), F.xxhash64("label", "v").alias("f"), F.xxhash64("v", F.lit(5), "label").alias("f2"))
    classes = rows.where("in").groupBy("f", "f2", "label", "v").agg(F.count("*").alias("n"), F.min("key").alias("low"))
    classes = classes.withColumn("dim", F.size("v"))
    cells_of = F.least(F.lit(CELLS), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.count("*") / CELL_ROWS, F.lit(1.0)))))).cast("int")
    classes = stage(classes, "classes")
    counts = stage(classes.groupBy("label", "dim").agg(cells_of.alias("k"), F.count("*").alias("rows")), "labels")
    classes = classes.join(counts.select("label", "dim", "k"), ["label", "dim"])
    needed = counts.groupBy("dim").agg(F.sum("rows").alias("n"), F.collect_set("k").alias("k")).collect()  # a row for each length of vectors
    fitted: dict[tuple[int, int], np.ndarray] = {}
    for r in needed:
        fitted |= _centroids(classes, r["dim"], r["n"], sorted(r["k"]))
    centroids = df.sparkSession.sparkContext.broadcast(fitted)
    sine = reach * math.sin(math.acos(least)) + 1e-9

    def place(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dim, k = table["dim"].to_numpy(), table["k"].to_numpy()
            for d, size in {*zip(dim.tolist(), k.tolist(), strict=True)}:
                part = table.filter(pa.array((dim == d) & (k == size)))
                c, x = centroids.value[d, size], unit(matrix(part["v"]))
                s = x @ c.T
                home = s.argmax(axis=1)
                between = np.sqrt(np.maximum(0, (c * c).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * c @ c.T))
                near = s[np.arange(len(x)), home][:, None] - s <= sine * between[home] + 1e-9
                near[np.arange(len(x)), home] = True
                at, cell = np.nonzero(near)
                out = part.take(pa.array(at)).select(["f", "f2", "label", "n", "dim", "v"])
                out = out.append_column("cell", pa.array(cell.astype(np.int32))).append_column("home", pa.array(home[at] == cell))
                yield from out.to_batches()

    kind, label_kind = classes.schema["v"].dataType.simpleString(), classes.schema["label"].dataType.simpleString()
    cell = ["label", "dim", "cell"]
    placed = classes.select("f", "f2", "label", "n", "dim", "v", "k").mapInArrow(place, f"f long, f2 long, label {label_kind}, n long, dim int, v {kind}, cell int, home boolean")
    placed = members = stage(placed, "cells")
    # rows of each cell, so that large cells are cut into more blocks
    blocks = placed.groupBy(cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(blocks, cell).withColumn("mine", F.pmod(F.xxhash64("f2", F.lit(9)), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    residents = placed.where("home").withColumn("i", F.col("mine")).withColumn("j", F.explode(every)).withColumn("left", F.lit(True))
    guests = placed.withColumn("j", F.col("mine")).withColumn("i", F.explode(every)).withColumn("left", F.lit(False))
    pairs = residents.unionByName(guests).select(*cell, "i", "j", "left", "f", "f2", "n", "v")

    def product(table: pa.Table) -> pa.Table:
        left = table["left"].to_numpy()
        a, b = table.filter(pa.array(left)), table.filter(pa.array(~left))
        names = ["f", "f2", "n", "to", "to2"]
        if not len(a) or not len(b):
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        x, y = matrix(a["v"]), matrix(b["v"])
        s = unit(x) @ unit(y).T
        i, j = np.nonzero(s >= least - 1e-9)
        edge = np.flatnonzero(np.abs(s[i, j] - least) <= 1e-9)  # so near the threshold that the formula itself decides
        ok = np.ones(len(i), bool)
        ok[edge] = cosine(x[i[edge]], y[j[edge]]) >= least
        i, j = i[ok], j[ok]
        count = np.bincount(i, b["n"].to_numpy()[j].astype(float), len(a)).astype(np.int64)
        f, f2 = (np.concatenate([a[c].to_numpy(), b[c].to_numpy()]) for c in ("f", "f2"))
        order = np.lexsort((f2, f))
        same = np.r_[True, (np.diff(f[order]) != 0) | (np.diff(f2[order]) != 0)]
        node = np.empty(len(f), np.int64)
        node[order] = np.cumsum(same) - 1  # a resident is a member too
        u, w = node[i], node[len(a) + j]
        low = np.arange(int(same.sum()))
        while True:
            new = low.copy()
            np.minimum.at(new, u, low[w])
            np.minimum.at(new, w, new[u])
            new = new[new]
            if (new == low).all():
                break
            low = new
        first = order[same]
        tied = np.flatnonzero(low != np.arange(len(low)))
        to = first[low[tied]]
        return pa.table({
            "f": np.concatenate([a["f"].to_numpy(), f[first[tied]]]),
            "f2": np.concatenate([a["f2"].to_numpy(), f2[first[tied]]]),
            "n": np.concatenate([count, np.zeros(len(tied), np.int64)]),
            "to": pa.array([None] * len(a) + f[to].tolist(), pa.int64()),
            "to2": pa.array([None] * len(a) + f2[to].tolist(), pa.int64()),
        })

    found = stage(pairs.groupBy(*cell, "i", "j").applyInArrow(product, "f long, f2 long, n long, to long, to2 long"), "products")
    release(members)

    def node(f, f2):
        return F.concat(F.lpad(F.hex(f), 16, "0"), F.lpad(F.hex(f2), 16, "0"))

    roots = components(found.where("`to` is not null").select(node("f", "f2").alias("a"), node("to", "to2").alias("b")))
    counts = found.groupBy("f", "f2").agg(F.sum("n").alias("links"))
    named = classes.select("f", "f2", "low", node("f", "f2").alias("node")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stage(named, "named")
    least_key = stage(named.groupBy("root").agg(F.min("low").alias("component")), "components")  # written, so that a join with a large component's rows can be split
    known = named.join(least_key, "root").join(counts, ["f", "f2"]).select("f", "f2", "links", "component", F.lit(True).alias("in"))
    out = rows.select("key", "in", "f", "f2").join(known, ["f", "f2", "in"], "left")
    component = F.when(F.col("in"), F.col("component")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), F.coalesce(F.col("links") - 1, F.lit(0)).alias("n_links"), component.alias("component"), F.col("key").eqNullSafe(component).alias("kept"))

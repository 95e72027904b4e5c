"""Vector operators against brute force."""

import numpy as np
import pytest

from exprlake.llm import cells, vptree
from exprlake.llm.vectors import cosine


def planted(seed=2, n=400, dim=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n, 3):  # near copies, copies and scaled copies
        x[i] = x[(i * 7) % n] * (1 + (i % 5)) + rng.normal(size=dim) * rng.choice([0, 0.02, 0.1])
    return [(int(i), [float(v) for v in x[i]], int(i % 3)) for i in range(n)]


ODD = [(1000, None, 1), (1001, [0.0] * 12, 1), (1002, [float("nan")] * 12, 1), (1003, [1.0, None] * 6, 1), (1004, [float("inf")] * 12, 0), (1005, [], 0), (1006, [1.0, 2.0], 0), (1007, [2.0, 4.0], 0), (1008, [1.0] * 12, None), (1008, [1.0] * 12, None)]
SCHEMA = "vec_id long, embedding array<double>, label int, cell string, rank int"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_groups(rows, least):
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows[:i]):
            if la is not None and la == lb and usable(a) and usable(b) and len(a) == len(b) and cosine(np.array([a]), np.array([b]))[0] >= least:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    keys = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            keys[find(i)] = min(r[0], keys.get(find(i), r[0]))
    return sorted(((r[0], links[i], keys.get(find(i)), r[0] == keys.get(find(i))) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("rows_per_cell, block", [(2000, 2048), (30, 16)])
def test_groups_equal_brute_force(spark, monkeypatch, rows_per_cell, block):
    monkeypatch.setattr(cells, "CELL_ROWS", rows_per_cell)
    monkeypatch.setattr(cells, "BLOCK", block)
    rows = planted() + ODD + [planted()[6], planted()[6], (None, planted()[9][1], 0)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    found = cells.near_groups(frame, least=0.98).collect()
    assert sorted(map(tuple, found), key=str) == brute_groups(rows, 0.98)


def test_groups_of_an_empty_table(spark):
    assert cells.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_nearest(rows, k):
    out = []
    for q, v, _ in rows:
        if q is None or q % 50 or not usable(v):
            continue
        near = sorted((-cosine(np.array([v]), np.array([w]))[0], i) for i, w, _ in rows if i is not None and i != q and usable(w) and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [8192, 100])
def test_nearest_equal_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(vptree, "SHARD_ROWS", shard_rows)
    rows = planted() + ODD + [(2000 + i, planted()[50][1], 1) for i in range(12)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    found = vptree.nearest(frame, frame.where("vec_id % 50 = 0"), k=5)
    want = brute_nearest(rows, 5)
    got = sorted(map(tuple, found.collect()))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-15)
    assert vptree.nearest(frame.limit(0), frame, k=5).count() == 0


def test_relaxed_factor_looks_at_less_and_keeps_recall():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree, ids = vptree.VantagePointTree(x), np.arange(3000)
    q, own = x[::60], ids[::60]
    exact, seen = tree.search(q, own, ids, 5, 1.0)
    loose, fewer = tree.search(q, own, ids, 5, 0.7)
    s = q @ x.T
    s[np.arange(len(q)), own] = -2
    assert all(set(e) == set(np.argsort(-r)[:5]) for e, r in zip(exact, s, strict=True))
    recall = np.mean([len(set(a) & set(b)) / 5 for a, b in zip(exact, loose, strict=True)])
    assert fewer.sum() < seen.sum() and recall >= 0.9


def test_reach_one_is_exact_and_the_default_finds_nearly_all(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(cells, "CELL_ROWS", 40)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 32))
    x[200:] = x[:200] + rng.normal(size=(200, 32)) * 0.1
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T >= 0.98).sum() - 400
    count = lambda reach: sum(r["n_links"] for r in cells.near_groups(frame, least=0.98, reach=reach).collect())
    assert count(1.0) == links and count(cells.REACH) >= 0.9 * links

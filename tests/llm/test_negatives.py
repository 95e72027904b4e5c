"""Hard negatives against brute force, and the query against its SQL."""

import duckdb
import numpy as np
import pytest

from exprlake.llm import negatives, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label string"


def plain(rows, anchors, positives=5, count=3, least=50, most=95):
    """All pairs in Python integers."""
    out = []
    for a, av, al in anchors:
        scored = sorted((-sum(int(x) * int(y) for x, y in zip(av, v, strict=True)), k, label) for k, v, label in rows if k != a and len(v) == len(av))
        for s, p, _ in [r for r in scored if r[2] == al][:positives]:
            hard = [r for r in scored if r[2] != al and least * -s <= 100 * -r[0] <= most * -s][:count]
            out += [(a, p, n + 1, k, -s, -t) for n, (t, k, _) in enumerate(hard)]
    return sorted(out)


def mined(spark, rows, every=3, **more):
    frame = spark.createDataFrame(rows, SCHEMA)
    found = negatives.hard_negatives(frame, frame.where(f"vec_id % {every} = 0"), **more)
    return sorted(tuple(r) for r in found.collect())


def made(n, seed, scale=20, labels=4, dim=6):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(labels, dim))
    label = draw.integers(0, labels, n)
    x = np.floor(scale * (centres[label] + 0.4 * draw.normal(size=(n, dim))))
    x[:: 17] = 0
    x[5 : n // 3] = x[5]  # a third of the rows are copies
    return [(int(k), x[k].tolist(), f"l{label[k]}") for k in draw.permutation(n)]


@pytest.mark.parametrize("scale", [1, 20, 3e4, 5e8])
def test_equal_to_brute_force(spark, monkeypatch, scale):
    """In many small shards, blocks and clusters; the scales need single and double precision and whole numbers beyond both."""
    for name, size in (("SHARD_ROWS", 60), ("BLOCK_ROWS", 40), ("MEMBERS", 8), ("STEP", 16)):
        monkeypatch.setattr(negatives, name, size)
    rows = made(200, int(scale) % 97, scale)
    assert mined(spark, rows) == plain(rows, [r for r in rows if r[0] % 3 == 0])


def test_lists_are_left_early_and_nothing_is_lost():
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(20, 8))
    v = np.floor(256 * (centres[draw.integers(0, 20, 4_000)] + 0.05 * draw.normal(size=(4_000, 8))))
    x = {"v": v, "id": np.arange(4_000), "label": np.zeros(4_000, int)}
    q = {"v": v[::50], "id": np.arange(0, 4_000, 50), "label": np.ones(80, int)}
    unit, _ = negatives._directions(q["v"])
    q["cluster"] = (unit @ negatives.spherical_kmeans(unit, 20).T).argmax(axis=1)
    found, products = negatives.walk(q, x, 3, [(np.full(80, negatives.LOW), np.full(80, negatives.HIGH))], differ=True)
    for k in range(80):
        s = (v @ q["v"][k]).astype(np.int64)
        s[q["id"][k]] = negatives.LOW
        order = np.lexsort((x["id"], -s))[:3]
        assert found[0].id[k].tolist() == order.tolist() and found[0].score[k].tolist() == s[order].tolist()
    assert products < 0.6 * 80 * 4_000


def test_shares_are_exact():
    s = np.array([-7, -1, 0, 1, 7, 99, 101, 10**17, -(10**17) + 3])
    assert negatives.share(s, 95, False).tolist() == [95 * int(v) // 100 for v in s]
    assert negatives.share(s, 50, True).tolist() == [-(-50 * int(v) // 100) for v in s]


def test_nulls_ties_lengths_and_clashing_names(spark):
    rows = [
        (0, [2.0, 0.0], "a", 1), (1, [2.0, 0.0], "a", 1), (2, [1.0, 0.0], "b", 1), (3, [1.0, 0.0], "b", 1), (4, [1.0, 5.0], "b", 1), (5, [2.0, 0.0], "b", 1), (9, [1.0, 1.0], "b", 1),
        (6, None, "b", 1), (7, [1.0, None], "b", 1), (8, [1.0, 0.0], None, 1), (None, [1.0, 0.0], "b", 1), (10, [float("nan"), 1.0], "b", 1), (11, [1.0], "b", 1), (12, [], "b", 1), (13, [0.0, 0.0], "c", 1),
    ]
    frame = spark.createDataFrame(rows, SCHEMA + ", place int")
    found = [tuple(r) for r in negatives.hard_negatives(frame, frame.where("vec_id in (0, 12, 13)")).orderBy("rank").collect()]
    assert found == [(0, 1, 1, 2, 4, 2), (0, 1, 2, 3, 4, 2), (0, 1, 3, 4, 4, 2)]


def test_repeated_rows(spark):
    rows = [(0, [4.0], "a"), (0, [4.0], "a"), (1, [4.0], "a"), (2, [2.0], "b"), (2, [2.0], "b")]
    assert mined(spark, rows, every=100) == [(0, 1, 1, 2, 16, 8), (0, 1, 2, 2, 16, 8)]


def test_empty_table(spark):
    assert mined(spark, []) == []


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    theirs = con.execute(f"SELECT {', '.join(names)} FROM ({queries.OP11_SQL})").fetchall()
    ours = [tuple(r) for r in queries.op11_negatives(spark, SF).select(*names).collect()]
    assert len(ours) > 20 and sorted(ours) == sorted(theirs)

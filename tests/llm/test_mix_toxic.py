"""Mixing targets against a plain loop; toxicity on planted words."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from exprlake.llm import mix, toxic


def plain_targets(sizes):
    """Share by weight, stop at the caps, share the excess again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: unit * weight[s] for s in free}
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        source = rng.choices(["hot", "b", "ä", "Z", None, "tiny"], [50, 10, 10, 10, 10, 1])[0]
        text = rng.choice([None, ""]) if i % 60 == 0 else " \t".join(["wörd"] * rng.randint(1, 120))
        rows.append((i if i % 50 else None, text, source, "clash"))
    return spark.createDataFrame(rows + [rows[3]] * 5, "doc_id long, text string, source string, size string")


def test_targets_and_words(docs):
    found = mix.mix(docs).select("doc_id", "size", "source_size", "target", mix.taken().alias("taken")).collect()
    rows = docs.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len((r["text"] or "").split())
    want = plain_targets(dict(sizes))
    assert len(found) == len(rows)
    taken = defaultdict(int)
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source_size"]] += r["taken"]
    by_size = {sizes[s]: t for s, t in want.items()}
    assert {r["source_size"] for r in found} == set(by_size)
    for r in found:
        assert abs(r["target"] - by_size[r["source_size"]]) < 1e-6
    for size, t in taken.items():
        assert abs(t - by_size[size]) <= 1
    again = mix.mix(docs).select("doc_id", "size", "source_size", "target", mix.taken().alias("taken")).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_shards_are_even_and_quotas_exact(spark):
    quotas = spark.createDataFrame([(i, (i * 37) % 101) for i in range(11)], "place int, q long")
    split = {r["place"]: r["v"] for r in mix.split_tree(quotas, 8, 1).collect()}
    assert {p: sum(v) for p, v in split.items() if p < 11} == {i: (i * 37) % 101 for i in range(11)}
    assert all(x >= 0 for v in split.values() for x in v)
    columns = [sum(v[h] for v in split.values()) for h in range(8)]
    assert max(columns) - min(columns) <= 1


def test_hypergeometric_draws(spark):
    draw = mix._draw("n", "k", "m", "u")
    rows = spark.range(1, 4000).select(F.lit(40).alias("n"), F.lit(15).alias("k"), F.lit(12).alias("m"), ((F.col("id") - 0.5) / 3999).alias("u")).select(F.expr(draw).alias("x"))
    mean, low, high = rows.agg(F.avg("x"), F.min("x"), F.max("x")).first()
    assert abs(mean - 12 * 15 / 40) < 0.02 and low >= 0 and high <= 12


def test_mixed_rows_and_empty(docs, spark):
    rows = mix.mixed_rows(docs)
    assert set(docs.columns) <= set(rows.columns)
    per = rows.where("doc_id is not null").groupBy("doc_id", "text").count().agg(F.max("count")).first()[0]
    assert per <= 2 * 6  # six equal rows were planted
    assert mix.mix(docs.limit(0)).count() == 0 and mix.mixed_rows(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(docs):
    plan = mix.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def toxic_tables(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(1200):
        bad = i % 8 == 0
        words = [word() for _ in range(rng.randint(5, 80))]
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["grimblax", "zorkwat", "Vexplod"]) + rng.choice(["", "s", "y"])
        rows.append((i, " ".join(words), 0.5))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows + [(None, None, 0.1), (None, "", 0.1), (5, "x" * 200_000, 0.2)], "doc_id long, text string, score double"), spark.createDataFrame(labels + [(None, 1), (4, None)], "doc_id long, toxic int")


def test_held_out_rows_are_told_apart(spark):
    docs, labels = toxic_tables(spark)
    found = toxic.toxicity(docs, labels)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == docs.count()
    both = found.join(labels.dropna(), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in both)
    assert len(both) > 200 and right / len(both) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found.collect())
    kept = toxic.keep_clean(docs, labels)
    assert kept.columns == docs.columns and 900 < kept.count() < docs.count() - 100


def test_without_labels(spark):
    docs, labels = toxic_tables(spark)
    assert toxic.toxicity(docs, labels.limit(0)).agg(F.max("score")).first()[0] == 0.0
    assert toxic.toxicity(docs.limit(0), labels).count() == 0


def test_fit_bounds_and_regression():
    import numpy as np

    assert toxic.FIT_ROWS == 24_000 and not hasattr(toxic, "KEPT")  # no feature is dropped for their number
    rng = np.random.default_rng(3)
    sizes, ratio = rng.integers(0, 9, 300), rng.normal(0, 2, 40)
    at = np.concatenate([np.sort(rng.choice(40, k, replace=False)) for k in sizes]).astype(np.uint32)
    y = (rng.random(300) < 0.3).astype(float)
    x = np.zeros((300, 40))
    x[np.repeat(np.arange(300), sizes), at] = ratio[at]
    w, b = toxic._regression(at, sizes, ratio, y)
    gap = 1 / (1 + np.exp(-(x @ w + b))) - y
    assert np.abs(x.T @ gap / 300 + toxic.RIDGE * w).max() < 1e-5 and abs(gap.mean()) < 1e-5
    parts = toxic._parts(sizes, 100)
    assert [r for a, _ in parts for r in range(300)[a]] == list(range(300)) and sum(e.stop - e.start for _, e in parts) == len(at) and len(parts) > 5


def test_mixed_rows_with_clashing_names_and_local_shuffle(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"word {k} " * (k % 5), "s", k, "x") for k in range(200)], "doc_id long, text string, source string, mix_shard long, row string")
    found = mix.mixed_rows(docs)
    assert found.columns == docs.columns and found.count() > 0
    plain = docs.select("doc_id", "text", "source")
    mix.write_mix(plain, f"{tmp_path}/mix", shards=3)
    assert spark.read.parquet(f"{tmp_path}/mix").count() == mix.mixed_rows(plain, shards=3).count()


def test_sums_before_a_row_equal_one_window(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(1).alias("place"), (F.col("id") % 500).alias("block"), F.col("id").alias("pass"), (F.col("id") % 7).alias("words"))
    order = F.xxhash64("place", "block")
    plain = F.coalesce(F.sum("words").over(mix.Window.partitionBy("place").orderBy(order, "block", "pass").rowsBetween(mix.Window.unboundedPreceding, -1)), F.lit(0))
    found = mix._before(rows.withColumn("plain", plain), "words", order, "block", "pass")
    assert found.count() == 3000 and found.where("before <> plain").count() == 0


def test_shards_grow_with_the_input(spark, monkeypatch):
    monkeypatch.setattr(mix, "SHARD_DOCS", 10)
    rows = spark.createDataFrame([(k, f"s{k % 2}", "word " * (k % 5 + 1)) for k in range(400)], "doc_id long, source string, text string")
    found = mix.mix(rows).select(F.explode("draws.shard").alias("shard")).agg(F.max("shard"), F.count_distinct("shard")).first()
    assert found[0] < 40 and found[1] <= 40

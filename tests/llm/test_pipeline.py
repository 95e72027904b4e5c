"""The pipeline's stages, each held against a plain version on its own input."""

import pytest

import corpus_pipeline
from exprlake.llm import toxic
from exprlake.llm.common import components, stage, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES:
        before = docs
        docs = stage(step(spark, docs, SF), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "toxicity":
            scores = toxic.toxicity(before, table(spark, SF, "labels"))
            assert docs.count() == scores.where("predicted = 0").count() < before.count()
        if name == "ngram_jaccard":
            sets = {}
            for r in before.collect():
                w = (r["text"] or "").encode().lower().split()
                sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
            ids, near = sorted(sets), {}
            for a in ids:
                near[a] = [b for b in ids if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            kept, seen = set(), set()
            for a in ids:
                if a not in seen:
                    kept.add(a)
                    todo = [a]
                    while todo:
                        x = todo.pop()
                        if x not in seen:
                            seen.add(x)
                            todo += near[x]
            assert {r["doc_id"] for r in docs.collect()} == kept
        if name == "bpe":
            assert docs.count() == before.count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_components_by_rounds(spark, monkeypatch):
    import random

    from exprlake.llm import common

    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    frame = spark.createDataFrame(edges + [(None, 3), (7, 7)], "a int, b int")
    small = {(r["node"], r["root"]) for r in components(frame).collect()}
    monkeypatch.setattr(common, "SMALL_GRAPH", 0)
    assert {(r["node"], r["root"]) for r in components(frame).collect()} == small
    assert {r for n, r in small if 400 <= n <= 460} == {400}


@pytest.mark.parametrize("column", ["text", "source", "lang"])
def test_null_columns(spark, column):
    from pyspark.sql import functions as F

    docs = table(spark, SF, "documents").limit(60)
    docs = docs.withColumn(column, F.lit(None).cast("string"))
    for _, step in corpus_pipeline.STAGES[1:]:
        docs = stage(step(spark, docs, SF), "null")
    assert docs.columns[0] == "doc_id"

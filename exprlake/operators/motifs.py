"""Motifs of one or two operators in the shared expression DAGs: mining, features by split, linear scores and selection.

A DAG's nodes are an expression's distinct subtrees. A motif of two is an operator with an operator that it refers to; both
references to one child belong to one occurrence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exprlake.functions.measures import FAMILIES
from exprlake.functions.stats import rounded
from exprlake.operators.corpus import settled
from exprlake.operators.studies import top

#: Weights of the selection grid: coverage, nontrivial coverage, vocabulary and expansion penalties.
GRID = {"coverage": (0.0, 1.0), "nontrivial": (0.0, 0.5), "vocabulary": (0.0, 1.0), "expansion": (0.0, 0.1)}


def occurrences(rows: DataFrame) -> DataFrame:
    """expr_id, split, feature_subset, signature, node_count, c: how often each motif stands in an expression, counted inside its row."""
    rows = settled(rows, "expr_id", "split", "feature_subset", "labels", "subtrees")
    places = "filter(transform(labels, (l, k) -> named_struct('l', l, 's', subtrees[k], 'a', get(labels, 2 * k + 1), 'b', get(labels, 2 * k + 2), 'sa', get(subtrees, 2 * k + 1), 'sb', get(subtrees, 2 * k + 2))), x -> x.a is not null)"
    left = f"""CASE WHEN x.a IN {FAMILIES} THEN CASE WHEN x.l IN ('exp', 'log') THEN concat(x.l, '[arg0:', x.a, ']') WHEN x.sa = x.sb THEN concat(x.l, '[left:', x.a, ',right:', x.b, ']') ELSE concat(x.l, '[left:', x.a, ']') END END"""
    right = f"CASE WHEN x.b IN {FAMILIES} AND x.sa <> x.sb THEN concat(x.l, '[right:', x.b, ']') END"
    names = f"flatten(transform(array_distinct({places}), x -> filter(array(x.l, {left}, {right}), n -> n is not null)))"
    counted = f"transform(array({names}), z -> transform(array_distinct(z), n -> named_struct('signature', n, 'node_count', if(contains(n, '['), 2L, 1L), 'c', cast(size(filter(z, y -> y = n)) as bigint))))[0]"
    rows = rows.select("expr_id", "split", "feature_subset", F.explode(F.expr(counted)).alias("x"))
    return rows.select("expr_id", "split", "feature_subset", "x.*")


def support(found: DataFrame, *keys: str) -> DataFrame:
    return found.groupBy("signature", "node_count", *keys).agg(F.sum("c").alias("support"), F.count("*").alias("coverage"))


def vocabulary(found: DataFrame, min_support: int = 50, size: int = 30) -> DataFrame:
    """The frequent motifs by score support * (nodes - 1), support, nodes and name."""
    groups = support(found).where(F.col("support") >= min_support).withColumn("score", F.col("support") * (F.col("node_count") - 1))
    return top(groups, [F.desc("score"), F.desc("support"), F.desc("node_count"), F.col("signature")], size, ("signature", "node_count", "support", "coverage", "score"))


def by_subset(found: DataFrame) -> DataFrame:
    """Support and coverage of every motif by subset, with the first expression that holds it."""
    return found.groupBy("signature", "node_count", "feature_subset").agg(F.sum("c").alias("support"), F.count("*").alias("coverage"), F.min("expr_id").alias("first_expr"))


def split_features(found: DataFrame) -> DataFrame:
    """Support, coverage and nontrivial coverage of every motif by split."""
    plain = F.count_if(F.col("feature_subset") == "nontrivial_v1").alias("nontrivial_coverage")
    return found.groupBy("signature", "node_count", "split").agg(F.sum("c").alias("support"), F.count("*").alias("coverage"), plain)


def scores(features: DataFrame) -> DataFrame:
    """Score of every motif and split under every weight combination of the grid."""
    grid = features.sparkSession.range(1)
    for name, values in GRID.items():
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    grid = grid.withColumn("trial", F.format_string("%.1f/%.1f/%.1f/%.1f", *GRID)).drop("id")
    both = features.join(F.broadcast(grid.withColumnRenamed("coverage", "grid_coverage")))  # a fixed number of rows
    saved = F.col("support") * (F.col("node_count") - 1)
    score = saved + F.col("grid_coverage") * F.col("coverage") + F.col("nontrivial") * F.col("nontrivial_coverage") - F.col("vocabulary") * F.col("node_count") - F.col("expansion") * F.col("node_count") * 2
    return both.select("trial", "signature", "split", rounded(score).alias("score"))


def selection(features: DataFrame, size: int = 5) -> DataFrame:
    """Per trial, the motifs with the best training scores, and what they score on validation rows."""
    found = scores(features)
    both = found.groupBy("trial", "signature").agg(*(F.max(F.when(F.col("split") == s, F.col("score"))).alias(s) for s in ("train", "validation")))
    rank = F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("train"), "signature"))
    both = both.where("train is not null").withColumn("rank", rank).where(F.col("rank") <= size)
    return both.groupBy("trial").agg(F.count("*").alias("n"), rounded(F.sum("train")).alias("train_score"), rounded(F.sum(F.coalesce("validation", F.lit(0.0)))).alias("validation_score"))


def best_trial(features: DataFrame, size: int = 5) -> DataFrame:
    """The trial whose motifs score best on validation rows, then on training rows."""
    return selection(features, size).orderBy(F.desc("validation_score"), F.desc("train_score"), "trial").limit(1)


def train_vs_full(rows: DataFrame, min_support: int = 50) -> DataFrame:
    """Occurrences of the two-node motifs that are frequent among training rows, against those frequent among all rows, by split and subset."""
    per = occurrences(rows).where("node_count = 2").groupBy("split", "feature_subset", "signature").agg(F.sum("c").alias("c"))
    known = Window.partitionBy("signature")  # a few names by six groups
    train, every = F.coalesce(F.sum(F.when(F.col("split") == "train", F.col("c"))).over(known), F.lit(0)), F.sum("c").over(known)
    per = per.withColumns({"in_train": train >= min_support, "in_full": every >= min_support})
    count = lambda flag, name: F.coalesce(F.sum(F.when(F.col(flag), F.col("c"))), F.lit(0)).alias(name)
    sums = per.groupBy("split", "feature_subset").agg(count("in_train", "train_occurrences"), count("in_full", "full_occurrences"))
    both = rows.groupBy("split", "feature_subset").agg(F.count("*").alias("n")).join(sums, ["split", "feature_subset"], "left").fillna(0)
    return both.withColumn("mean_delta", rounded((F.col("full_occurrences") - F.col("train_occurrences")) / F.col("n")))

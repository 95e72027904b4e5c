"""Studies of shared sizes: the DAG of the pure EML form against the expression as tree and as DAG, and macro graphs.

A macro graph has one node for every distinct subtree, labelled by its macro, so its sizes are those of the shared expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exprlake.functions.measures import threshold
from exprlake.functions.stats import at_rank, distribution, median, percent, ranked, rounded, upper_rank
from exprlake.operators.corpus import settled
from exprlake.operators.studies import top

METRICS = ("tree_alpha", "dag_alpha", "dag_alpha_vs_dag", "dag_compression")


def columns() -> list[Column]:
    return [
        F.count("*").alias("n"),
        *(rounded(median(c)).alias(f"median_{c}") for c in METRICS),
        rounded(upper_rank("dag_compression", 0.9)).alias("p90_dag_compression"),
        percent(F.col("dag_alpha") < threshold()).alias("percent_below_dag"),
        percent(F.col("dag_alpha_vs_dag") < threshold()).alias("percent_below_dag_vs_dag"),
        rounded(median("tree_alpha - dag_alpha")).alias("median_improvement"),
    ]


#: What the metrics are made of. All are bounded by the size of an expression, and so is the number of shapes.
SIZES = ("ast_nodes", "eml_nodes", "ast_dag_nodes", "eml_dag_nodes")


def shapes(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, SIZES, n (rows that have these sizes) and METRICS: one row for all rows with the same sizes, so that exact percentiles hold as many values, whatever the number of rows."""
    ratio = lambda a, b: F.col(a) / F.col(b)
    same = rows.groupBy(*keys, *SIZES).agg(F.count("*").alias("n"))
    metrics = (("eml_nodes", "ast_nodes"), ("eml_dag_nodes", "ast_nodes"), ("eml_dag_nodes", "ast_dag_nodes"), ("eml_nodes", "eml_dag_nodes"))
    return same.select("*", *(ratio(*pair).alias(name) for name, pair in zip(METRICS, metrics, strict=True)))


def group_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """columns() of every group, from its shapes."""
    same = ranked(shapes(rows, *keys), "dag_compression", *keys)
    share = lambda c: rounded(100 * (F.sum(F.when(F.col(c) < threshold(), F.col("n")).otherwise(0)) / F.sum("n")))
    return same.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *(rounded(median(c, "n")).alias(f"median_{c}") for c in METRICS),
        rounded(at_rank("dag_compression", 0.9)).alias("p90_dag_compression"),
        share("dag_alpha").alias("percent_below_dag"),
        share("dag_alpha_vs_dag").alias("percent_below_dag_vs_dag"),
        rounded(median("tree_alpha - dag_alpha", "n")).alias("median_improvement"),
    )


def summary(rows: DataFrame) -> DataFrame:
    """Mean, median, upper ranks, maximum and percent below the threshold of every metric, as one row each."""
    items = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in METRICS)))
    same = shapes(rows).select(items.alias("x"), "n").groupBy("x.metric", "x.v").agg(F.sum("n").alias("n"))
    return ranked(same, "v", "metric").groupBy("metric").agg(
        F.sum("n").alias("n"),
        rounded(F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
        rounded(median("v", "n")).alias("median"),
        rounded(at_rank("v", 0.9)).alias("p90"),
        rounded(at_rank("v", 0.95)).alias("p95"),
        rounded(F.max("v")).alias("max"),
        rounded(100 * (F.sum(F.when(F.col("v") < threshold(), F.col("n")).otherwise(0)) / F.sum("n"))).alias("percent_below"),
    )


def shown(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: rounded(F.col(c), 9) for c in ("dag_alpha", "dag_compression")})


def successes(rows: DataFrame, n: int = 20) -> DataFrame:
    """Largest compression times drop in alpha."""
    drop = F.col("tree_alpha") - F.col("dag_alpha")
    rows = shown(rows.withColumns({"drop": rounded(drop, 9), "success_score": rounded(F.col("dag_compression") * F.greatest(drop, F.lit(0.0)))}))
    return top(rows, [F.desc("success_score"), F.desc("dag_compression"), F.desc("drop"), F.col("expr_id")], n, ("expr_id", "expression", "success_score", "dag_compression"))


def failures(rows: DataFrame, n: int = 20) -> DataFrame:
    """Largest alphas against the expression as tree and as DAG, with the least compression."""
    score = F.col("dag_alpha") + F.col("dag_alpha_vs_dag") + F.greatest(F.lit(0.0), 2 - F.col("dag_compression"))
    rows = shown(rows.withColumn("failure_score", rounded(score)))
    return top(rows, [F.desc("failure_score"), F.col("dag_compression"), F.desc("dag_alpha"), F.col("expr_id")], n, ("expr_id", "expression", "failure_score", "dag_alpha"))


def ranked_signatures(rows: DataFrame, score: str, order: list[Column], n: int = 6) -> DataFrame:
    groups = group_summary(rows, "operator_signature").withColumn("score", rounded(F.expr(score)))
    return top(groups, [F.desc("score"), *order, F.col("operator_signature")], n, ("operator_signature", "score", "n"))


def best_signatures(rows: DataFrame) -> DataFrame:
    return ranked_signatures(rows, "median_improvement * median_dag_compression", [F.desc("median_improvement"), F.desc("median_dag_compression"), F.col("median_dag_alpha")])


def worst_signatures(rows: DataFrame) -> DataFrame:
    return ranked_signatures(rows, "median_dag_alpha + median_dag_alpha_vs_dag + greatest(0, 2 - median_dag_compression)", [F.desc("median_dag_alpha"), F.col("median_dag_compression"), F.desc("n")])


def safe_regimes(rows: DataFrame) -> DataFrame:
    return ranked_signatures(rows, "percent_below_dag", [F.col("median_dag_alpha"), F.desc("median_improvement"), F.desc("n")])


def macro_sizes(rows: DataFrame) -> DataFrame:
    """Nodes, references and depth of the macro graph, its alpha and what it saves against the DAG of the pure form."""
    rows = settled(rows, "expr_id", "labels", "subtrees", "ast_depth", "ast_nodes", "ast_dag_nodes", "eml_dag_nodes")
    kept = F.expr("array_distinct(filter(transform(labels, (l, k) -> named_struct('l', l, 's', subtrees[k])), x -> x.l is not null))")
    refs = F.aggregate(kept, F.lit(0).cast("long"), lambda t, x: t + F.when(x["l"].isin("exp", "log"), 1).when(x["l"].isin("Add", "Mul"), 2).otherwise(0))
    return rows.select(
        "expr_id",
        F.col("ast_dag_nodes").alias("macro_nodes"),
        refs.alias("macro_refs"),
        F.col("ast_depth").alias("macro_depth"),
        rounded(F.col("ast_dag_nodes") / F.col("ast_nodes"), 9).alias("alpha_vs_tree"),
        rounded(F.col("eml_dag_nodes") / F.col("ast_dag_nodes"), 9).alias("gain"),
    )


def macro_summary(rows: DataFrame, *keys: str) -> DataFrame:
    rows = rows.withColumns({"alpha": F.col("ast_dag_nodes") / F.col("ast_nodes"), "gain": F.col("eml_dag_nodes") / F.col("ast_dag_nodes")})
    nodes, gains = distribution("ast_dag_nodes", "nodes"), distribution("gain", "gain")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), rounded(median("alpha")).alias("median_macro_alpha"), rounded(median("gain")).alias("median_gain"), *nodes, gains[0], gains[2])

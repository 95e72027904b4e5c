"""The study of what rewriting to normal forms saves: one row an expression and mode, from the row's own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprlake.functions import measures, normal
from exprlake.functions.stats import distribution, median, percent, rounded
from exprlake.operators.corpus import settled
from exprlake.operators.studies import top


def study(rows: DataFrame) -> DataFrame:
    """Sizes before and after, gain, alphas and their place around the threshold; no join."""
    forms = F.explode(F.array(*(F.struct(F.lit(m).alias("rule_mode"), F.col(f"form_{m}").alias("normal_form")) for m in normal.MODES)))
    rows = rows.select("*", forms.alias("form")).select("*", "form.*")
    rows = rows.withColumns({"new_ast_nodes": F.expr(normal.size_sql("normal_form", normal.AST)), "new_eml_nodes": F.expr(normal.size_sql("normal_form", normal.EML))})
    new_alpha = F.col("new_eml_nodes") / F.col("ast_nodes")  # against the original's AST, so that both are comparable
    return rows.select(
        "*",
        new_alpha.alias("new_alpha"),
        (F.col("eml_nodes") / F.col("new_eml_nodes")).alias("gain"),
        F.when(F.col("new_eml_nodes") < F.col("eml_nodes"), "improved").when(F.col("new_eml_nodes") == F.col("eml_nodes"), "equal").otherwise("worse").alias("outcome"),
        ((F.col("tree_alpha") >= measures.threshold()) & (new_alpha < measures.threshold())).alias("crossed"),
    )


def summary(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *(percent(F.col("outcome") == x).alias(f"percent_{y}") for x, y in (("improved", "improved"), ("worse", "worse"), ("equal", "equal"))),
        percent(F.col("tree_alpha") < measures.threshold()).alias("percent_below_before"),
        percent(F.col("new_alpha") < measures.threshold()).alias("percent_below_after"),
        rounded(median("new_alpha")).alias("median_new_alpha"),
        *distribution("gain", "gain"),
    )


def by_subset(rows: DataFrame) -> DataFrame:
    """Summary by mode for all rows and for each row's own subset."""
    return summary(rows.withColumn("subset", F.explode(F.array(F.lit("all_v1"), F.col("feature_subset")))), "rule_mode", "subset")


def by_family(rows: DataFrame) -> DataFrame:
    flags = {f"has_{f.lower()}": F.col(f"n_{f.lower()}") > 0 for f in measures.FAMILIES}
    return summary(rows.withColumns(flags), "rule_mode", "dominant_family", *flags)


def by_triviality(rows: DataFrame) -> DataFrame:
    """Each triviality feature and its value as text, unpivoted."""
    names = ("mul_by_one", "log_one", "exp_log", "log_exp", "number_only", "constant_only")
    items = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), (F.col(n) > 0).cast("string").alias("value")) for n in names)))
    return summary(rows.drop("value").select("*", items.alias("item")).select("*", "item.*"), "rule_mode", "feature", "value")


def top_successes(rows: DataFrame, n: int = 20, subset: str | None = None) -> DataFrame:
    """Improved rows: those that cross the threshold first, then by gain."""
    rows = settled(rows, "expr_id", "expression", "normal_form", "crossed", "gain", "new_alpha", "rule_mode", "outcome", "feature_subset")
    rows = rows.where("rule_mode = 'positive_real' and outcome = 'improved'")
    if subset:
        rows = rows.where(F.col("feature_subset") == subset)
    rows = rows.withColumns({"shown_gain": rounded(F.col("gain")), "success_score": rounded(F.col("gain") + 10 * F.col("crossed").cast("int") - 0.01 * F.col("new_alpha"))})
    order = [F.desc("crossed"), F.desc(rounded(F.col("gain"), 9)), rounded(F.col("new_alpha"), 9), F.col("expr_id")]
    return top(rows, order, n, ("expr_id", "expression", "normal_form", "crossed", *(() if subset else ("shown_gain", "success_score"))))


def top_failures(rows: DataFrame, n: int = 20) -> DataFrame:
    """No gain first, then large remaining alpha."""
    score = F.when(F.col("gain") <= 1, 200.0).otherwise(0.0) + F.col("new_alpha") + 100 * F.greatest(F.lit(0.0), 1 - F.col("gain"))
    kept = rows.where("rule_mode = 'positive_real'").withColumn("failure_score", rounded(score))
    return top(kept, [F.desc("failure_score"), F.col("expr_id")], n, ("expr_id", "expression", "failure_score"))


def mode_gap(rows: DataFrame) -> DataFrame:
    """Per expression, what the positive mode saves beyond the safe one; both forms stand on the expression's row."""
    size = {m: F.expr(normal.size_sql(f"form_{m}", normal.EML)) for m in normal.MODES}
    rows = rows.select("expr_id", size["safe"].alias("safe_nodes"), size["positive_real"].alias("positive_nodes"))
    return rows.withColumn("saved", F.col("safe_nodes") - F.col("positive_nodes"))


def best_signatures(rows: DataFrame, n: int = 6) -> DataFrame:
    groups = summary(rows, "rule_mode", "operator_signature").withColumn("score", rounded(F.expr("10 * gain_median + percent_improved + percent_below_after")))
    return top(groups, [F.desc("score"), F.desc("gain_median"), F.desc("percent_improved"), F.col("rule_mode"), F.col("operator_signature")], n, ("rule_mode", "operator_signature", "score", "n"))


def worst_signatures(rows: DataFrame, n: int = 6) -> DataFrame:
    groups = summary(rows, "rule_mode", "operator_signature").withColumn("score", rounded(F.expr("10 * median_new_alpha + percent_worse + 0.25D * percent_equal")))
    return top(groups, [F.desc("score"), F.desc("median_new_alpha"), F.col("rule_mode"), F.col("operator_signature")], n, ("rule_mode", "operator_signature", "score", "n"))


def safe_regimes(rows: DataFrame, n: int = 6) -> DataFrame:
    """Signatures of the safe mode by subset, nontrivial ones first on equal scores."""
    groups = summary(rows.where("rule_mode = 'safe'"), "feature_subset", "operator_signature").withColumn("score", rounded(F.expr("percent_below_after + 0.1D * percent_improved")))
    return top(groups, [F.desc("score"), F.desc("feature_subset"), F.desc("percent_below_after"), F.desc("n"), F.col("operator_signature")], n, ("feature_subset", "operator_signature", "score", "n"))


def top_families(rows: DataFrame) -> DataFrame:
    """Per mode, the families that gain most and least on average."""
    groups = rows.groupBy("rule_mode", "dominant_family").agg(F.count("*").alias("n"), rounded(F.avg("gain")).alias("w"))
    most = F.max_by("dominant_family", F.struct("w", "n", "dominant_family")).alias("success_family")
    least = F.min_by("dominant_family", F.struct("w", (-F.col("n")).alias("n"), "dominant_family")).alias("failure_family")
    return groups.groupBy("rule_mode").agg(most, least)

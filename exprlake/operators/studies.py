"""Group summaries, thresholds, rankings, joins and set operations over measured expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exprlake.functions import measures
from exprlake.functions.stats import distribution, group_summary, median, percent, rounded, summary_columns, upper_rank
from exprlake.operators.corpus import settled

#: (k, variables) of the threshold scenarios.
SCENARIOS = ((4, 3), (2, 2), (8, 4))


def by_boolean(rows: DataFrame, columns: list[Column] | None = None) -> DataFrame:
    """Summary of both values of every contains flag; values without rows stay, with count 0."""
    flags = F.explode(F.array(*(F.struct(F.lit(f"contains_{f}").alias("feature"), (F.col(f"n_{f.lower()}") > 0).alias("value")) for f in measures.FAMILIES)))
    long = rows.drop("value").select("*", flags.alias("flag")).select("*", "flag.*").groupBy("feature", "value").agg(*(columns or summary_columns()))
    grid = rows.sparkSession.range(1).select(F.explode(F.array(*(F.lit(f"contains_{f}") for f in measures.FAMILIES))).alias("feature")).withColumn("value", F.explode(F.array(F.lit(False), F.lit(True))))
    return grid.join(long, ["feature", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def with_subsets(rows: DataFrame) -> DataFrame:
    """Each row for all_v1 and for its own subset."""
    return rows.withColumn("subset", F.explode(F.array(F.lit("all_v1"), F.col("feature_subset"))))


def threshold_scenarios(rows: DataFrame) -> DataFrame:
    """What lies below each scenario's threshold, by four alphas, in one pass: a row is read once for all scenarios."""
    rows = rows.withColumn("cost_alpha", F.col("estimated_cost") / F.col("ast_nodes"))
    scenario = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.lit(v).cast("long").alias("variables"), F.lit(measures.threshold(k, v)).alias("limit")) for k, v in SCENARIOS)))
    rows = rows.select("tree_alpha", "cost_alpha", "dag_alpha", "dag_alpha_vs_dag", scenario.alias("x")).select("*", "x.*")
    below = [percent(F.col(c) < F.col("limit")).alias(f"percent_{n}") for n, c in (("tree", "tree_alpha"), ("cost", "cost_alpha"), ("dag", "dag_alpha"), ("dag_vs_dag", "dag_alpha_vs_dag"))]
    shown = [rounded(F.avg("tree_alpha")).alias("mean_alpha"), rounded(median("tree_alpha")).alias("median_alpha"), F.count_if(F.col("tree_alpha") >= F.col("limit")).alias("above")]
    out = rows.groupBy("k", "variables", "limit").agg(F.count("*").alias("n"), *shown, *below)
    return out.withColumn("threshold", rounded(F.col("limit"))).drop("limit")


def alpha_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(*summary_columns(), rounded(upper_rank("ast_nodes", 0.5)).alias("median_ast_nodes"))


def distribution_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count("*").alias("n"), *distribution("tree_alpha", "alpha"), *distribution("ast_compression", "compression"))


def histogram(rows: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """Counts of a value in equal bins between its extremes; the last bin holds the maximum."""
    rows = rows.select(F.expr(value).alias("z"))
    both = rows.join(F.broadcast(rows.agg(F.min("z").alias("low"), F.max("z").alias("high"))))  # one row
    spot = F.floor((F.col("z") - F.col("low")) * bins / (F.col("high") - F.col("low")))
    return both.groupBy(F.least(spot, F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def family_metric(rows: DataFrame, n: int = 12) -> DataFrame:
    """The families with most rows, and their signatures' median alphas weighted by rows."""
    groups = rows.groupBy("dominant_family", "operator_signature").agg(F.count("*").alias("w"), median("dag_alpha").alias("v"))
    return groups.groupBy("dominant_family").agg(F.sum("w").alias("n"), rounded(F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("weighted_alpha")).orderBy(F.desc("n"), "dominant_family").limit(n)


def comparison_table(rows: DataFrame) -> DataFrame:
    """Every representation's size beside the others."""
    modes = (("ast_tree", "ast_nodes"), ("ast_dag", "ast_dag_nodes"), ("eml_tree", "eml_nodes"), ("eml_dag", "eml_dag_nodes"), ("estimated", "estimated_cost"))
    items = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.col(c).alias("v")) for m, c in modes)))
    long = rows.select("ast_nodes", items.alias("x")).select("ast_nodes", "x.*")
    return long.groupBy("mode").agg(F.count("*").alias("n"), rounded(median("v")).alias("median_nodes"), rounded(F.avg(F.col("v") / F.col("ast_nodes"))).alias("mean_alpha"))


def top(rows: DataFrame, keys: list, n: int = 20, columns: tuple = ()) -> DataFrame:
    """The first n rows in a total order, with their rank; a heap of n rows a partition."""
    kept = rows.orderBy(*keys).limit(n)
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(*keys)).cast("long")).select("rank", *columns)


def worst_signatures(rows: DataFrame, n: int = 6) -> DataFrame:
    """Signatures among the first n by median or by 90th percentile, ordered by both ranks."""
    groups = group_summary(rows, "operator_signature")
    ties = [F.desc("n"), F.col("operator_signature")]
    groups = groups.withColumn("median_rank", F.row_number().over(Window.orderBy(F.desc("median_alpha"), F.desc("p90_alpha"), *ties)).cast("long"))
    groups = groups.withColumn("p90_rank", F.row_number().over(Window.orderBy(F.desc("p90_alpha"), F.desc("median_alpha"), *ties)).cast("long"))
    kept = groups.where(F.least("median_rank", "p90_rank") <= n)
    return kept.orderBy("median_rank", "p90_rank", "operator_signature").limit(n).select("operator_signature", "median_rank", "p90_rank", "n", "median_alpha", "p90_alpha")


def safest_signatures(rows: DataFrame, n: int = 6) -> DataFrame:
    groups = group_summary(rows, "operator_signature").withColumn("gap", rounded(F.abs(F.col("median_alpha") - measures.threshold())))
    order = [F.desc("percent_below"), F.col("gap"), F.col("p90_alpha"), F.desc("n"), F.col("operator_signature")]
    return top(groups, order, n, ("operator_signature", "percent_below", "gap", "p90_alpha", "n"))


def safe_regimes(rows: DataFrame, n: int = 6) -> DataFrame:
    ratio = F.avg(F.col("eml_nodes") / F.col("ast_nodes"))
    groups = rows.groupBy("operator_signature").agg(*summary_columns(), rounded(ratio).alias("size_ratio"))
    order = [F.desc("percent_below"), F.col("median_alpha"), F.col("p90_alpha"), F.col("size_ratio"), F.col("operator_signature")]
    return top(groups, order, n, ("operator_signature", "percent_below", "median_alpha", "p90_alpha", "size_ratio"))


def depth_failure_modes(rows: DataFrame, n: int = 6) -> DataFrame:
    groups = group_summary(rows, "ast_depth")
    order = [F.desc("p90_alpha"), F.desc("mean_alpha"), F.desc("mean_eml_nodes"), F.col("ast_depth")]
    return top(groups, order, n, ("ast_depth", "p90_alpha", "mean_alpha", "mean_eml_nodes", "n"))


def dedup(rows: DataFrame) -> DataFrame:
    """One row a distinct expression: its smallest id and how often it occurs."""
    return rows.groupBy("expression").agg(F.min("expr_id").alias("expr_id"), F.count("*").alias("copies"))


def generation_summary(rows: DataFrame) -> DataFrame:
    """Per depth: expressions, distinct ones, and the rate of duplicates."""
    per = rows.groupBy("ast_depth", "expression").agg(F.count("*").alias("c"))
    return per.groupBy("ast_depth").agg(F.sum("c").alias("n"), F.count("*").alias("n_distinct"), rounded((F.sum("c") - F.count("*")) / F.sum("c")).alias("duplicate_rate"))


def shared_subtrees(rows: DataFrame, n: int = 50) -> DataFrame:
    """The compound subtrees that occur most, with the expressions that hold them; a row counts its own subtrees before the shuffle."""
    groups = own_subtrees(rows).groupBy("subtree", "label").agg(F.sum("copies").alias("occurrences"), F.count("*").alias("n_expressions"))
    return top(groups, [F.desc("occurrences"), F.desc("n_expressions"), F.col("subtree")], n, ("subtree", "label", "occurrences", "n_expressions"))


def own_subtrees(rows: DataFrame) -> DataFrame:
    """expr_id, subtree, label, copies: the distinct compound subtrees of every expression."""
    rows = settled(rows, "expr_id", "labels", "subtrees")
    compound = F.expr(f"filter(transform(labels, (l, k) -> named_struct('label', l, 'subtree', subtrees[k])), x -> x.label in {measures.FAMILIES})")
    rows = rows.select("expr_id", compound.alias("c"))
    rows = rows.select("expr_id", F.explode(F.expr("transform(array_distinct(c), x -> named_struct('label', x.label, 'subtree', x.subtree, 'copies', cast(size(filter(c, y -> y = x)) as bigint)))")).alias("x"))
    return rows.select("expr_id", "x.subtree", "x.label", "x.copies")


def shared_in_expression(rows: DataFrame, n: int = 3) -> DataFrame:
    """The subtrees that each expression repeats most: an array is sorted and cut inside its row."""
    rows = settled(rows, "expr_id", "labels", "subtrees")
    repeated = own_subtrees_array()
    best = F.slice(F.array_sort(repeated), 1, n)
    rows = rows.select("expr_id", F.posexplode(best).alias("at", "x"))
    return rows.select("expr_id", "x.subtree", (-F.col("x.less")).alias("copies"), (F.col("at") + 1).cast("long").alias("rank"))


def own_subtrees_array() -> Column:
    compound = f"filter(transform(labels, (l, k) -> named_struct('label', l, 'subtree', subtrees[k])), x -> x.label in {measures.FAMILIES})"
    counted = "transform(array_distinct(c), x -> named_struct('less', -cast(size(filter(c, y -> y = x)) as bigint), 'label', x.label, 'subtree', x.subtree))"
    return F.expr(f"filter(transform(array({compound}), c -> {counted})[0], x -> x.less < -1)")


def baseline_join(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows that have a baseline, by an equi-join with its keys, with the difference of alpha to their split's mean over all rows."""
    per = rows.groupBy("split").agg(F.avg("tree_alpha").alias("split_mean"))
    return rows.select("expr_id", "split", "tree_alpha").join(keys, "expr_id").join(F.broadcast(per), "split").select("expr_id", "split", rounded(F.col("tree_alpha") - F.col("split_mean")).alias("delta_alpha"))  # three splits


def missing(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Rows whose key has no finished row: what a resumed run still has to do."""
    return rows.select("expr_id", "expression").join(done.select("expr_id"), "expr_id", "left_anti")


def graph_bundles(rows: DataFrame, baseline: DataFrame, lines: DataFrame) -> DataFrame:
    """Expressions with their baseline's and their lines' measures: two equi-joins on the key, the lines summed first."""
    sums = lines.groupBy(F.col("l_orderkey").alias("expr_id")).agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return rows.select("expr_id", "ast_nodes", "eml_dag_nodes", F.col("ast_dag_nodes").alias("macro_nodes")).join(baseline, "expr_id").join(sums, "expr_id")


def left_form_join(rows: DataFrame, forms: DataFrame) -> DataFrame:
    """Every expression with the rewritten form that another run has for its key, if it has one."""
    forms = forms.select("expr_id", F.col("form_positive_real").alias("normal_form"), F.lit(True).alias("has_form"))
    return rows.select("expr_id").join(forms, "expr_id", "left").select("expr_id", F.coalesce("has_form", F.lit(False)).alias("has_form"), "normal_form")


def form_mismatches(rows: DataFrame, forms: DataFrame) -> DataFrame:
    """Per split, the keys whose form in another run is not the expression itself."""
    both = rows.select("expr_id", "split", "expression").join(forms.select("expr_id", "form_safe"), "expr_id")
    # counted, not filtered: a filter would be pushed into the strings' steps, where each copy of a child's string doubles it
    return both.groupBy("split").agg(F.count_distinct(F.when(F.col("expression") != F.col("form_safe"), F.col("expr_id"))).alias("n")).where("n > 0")

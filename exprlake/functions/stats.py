"""Aggregates that the summaries share: distributions, exact percentiles, group summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exprlake.functions.measures import threshold


def rounded(column: Column, digits: int = 6) -> Column:
    return F.round(column.cast("double"), digits)


def upper_rank(value: str, q: float) -> Column:
    """The value of rank ceil(q n)."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")


def ranked(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """rows, each standing n times, with upto, how many of its group are not above its value, and of, how many there are. A group should be a bounded number of rows."""
    group = Window.partitionBy(*keys)
    upto = group.orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("*", F.sum("n").over(upto).alias("upto"), F.sum("n").over(group).alias("of"))


def at_rank(value: str, q: float) -> Column:
    """upper_rank() of ranked() rows."""
    return F.min(F.when(F.col("upto") >= F.ceil(q * F.col("of")), F.col(value)))


def median(value: str, times: str | None = None) -> Column:
    """The middle value, or the mean of the two middle ones, each standing times times."""
    return F.percentile(F.expr(value), 0.5, F.lit(1) if times is None else F.col(times))


def percent(test: Column) -> Column:
    """Percent of the rows that pass, nulls left out."""
    return rounded(100 * F.avg(test.cast("double")))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return F.when(b != 0, a / b)


def distribution(value: str, prefix: str, times: str | None = None) -> list[Column]:
    """Mean, median and interpolated 90th percentile of the finite values, each standing times times."""
    finite = F.when(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value).cast("double"))
    n = F.lit(1) if times is None else F.col(times)
    mean = F.avg(finite) if times is None else F.sum(finite * n) / F.sum(F.when(finite.isNotNull(), n))
    return [rounded(mean).alias(f"{prefix}_mean"), rounded(F.percentile(finite, 0.5, n)).alias(f"{prefix}_median"), rounded(F.percentile(finite, 0.9, n)).alias(f"{prefix}_p90")]


def group_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Count, alpha statistics, mean sizes and percent below the threshold of every group that has rows."""
    return rows.groupBy(*keys).agg(*summary_columns())


def summary_columns() -> list[Column]:
    a = "tree_alpha"
    return [
        F.count("*").alias("n"),
        rounded(F.avg(a)).alias("mean_alpha"),
        rounded(median(a)).alias("median_alpha"),
        rounded(upper_rank(a, 0.9)).alias("p90_alpha"),
        rounded(upper_rank(a, 0.95)).alias("p95_alpha"),
        rounded(F.max(a)).alias("max_alpha"),
        rounded(F.avg("ast_nodes")).alias("mean_ast_nodes"),
        rounded(F.avg("eml_nodes")).alias("mean_eml_nodes"),
        percent(F.col(a) < threshold()).alias("percent_below"),
    ]

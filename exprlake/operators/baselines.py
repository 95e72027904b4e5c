"""Metrics that another run wrote to files, and a corpus held against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprlake.functions.stats import rounded, safe_divide


def dag_metrics(rows: DataFrame) -> DataFrame:
    """Rows of a metric file of kind dag; the canonical string stands in both text columns."""
    return rows.select(
        F.col("expr_id").alias("index"), "expression", F.col("expression").alias("srepr"), F.lit(True).alias("supported"), F.col("ast_nodes").cast("int").alias("ast_tree_node_count"),
        F.col("ast_dag_nodes").cast("int").alias("ast_dag_node_count"), F.col("eml_nodes").cast("int").alias("eml_tree_node_count"), F.col("eml_dag_nodes").cast("int").alias("eml_dag_node_count"),
        F.col("dag_compression").alias("eml_dag_compression"), "tree_alpha", F.col("dag_alpha").alias("dag_alpha_vs_ast_tree"), F.col("dag_alpha_vs_dag").alias("dag_alpha_vs_ast_dag"), F.lit(None).cast("string").alias("error"),
    )


def against(rows: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every expression that the metric file knows: its own measures, the file's, the share of alpha that sharing saves, and whether both have one text.

    An equi-join on the index; of repeated rows of the file each counts."""
    held = metrics.select(F.col("index").alias("expr_id"), F.col("srepr").alias("held"), F.col("dag_alpha_vs_ast_tree").alias("file_dag_alpha"), F.col("eml_dag_node_count").alias("file_dag_nodes"))
    both = rows.select("expr_id", "expression", "split", "tree_alpha", "eml_nodes").join(held, "expr_id")
    saved = safe_divide(F.col("tree_alpha") - F.col("file_dag_alpha"), F.col("tree_alpha"))
    ratio = safe_divide(F.col("eml_nodes"), F.col("file_dag_nodes"))
    return both.select("expr_id", "split", rounded(F.col("tree_alpha"), 9).alias("tree_alpha"), rounded(F.col("file_dag_alpha"), 9).alias("file_dag_alpha"), rounded(saved, 9).alias("saved_share"), rounded(ratio, 9).alias("compression"), F.col("held").eqNullSafe(F.col("expression")).alias("same_text"))

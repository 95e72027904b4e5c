"""Scans and sinks of the corpus files: JSON lines of expressions, CSV of metrics, nested graph records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXPRESSION_SCHEMA = T.StructType([
    T.StructField("index", T.LongType()),
    T.StructField("expression", T.StringType()),
    T.StructField("srepr", T.StringType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("metadata", T.StringType()),
])
_SIZES = "ast_tree_node_count INT, ast_dag_node_count INT"
_KEY = "index BIGINT, expression STRING, srepr STRING"
#: Columns of the metric files by kind, as DDL.
METRIC_KINDS = {
    "expansion": "expr_id BIGINT, expression STRING, supported BOOLEAN, ast_nodes BIGINT, eml_nodes BIGINT, tree_alpha DOUBLE",
    "dag": f"{_KEY}, supported BOOLEAN, {_SIZES}, eml_tree_node_count INT, eml_dag_node_count INT, eml_dag_compression DOUBLE, tree_alpha DOUBLE, dag_alpha_vs_ast_tree DOUBLE, dag_alpha_vs_ast_dag DOUBLE, error STRING",
    "macro": f"{_KEY}, supported BOOLEAN, macro_graph_nodes INT, macro_graph_depth INT, macro_graph_alpha_vs_ast_tree DOUBLE, compression_gain_vs_eml_dag DOUBLE, expansion_valid BOOLEAN, error STRING",
    "motif": f"{_KEY}, supported BOOLEAN, compressed_node_count INT, compression_gain DOUBLE, expansion_valid BOOLEAN, split STRING, subset_label STRING",
    "egraph": "index BIGINT, original_expression STRING, original_srepr STRING, rule_mode STRING, saturation_status STRING, extraction_status STRING, validation_status STRING, timeout BOOLEAN, original_eml_dag_nodes INT, extracted_eml_dag_nodes INT, compression_gain DOUBLE",
    "signature": "operator_signature STRING, count BIGINT, median_tree_alpha DOUBLE, median_dag_alpha DOUBLE, p90_dag_compression DOUBLE, percent_below DOUBLE, median_improvement DOUBLE",
}
METRIC_SCHEMA = METRIC_KINDS["expansion"]


def read_expressions(spark: SparkSession, path: str, count: int | None = None) -> DataFrame:
    """JSON lines of expressions; with count, the rows of index below it, which must all be there."""
    rows = spark.read.schema(EXPRESSION_SCHEMA).option("mode", "FAILFAST").json(path)
    if count is None:
        return rows
    rows = rows.where(F.col("index") < count)
    if (found := rows.count()) < count:
        raise ValueError(f"expected {count} expressions, found {found}")
    return rows


def read_metrics(spark: SparkSession, path: str, kind: str = "expansion", bad: str = "fail") -> DataFrame:
    """CSV of metrics of one of METRIC_KINDS, with a header, columns in any order; rows that are not supported are left out where the kind marks them.

    A column that the kind has and the file lacks is a ValueError; columns beyond the kind's are left out. Empty fields are null. A value that its column's type
    does not take makes a row bad: fail ends the job with the column's name, drop leaves the row out, and report keeps it, null there, with the column's name in bad."""
    if bad not in ("fail", "drop", "report"):
        raise ValueError(f"unknown way with bad rows: {bad}")
    fields = T.StructType.fromDDL(METRIC_KINDS[kind]).fields
    raw = spark.read.option("header", True).csv(path)
    if missing := [f.name for f in fields if f.name not in raw.columns]:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    typed = lambda f: F.col(f"`{f.name}`").try_cast(f.dataType)
    wrong = F.array_compact(F.array(*(F.when(F.col(f"`{f.name}`").isNotNull() & typed(f).isNull(), F.lit(f.name)) for f in fields)))
    rows = raw.select(*(typed(f).alias(f.name) for f in fields), wrong.alias("bad"))
    if bad == "fail":
        rows = rows.withColumn("bad", F.when(F.size("bad") > 0, F.raise_error(F.concat(F.lit("bad value in "), F.array_join("bad", ", ")))).otherwise(F.col("bad"))).where("size(bad) = 0")
    elif bad == "drop":
        rows = rows.where("size(bad) = 0")
    rows = rows if bad == "report" else rows.drop("bad")
    return rows.where("supported") if any(f.name == "supported" for f in fields) and bad != "report" else rows


def write_summary(rows: DataFrame, path: str) -> None:
    """A small summary table as one JSON file, columns in name order."""
    rows.select(*sorted(rows.columns)).coalesce(1).write.json(path)


def write_json(rows: DataFrame, path: str, *partitions: str) -> None:
    """JSON lines with columns in name order."""
    rows.select(*sorted(rows.columns)).write.partitionBy(*partitions).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; nested columns become JSON text."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in rows.schema.fields]
    rows.select(*flat).write.option("header", True).csv(path)


def write_splits(rows: DataFrame, path: str) -> None:
    """The ids of every split and their number; the ids stay rows, one file set a split."""
    rows.select("split", "expr_id").distinct().write.partitionBy("split").json(path)

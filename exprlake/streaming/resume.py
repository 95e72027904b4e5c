"""A resumable measuring run over a stream of keys, with summaries that are merged over its batches.

Measured rows lie under target/rows by key range and batch, each batch's summary under target/summary by batch. A batch writes its own folders
only, and anew when it is tried again, so a batch that was killed half-way leaves nothing behind that counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from exprlake.operators import corpus, export

#: What a run keeps of every expression, and the length of a key range as a power of two.
COLUMNS = ("expr_id", "expression", "ast_nodes", "ast_depth", "ast_dag_nodes", "eml_nodes", "eml_depth", "eml_dag_nodes", "tree_alpha", "operator_signature", "split")
RANGE_BITS = 16


def _written(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What is at path so far, without rows before the first batch."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return spark.read.schema(schema).parquet(path) if files.exists(there) else spark.createDataFrame([], schema)


def measured(batch: DataFrame, key: str, done: DataFrame) -> DataFrame:
    """COLUMNS and key_range of the batch's keys that done (key_range, expr_id) does not hold, each once; of done only the batch's key ranges are read."""
    keys = batch.select(F.col(key).cast("long").alias(key)).where(F.col(key).isNotNull()).distinct().withColumn("key_range", F.shiftright(key, RANGE_BITS))
    held = done.select("key_range", F.col("expr_id").alias(key))
    ranges = keys.select("key_range").distinct()
    fresh = keys.join(held.join(ranges, "key_range", "left_semi"), ["key_range", key], "left_anti")
    return corpus.facts(fresh.select(key), key).select(*COLUMNS, F.shiftright("expr_id", RANGE_BITS).alias("key_range"))


def run(spark: SparkSession, source: str, target: str, checkpoint: str, key: str = "event_id") -> None:
    """Measure every key that has arrived under source since the last run, append it to target and summarise it.

    The stream's checkpoint remembers finished files and the number of the batch that was under way. Keys that earlier batches have measured are left out, and repeated keys
    of a batch count once; no state grows with the stream but target itself, of which a batch reads the key ranges that it has keys in. Null keys are left out."""
    keys = spark.readStream.schema(T.StructType([T.StructField(key, T.LongType())])).parquet(source)

    def append(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows_schema = T.StructType([T.StructField("expr_id", T.LongType()), T.StructField("batch", T.LongType()), T.StructField("key_range", T.LongType())])
        done = _written(session, f"{target}/rows", rows_schema).where(F.col("batch") < number)
        rows = measured(batch, key, done)
        rows.write.mode("overwrite").partitionBy("key_range").parquet(f"{target}/rows/batch={number}")
        mine = session.read.parquet(f"{target}/rows/batch={number}").select("expr_id") if not rows.isEmpty() else session.createDataFrame([], "expr_id long")
        summarise(corpus.facts(mine, "expr_id")).write.mode("overwrite").parquet(f"{target}/summary/batch={number}")

    query = keys.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def summarise(rows: DataFrame) -> DataFrame:
    """A mergeable summary: sums and counts by representation mode."""
    return export.summary(rows)


def summary(spark: SparkSession, target: str) -> DataFrame:
    """The summaries of all batches as one: representation_mode, nodes, graphs, edges."""
    parts = spark.read.parquet(f"{target}/summary")
    return parts.groupBy("representation_mode").agg(*(F.sum(c).alias(c) for c in ("nodes", "graphs", "edges")))


def rows(spark: SparkSession, target: str) -> DataFrame:
    """All measured rows."""
    return spark.read.parquet(f"{target}/rows").drop("batch", "key_range")

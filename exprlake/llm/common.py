"""Helpers that several training-data operators share: table reads, shared-folder staging, graph components."""

from __future__ import annotations

import tempfile
import uuid
import weakref

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts that split on ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="exprlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Paths of staged tables by the DataFrame that reads them, for release().
_staged: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the result survives a lost executor and has no lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/exprlake-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _staged[table] = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for table in tables:
        if path := _staged.pop(table, None):
            jvm = table.sparkSession._jvm
            there = jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(there, True)


#: Rows of an Arrow batch of texts at most: a batch of long documents stays within a few megabytes on both sides.
TEXT_ROWS = 1_000


def text_rows(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches cut to TEXT_ROWS rows; results do not depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(df.sparkSession.conf.get(name))
    if held <= 0 or held > TEXT_ROWS:
        df.sparkSession.conf.set(name, str(TEXT_ROWS))
    return df


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Edges that one task may settle; a larger graph is first reduced by distributed rounds.
SMALL_GRAPH = 200_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph, by alternating large-star and small-star rounds.

    edges has columns a and b of one orderable type; loops and repeats are allowed, nulls are dropped. Returns
    (node, root) for every node of an edge between two different nodes, root being the component's smallest
    node. Each round is two grouped minima and two joins on the node; a hub's neighbours are split by the adaptive
    skew join because the minima side is unique by node. A graph of at most SMALL_GRAPH edges, a fixed bound, is settled
    in one task without rounds. Nothing is collected but one row of counts a round.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if SMALL_GRAPH and edges.count() <= SMALL_GRAPH:
        kind = edges.schema["a"].dataType.simpleString()
        roots = stage(edges.coalesce(1).mapInArrow(_settle, f"node {kind}, root {kind}"), "roots")
        release(edges)
        return roots
    before = _state(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, edges = edges, stage(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        release(last)
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _settle(batches):
    """Roots of all nodes of one small graph, by union-find with the smaller root on top."""
    parent: dict = {}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(parent.setdefault(a, a)), find(parent.setdefault(b, b))
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], ["node", "root"])


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return (row["n"], row["h"])

"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode one folder a session of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="exprlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stage(rows: DataFrame, label: str) -> DataFrame:
    """rows, written and read again: without lineage, and safe from lost executors."""
    path = f"{shared_folder(rows.sparkSession)}/exprlake-{label}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)

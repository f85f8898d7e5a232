"""Materialised intermediate tables in the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """Shared folder from ``spark.checkpoint.dir``; a temporary one only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and spark.sparkContext.getCheckpointDir() is not None:
        root = spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="sievelab-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def save_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet and read it back.

    Later passes then start from files that outlive any executor, and from a short lineage. Jobs keep several tables of
    whole texts at a time, so they are compressed more than Spark's default does.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)

"""The status table kept from a stream of status events: the upsert, once per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievelab.operators.status import STATUS_SCHEMA, upsert_status


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """Newest version of the status table below ``path``."""
    versions = spark.read.schema(f"{STATUS_SCHEMA}, version long").parquet(path)
    return versions.where(F.col("version") == versions.agg(F.max("version")).scalar()).drop("version")


def follow_status(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Apply every available event to the table below ``path``, then stop.

    Micro-batches are numbered without gaps, and batch n writes version n from version n - 1. A batch that is run
    again after a failure therefore gives the same version, and no event counts twice.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id == 0:
            old = spark.createDataFrame([], STATUS_SCHEMA)
        else:
            old = spark.read.schema(STATUS_SCHEMA).parquet(f"{path}/version={batch_id - 1}")
        upsert_status(old, batch).write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return (
        events.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

"""Job-status table kept by upsert, and the stage log that feeds it."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUS_SCHEMA = "jobid string, area string, status string, progress int, start_time timestamp, update_time timestamp"
EVENT_SCHEMA = "jobid string, area string, status string, progress int, ts timestamp, event_id long"

# Stages in order, with the progress each one reports.
STAGES = {
    "STARTED": 0,
    "RF_COMPLETED": 30,
    "LASSO_COMPLETED": 50,
    "STEP_FORWARD_COMPLETED": 70,
    "MIC_COMPLETED": 90,
    "COMPLETED": 100,
}


def stage_events(spark: SparkSession, job_id: str, area: str, reached: list[tuple[str, dt.datetime]]) -> DataFrame:
    """Status events of one run, numbered in order."""
    rows = [(job_id, area, stage, STAGES.get(stage), when, i) for i, (stage, when) in enumerate(reached)]
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def fold_events(events: DataFrame) -> DataFrame:
    """Status table that the events leave behind, plus the number of events and the first event's time.

    The first event of a job sets area and start time and leaves update time null; every later one sets status,
    progress and update time. One aggregate with map-side combine, so a job with very many events is no hot spot.
    """
    order = F.struct("ts", "event_id")
    return events.groupBy("jobid").agg(
        F.min_by("area", order).alias("area"),
        F.max_by("status", order).alias("status"),
        F.max_by("progress", order).alias("progress"),
        F.min("ts").alias("start_time"),
        F.when(F.count(F.lit(1)) > 1, F.max("ts")).alias("update_time"),
        F.max("ts").alias("last_ts"),
    )


def status_of(events: DataFrame) -> DataFrame:
    return fold_events(events).drop("last_ts")


def upsert_status(target: DataFrame, events: DataFrame) -> DataFrame:
    """Status table after applying later events: known jobs keep area and start time, new jobs are inserted."""
    new = fold_events(events).alias("n")
    old = target.alias("o")
    known = F.col("o.jobid").isNotNull()
    seen = F.col("n.jobid").isNotNull()
    return old.join(new, F.col("o.jobid") == F.col("n.jobid"), "full_outer").select(
        F.coalesce("o.jobid", "n.jobid").alias("jobid"),
        F.when(known, F.col("o.area")).otherwise(F.col("n.area")).alias("area"),
        F.when(seen, F.col("n.status")).otherwise(F.col("o.status")).alias("status"),
        F.when(seen, F.col("n.progress")).otherwise(F.col("o.progress")).alias("progress"),
        F.when(known, F.col("o.start_time")).otherwise(F.col("n.start_time")).alias("start_time"),
        F.when(known & seen, F.col("n.last_ts"))
        .when(known, F.col("o.update_time"))
        .otherwise(F.col("n.update_time"))
        .alias("update_time"),
    )


class StatusTable:
    """The status table below ``path``, in two copies that are written in turn; the later one holds.

    A write that breaks off leaves the other copy as it was. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _copies(self) -> DataFrame:
        empty = self.spark.createDataFrame([], f"{STATUS_SCHEMA}, version long")
        for copy in (0, 1):
            try:
                found = self.spark.read.parquet(f"{self.path}/copy-{copy}")
            except AnalysisException as missing:
                if missing.getCondition() != "PATH_NOT_FOUND":
                    raise
            else:
                empty = empty.unionByName(found)
        return empty

    def read(self) -> DataFrame:
        return self._current()[0]

    def _current(self) -> tuple[DataFrame, int]:
        copies = self._copies()
        version = copies.agg(F.max("version")).first()[0]
        return copies.where(F.col("version") == F.lit(version)).drop("version"), -1 if version is None else version

    def upsert(self, events: DataFrame) -> None:
        """Apply later events, as one new version."""
        old, version = self._current()
        new = upsert_status(old, events).withColumn("version", F.lit(version + 1).cast("long"))
        new.write.mode("overwrite").parquet(f"{self.path}/copy-{(version + 1) % 2}")


def list_status(status: DataFrame) -> DataFrame:
    """Newest update first; jobs never updated lead, then by job id."""
    return status.orderBy(F.desc_nulls_first("update_time"), F.asc("jobid"))

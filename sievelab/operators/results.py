"""Rows of the three result tables and their sinks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelab.functions.columns import name_param, name_step, with_dt
from sievelab.operators.cleaning import OK

IMPORTANCE_COLUMNS = ["code", "param", "step", "importance_mean", "job_id", "dt"]


def importance_rows(stats: DataFrame, code: str, job_id: str, as_of: dt.datetime) -> DataFrame:
    """One row per variable, all variables."""
    rows = stats.select(
        F.lit(code).alias("code"),
        name_param(F.col("variable")).alias("param"),
        name_step(F.col("variable")).alias("step"),
        F.col("mean").alias("importance_mean"),
        F.lit(job_id).alias("job_id"),
    )
    return with_dt(rows, as_of)


def coeff_rows(model: DataFrame, code: str, job_id: str, as_of: dt.datetime) -> DataFrame:
    rows = model.select(
        F.lit(code).alias("code"), "variable", "score", "abs_score", F.lit(job_id).alias("job_id")
    )
    return with_dt(rows, as_of)


def result_rows(best: DataFrame, job_id: str, as_of: dt.datetime) -> DataFrame:
    """Suggested pairs. Their code is always '0': rows exist only when the job found pairs."""
    rows = best.select(
        F.lit(OK).alias("code"),
        "final",
        "suggestion",
        "abs_spearman_fs",
        "abs_spearman_ts",
        "mean_of_corr",
        "mic",
        "mean_of_corr_mic",
        F.lit(job_id).alias("job_id"),
    )
    return with_dt(rows, as_of)


def error_rows(jobs: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Importance rows of stopped jobs: (job_id, code) with a code becomes one marker row each."""
    marker = F.lit("error")
    rows = jobs.where(F.col("code").isNotNull()).select(
        "code",
        marker.alias("param"),
        marker.alias("step"),
        F.lit(None).cast("double").alias("importance_mean"),
        F.col("job_id").cast("string").alias("job_id"),
    )
    return with_dt(rows, as_of)


def error_row(spark: SparkSession, code: str, job_id: str, as_of: dt.datetime) -> DataFrame:
    return error_rows(spark.createDataFrame([(job_id, code)], "job_id string, code string"), as_of)


def append_table(rows: DataFrame, path: str, format: str = "parquet") -> None:
    """Append to a path-based table partitioned by day."""
    rows.write.format(format).mode("append").partitionBy("dt").save(path)


def append_catalog_table(rows: DataFrame, table: str) -> None:
    """Append to an existing table of the session's catalogs."""
    rows.writeTo(table).append()

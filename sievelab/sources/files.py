"""File scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """Back-ticked column name; feature names contain dots."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str):
    return F.col(quoted(name))


def read_job_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header row, one column per parameter.

    Type inference reads the files once more than needed, so a known ``schema`` is preferred. A read failure
    is raised to the caller.
    """
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """Named columns only; the scan reads nothing else."""
    return df.select(*[column(c) for c in columns])


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """Any ``n`` rows, no order implied."""
    return df.limit(n)


def table_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def clock(spark: SparkSession, message: str = "ok") -> DataFrame:
    """One row: current date, current timestamp and a literal."""
    return spark.range(1).select(
        F.current_date().alias("spark_date"),
        F.current_timestamp().alias("spark_timestamp"),
        F.lit(message).alias("message"),
    )

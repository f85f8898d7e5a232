"""Column expressions without a data pass of their own."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def adjusted_r2(r2: Column, n: Column, p: Column) -> Column:
    """1 - (1 - r2)(n - 1)/(n - p - 1); null where n - p - 1 is zero."""
    return F.lit(1.0) - F.try_divide((F.lit(1.0) - r2) * (n - 1), (n - p - 1).cast("double"))


def name_step(name: Column) -> Column:
    """Part of ``step.param`` before the first dot."""
    return F.get(F.split(name, r"\."), F.lit(0))


def name_param(name: Column) -> Column:
    """Second dotted part of a feature name; null where there is no dot, later parts are ignored."""
    return F.get(F.split(name, r"\."), F.lit(1))


def split_name(df: DataFrame, variable: str = "variable") -> DataFrame:
    return df.withColumn("step", name_step(F.col(variable))).withColumn("param", name_param(F.col(variable)))


def event_time(df: DataFrame, column: str, alias: str = "time") -> DataFrame:
    """Adds the parsed timestamp and its microseconds since the epoch."""
    parsed = F.col(f"`{column}`").cast("timestamp")
    return df.withColumn(alias, parsed).withColumn(f"{alias}_micros", F.unix_micros(parsed))


def day_partition(as_of: dt.datetime | dt.date | Column) -> Column:
    """``yyyyMMdd`` of the given moment, the daily partition key of every result table."""
    moment = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return F.date_format(moment, "yyyyMMdd")


def with_dt(df: DataFrame, as_of: dt.datetime | dt.date | Column) -> DataFrame:
    return df.withColumn("dt", day_partition(as_of))


def scaled_importance(importance: Column, std: Column) -> Column:
    """importance / std; infinite for a positive importance without spread, null for zero over zero."""
    return F.when((std == 0) & (importance > 0), F.lit(float("inf"))).otherwise(F.try_divide(importance, std))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation that is null, not an error, when one side is constant."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0))


def blend_scores(pairs: DataFrame) -> DataFrame:
    """Mean of the feature-feature rank correlation with the target correlation, and with the MIC."""
    fs, ts, mic = F.col("abs_spearman_fs"), F.col("abs_spearman_ts"), F.col("mic")
    return pairs.withColumn("mean_of_corr", (fs + ts) / 2).withColumn("mean_of_corr_mic", (fs + mic) / 2)

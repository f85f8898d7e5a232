"""Top-k, best row overall and best row per key, with deterministic ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelab.operators.ordering import quantiles


def top_n(df: DataFrame, score: str, n: int, tie: str = "variable") -> DataFrame:
    """The ``n`` highest scores, best first; equal scores by ``tie`` ascending."""
    return df.orderBy(F.desc_nulls_last(score), F.asc(tie)).limit(n)


def top_n_abs(df: DataFrame, coefficient: str, n: int, tie: str = "variable") -> DataFrame:
    """The ``n`` largest absolute coefficients, largest first."""
    return df.orderBy(F.desc_nulls_last(F.abs(coefficient)), F.asc(tie)).limit(n)


def argmax(df: DataFrame, score: str, tie: list[str], by: list[str] | None = None) -> DataFrame:
    """The row with the highest score, per key if ``by`` is given; equal scores by ``tie`` ascending.

    An aggregate, not a window: each task keeps one row per key before anything is shuffled, so a frequent key
    costs no more than a rare one.
    """
    by = by or []
    scored = df.where(F.col(score).isNotNull())
    order = F.struct((-F.col(score)).alias("down"), *[F.col(t) for t in tie])
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in by])
    best = scored.groupBy(*by).agg(F.min_by(whole, order).alias("best"))
    return best.where(F.col("best").isNotNull()).select(*by, "best.*").select(*df.columns)


def above_median(rows: DataFrame, score: str, **options) -> DataFrame:
    """Rows strictly above the exact median of the whole table."""
    present = rows.where(F.col(score).isNotNull()).select(score)
    median = quantiles(present, score, {"median": 0.5}, **options)
    return rows.where(F.col(score) > median.scalar())


def result_code(pairs: DataFrame, alias: str = "code") -> DataFrame:
    """One row: '0' when any pair is left, else '2'."""
    return pairs.agg(F.when(F.count(F.lit(1)) > 0, "0").otherwise("2").alias(alias))


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    return df.select(name).distinct()


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Row-wise concatenation by column name."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


def sort_desc(df: DataFrame, score: Column | str, tie: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(score), F.asc(tie))

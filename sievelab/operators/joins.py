"""Joins of large row sets with small per-key tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000
SALTS = 64


def fix_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, int | None]:
    """The same rows as a local table and their number, or ``df`` itself and None beyond ``max_rows``.

    Fetching stops one row past the limit, which proves the bound and evaluates ``df`` only once.
    """
    head = df.limit(max_rows + 1).collect()
    if len(head) > max_rows:
        return df, None
    return df.sparkSession.createDataFrame(head, df.schema), len(head)


def broadcast_small(saved: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast up to ``max_rows``. Executors read it themselves, without Python workers."""
    return F.broadcast(saved) if saved.limit(max_rows + 1).count() <= max_rows else saved


def attach_small(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    known_rows: int | None = None,
    max_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Join ``small`` (unique on ``on``) to ``big`` without moving ``big`` while ``small`` is proven small.

    ``known_rows`` is a bound the caller can prove, such as the number of feature columns; without it the size is
    tested. Past the limit both sides are shuffled, and every key is spread over salts, so that a key holding a large
    share of ``big`` is not one task.
    """
    if known_rows is None:
        small, known_rows = fix_small(small, max_rows)
    if known_rows is not None and known_rows <= max_rows:
        return big.join(F.broadcast(small), on, how)
    salt = "__salt"
    # by input partition, which spreads equal rows too and which a repeated task finds again
    spread = F.pmod(F.spark_partition_id(), F.lit(SALTS)).cast("int")
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = big.withColumn(salt, spread).join(copies, [*on, salt], how)
    return joined.drop(salt)

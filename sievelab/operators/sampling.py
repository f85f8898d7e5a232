"""Seeded splits, contiguous folds, and the alpha grid."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelab.operators.ordering import values_at

MAX_BUCKETS = 1 << 16


def sample_key(seed: int, replicate: Column | int, row_id: Column) -> Column:
    """Uniform pseudo-random hex string of a row, the same on every engine."""
    replicate = replicate if isinstance(replicate, Column) else F.lit(replicate)
    return F.md5(F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), row_id.cast("string")))


@dataclass(frozen=True)
class SampleCut:
    """Last sampled row of one replicate, in (key, row_id) order."""

    seed: int
    replicate: int
    key: str
    row_id: int

    def contains(self, row_id: str = "row_id") -> Column:
        key = sample_key(self.seed, self.replicate, F.col(row_id))
        place = F.struct(key.alias("key"), F.col(row_id).cast("long").alias("row_id"))
        return place <= F.struct(F.lit(self.key).alias("key"), F.lit(self.row_id).cast("long").alias("row_id"))


def exact_cuts(
    ids: DataFrame,
    share: float,
    seed: int,
    replicates: int = 1,
    row_id: str = "row_id",
    rows: int | None = None,
    rows_per_bucket: int | None = None,
) -> list[SampleCut]:
    """Cuts that put exactly ceil(share x n) rows of each replicate into its sample.

    Ordering all rows by a random key would be one task. The keys are uniform, so their leading hex digits are
    even buckets: count those, then order only the bucket the cut falls into. Applying a cut is map-only.
    """
    rows = ids.count() if rows is None else rows
    wanted = math.ceil(share * rows - 1e-9)
    if wanted <= 0:
        return []
    rows_per_bucket = rows_per_bucket or max(20_000, rows // MAX_BUCKETS)
    digits = 0 if rows <= rows_per_bucket else math.ceil(math.log(rows / rows_per_bucket, 16))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")
    keyed = ids.select(F.col(row_id).alias("row_id"), numbers).withColumn(
        "key", sample_key(seed, F.col("replicate"), F.col("row_id"))
    )
    keyed = keyed.withColumn("bucket", F.substring("key", 1, digits))
    if digits:
        sizes = keyed.groupBy("replicate", "bucket").agg(F.count(F.lit(1)).alias("size"))
        running = Window.partitionBy("replicate").orderBy("bucket")
        sizes = sizes.withColumn("upto", F.sum("size").over(running))
        edge = sizes.where((F.col("upto") >= wanted) & (F.col("upto") - F.col("size") < wanted))
        edge = edge.select("replicate", "bucket", (F.lit(wanted) - F.col("upto") + F.col("size")).alias("place"))
        keyed = keyed.join(F.broadcast(edge), ["replicate", "bucket"])  # one bucket per replicate
    else:
        keyed = keyed.withColumn("place", F.lit(wanted))
    position = F.row_number().over(Window.partitionBy("replicate").orderBy("key", "row_id"))
    last = keyed.withColumn("position", position).where("position = place")
    found = last.select("replicate", "key", "row_id").orderBy("replicate").collect()  # one row per replicate
    return [SampleCut(seed, r["replicate"], r["key"], r["row_id"]) for r in found]


def hashed_share(share: float, seed: int, replicate: int = 0, row_id: str = "row_id") -> Column:
    """Sample of about ``share`` of the rows without any data pass."""
    return sample_key(seed, replicate, F.col(row_id)) < F.lit(f"{int(share * 16**12):012x}")


def train_test(df: DataFrame, test_share: float = 0.3, seed: int = 42, row_id: str = "row_id", **options) -> DataFrame:
    """Adds ``is_test``, true for ceil(test_share x n) rows."""
    cuts = exact_cuts(df.select(row_id), test_share, seed, 1, row_id, **options)
    return df.withColumn("is_test", cuts[0].contains(row_id) if cuts else F.lit(False))


def subsamples(
    df: DataFrame, replicates: int = 10, held_out: float = 0.3, seed: int = 7, row_id: str = "row_id", **options
) -> DataFrame:
    """Every replicate's training rows: all rows but ceil(held_out x n), drawn without replacement."""
    cuts = exact_cuts(df.select(row_id), held_out, seed, replicates, row_id, **options)
    if not cuts:
        return df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    taken = F.array(*[F.when(~c.contains(row_id), F.lit(c.replicate)) for c in cuts])
    return df.withColumn("replicate", F.explode(F.array_compact(taken)))


def fold_sizes(n: int, k: int) -> list[int]:
    """Sizes of k contiguous folds, the first n mod k one larger."""
    return [n // k + (1 if i < n % k else 0) for i in range(k)]


def fold_ends(ids: DataFrame, k: int = 5, row_id: str = "row_id", rows: int | None = None, **options) -> list[int]:
    """Row key of the last row of each fold but the last."""
    rows = ids.count() if rows is None else rows
    ends, total = [], 0
    for size in fold_sizes(rows, k)[:-1]:
        total += size
        if size:
            ends.append(total)
    if not ends:
        return []
    found = values_at(
        ids.select(F.col(row_id).alias("row_id")),
        "row_id",
        lambda n: F.array(*[F.lit(e).cast("long") for e in ends]),
        sizes=(rows, 1),
        **options,
    ).collect()  # k - 1 rows
    at = {r["position"]: r["row_id"] for r in found}
    return [at[e] for e in ends]


def fold_of(ends: list[int], row_id: str = "row_id") -> Column:
    """Fold number from 0, by comparison with the fold ends."""
    fold = F.lit(0)
    for end in ends:
        fold = fold + (F.col(row_id) > end).cast("int")
    return fold


def kfold(df: DataFrame, k: int = 5, row_id: str = "row_id", **options) -> DataFrame:
    """Adds ``fold``: k contiguous blocks in row order."""
    return df.withColumn("fold", fold_of(fold_ends(df.select(row_id), k, row_id, **options), row_id))


def alpha_values(low: float = -10.0, high: float = -3.0, count: int = 100) -> list[float]:
    return [10.0 ** (low + (high - low) * i / (count - 1)) for i in range(count)]


def alpha_grid(spark: SparkSession, low: float = -10.0, high: float = -3.0, count: int = 100) -> DataFrame:
    """``count`` log-spaced penalties from 10^low to 10^high."""
    exponent = F.lit(low) + F.lit(high - low) * F.col("id") / F.lit(count - 1)
    return spark.range(count).select(F.col("id").cast("int").alias("step"), F.pow(F.lit(10.0), exponent).alias("alpha"))

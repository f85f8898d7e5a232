"""What several operators of this subpackage share: reading documents, bounded batches, range buckets."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LONG_MIN = -(2**63)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def full_text() -> Column:
    """The text; null reads as empty."""
    return F.coalesce(F.col("text"), F.lit(""))


def id_key() -> Column:
    """doc_id without nulls, which pandas would make a float column of: the least long stands for null."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LONG_MIN)).alias("doc_id")


def with_null_ids(df: DataFrame) -> DataFrame:
    """Undo id_key()."""
    return df.withColumn("doc_id", F.when(F.col("doc_id") != LONG_MIN, F.col("doc_id")))


def fold(remainders: int) -> Column:
    """crc32 of the document id as text, modulo ``remainders``; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % remainders, F.lit(0))


def text_groups(texts: Sequence[str], chars: int) -> Iterator[range]:
    """Consecutive positions whose texts hold about ``chars`` characters together; a longer text stands alone."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > chars:
            yield range(start, i)
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield range(start, len(texts))


def frames_by_size(frames: Iterable, column: str, chars: int) -> Iterator:
    """The same rows in smaller frames, so that what is derived from one of them stays bounded."""
    for frame in frames:
        texts = frame[column].tolist()
        for part in text_groups(texts, chars):
            yield frame.iloc[part.start : part.stop].reset_index(drop=True)


def cut_points(df: DataFrame, key: Column, rows_per_bucket: int, most: int = 10_000) -> list[int]:
    """Ascending values of a long ``key`` that split ``df`` into buckets of about ``rows_per_bucket`` rows.

    The first is the smallest key. ``most`` bounds what the driver holds; beyond it buckets grow.
    """
    total = df.count()
    buckets = max(1, min(most, math.ceil(total / rows_per_bucket)))
    shares = [i / buckets for i in range(1, buckets)] or [0.0]
    row = df.agg(F.min(key).alias("low"), F.percentile_approx(key, shares, max(10_000, 20 * buckets)).alias("cuts")).first()
    return [] if row["low"] is None else sorted({row["low"], *row["cuts"]})


def bucket_of(key: Column, cuts: Sequence[int]) -> Column:
    """Index of the last cut at or below ``key``, found in two steps of about the square root of their number."""
    width = max(1, math.isqrt(len(cuts)))
    blocks = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    heads = F.array(*[F.lit(b[0]) for b in blocks])
    inner = F.array(*[F.array(*[F.lit(c) for c in b]) for b in blocks])
    block = F.size(F.filter(heads, lambda c: c <= key))
    within = F.size(F.filter(F.element_at(inner, block), lambda c: c <= key))
    return ((block - 1) * width + within - 1).cast("int")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """What is run inside sends at most so many rows at once to Python, as a batch is held whole there."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)

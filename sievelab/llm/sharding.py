"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sievelab.llm.common import full_text
from sievelab.sources.scratch import save_table

ROWS_PER_BLOCK = 250_000
MOST_BLOCKS = 1_000  # the matrix holds at most MOST_BLOCKS x (MOST_BLOCKS + shards) counts


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` items taken without replacement from ``good`` + ``bad`` are good."""
    if good == 0 or drawn == 0:
        return 0
    if bad == 0:
        return drawn
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, drawn))
    # numpy ends at 1e9: search outwards from the mode, adding probabilities until they pass a uniform number
    low, high = max(0, drawn - bad), min(good, drawn)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    at_mode = math.exp(log_choose(good, mode) + log_choose(bad, drawn - mode) - log_choose(good + bad, drawn))
    u = rng.random() - at_mode
    up = down = at_mode
    i = j = mode
    while u > 0 and (i < high or j > low):
        if i < high:
            up *= (good - i) * (drawn - i) / ((i + 1) * (bad - drawn + i + 1))
            i += 1
            u -= up
            if u <= 0:
                return i
        if j > low:
            down *= j * (bad - drawn + j) / ((good - j + 1) * (drawn - j + 1))
            j -= 1
            u -= down
            if u <= 0:
                return j
    return mode


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> np.ndarray:
    """Counts with the given row and column sums, distributed as under a uniform permutation of all items."""
    if sum(rows) != sum(columns):
        raise ValueError("row and column sums differ")
    rng = np.random.default_rng(seed)
    left = list(columns)
    matrix = np.zeros((len(rows), len(columns)), dtype=np.int64)
    for p, drawn in enumerate(rows):
        rest = sum(left)
        for c, good in enumerate(left):
            if drawn == 0:
                break
            rest -= good
            taken = hypergeometric(rng, good, rest, drawn)
            matrix[p, c] = taken
            left[c] -= taken
            drawn -= taken
    return matrix


def exact_sizes(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def _position(rank: Column, starts: Column) -> Column:
    """0-based index of the last start at or below ``rank``."""
    return (F.size(F.filter(starts, lambda s: s <= rank)) - 1).cast("int")


def shuffle_to_shards(
    df: DataFrame,
    shards: int,
    seed: int = 0,
    rows_per_block: int = ROWS_PER_BLOCK,
    most_blocks: int = MOST_BLOCKS,
) -> DataFrame:
    """Every row of ``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in its shard).

    The assignment is a uniform permutation: partition-to-block counts are drawn exactly from the multivariate
    hypergeometric distribution, each partition is permuted and cut by its row of the matrix, and each block is permuted
    again after the exchange. A shard is a run of blocks of at most ``rows_per_block`` rows, so that no task sorts a whole
    shard; beyond ``most_blocks`` blocks they grow instead. Shard sizes differ by at most one.

    The rows are written once with a number of their own, so equal rows, equal or null keys and hot values are as
    spread as any others, and a lost executor repeats the same assignment. Columns named shard or slot are replaced.
    An empty table gives an empty result.
    """
    taken = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    columns = [F.col(f"`{c}`") for c in taken]
    numbered = save_table(df.select(*columns, F.monotonically_increasing_id().alias("__row")), "shards")
    total = numbered.count()
    per_shard = max(1, min(math.ceil(total / shards / rows_per_block), most_blocks // shards or 1))
    parts = max(1, min(math.ceil(total / rows_per_block), most_blocks))
    parts = max(parts, min(most_blocks, shards))

    numbered = numbered.withColumn("__part", F.pmod(F.xxhash64("__row", F.lit(seed)), F.lit(parts)).cast("int"))
    counts = dict(numbered.groupBy("__part").count().collect())  # at most most_blocks rows
    present = sorted(counts)
    blocks = [exact_sizes(n, per_shard) for n in exact_sizes(total, shards)]
    matrix = communication_matrix([counts[p] for p in present], [n for b in blocks for n in b], seed)

    schema = T.StructType(
        [
            T.StructField("__part", T.IntegerType()),
            T.StructField("__shard_starts", T.ArrayType(T.LongType())),
            T.StructField("__block_starts", T.ArrayType(T.ArrayType(T.LongType()))),
        ]
    )
    rows = []
    for p, line in zip(present, matrix, strict=True):
        starts = np.concatenate([[0], np.cumsum(line)[:-1]]).reshape(shards, per_shard)
        rows.append((p, starts[:, 0].tolist(), starts.tolist()))
    table = df.sparkSession.createDataFrame(rows, schema)
    offsets = F.array(*[F.array(*[F.lit(sum(b[:i])).cast("long") for i in range(per_shard)]) for b in blocks])

    first = Window.partitionBy("__part").orderBy(F.xxhash64("__row", F.lit(seed + 1)), "__row")
    second = Window.partitionBy("shard", "__block").orderBy(F.xxhash64("__row", F.lit(seed + 2)), "__row")
    return (
        numbered.withColumn("__rank", F.row_number().over(first).cast("long") - 1)
        .join(F.broadcast(table), "__part")  # at most most_blocks rows of about most_blocks numbers
        .withColumn("shard", _position(F.col("__rank"), F.col("__shard_starts")))
        .withColumn("__block", _position(F.col("__rank"), F.get("__block_starts", F.col("shard"))))
        .drop("__shard_starts", "__block_starts")
        .withColumn("__within", F.row_number().over(second).cast("long") - 1)
        .withColumn("slot", F.get(F.get(offsets, F.col("shard")), F.col("__block")) + F.col("__within"))
        .select(*columns, "shard", "slot")
    )


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document; null texts have no bytes."""
    data = full_text().cast("binary")
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(data) + 16).cast("long").alias("size"),
        F.crc32(data).cast("long").alias("text_crc32"),
    )
    return shuffle_to_shards(sized, shards, seed).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use for their own columns
        T.StructField("shard", T.StringType()),
        T.StructField("bucket", T.StringType()),
        T.StructField("set", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("item_id", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang) rows, with extra columns."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1]), *["x"] * 5) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions) if full else spark.createDataFrame([], SCHEMA)

    return make


def words(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "th", "on", "in", "st"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, repeated rows and ids, ties, ids at the ends of the range."""
    rng = random.Random(4)
    long = words(rng, 30_000)
    same = words(rng, 60)
    return [
        (None, None),
        (None, same),
        (None, ""),
        (1, ""),
        (2, None),
        (3, same),
        (4, same),
        (4, same),
        (5, "one"),
        (6, "one two"),
        (7, long),
        (8, long + " end"),
        (9, "\n\n  \t"),
        (9, "naïve É ß 中文 😀 é"),
        (10, same + " more words at the end of it"),
        (2**62, words(rng, 80)),
        (-5, words(rng, 80)),
        *[(100 + i, words(rng, rng.randrange(1, 200))) for i in range(40)],
    ]

"""Training corpus from ``documents``: good, distinct, unseen in the benchmark, without personal data, packed.

Each stage takes what the one before kept, written as Parquet. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sievelab.llm import decontaminate, pii, quality  # noqa: E402
from sievelab.llm.common import read_documents  # noqa: E402
from sievelab.llm.near_dedup import Spec, drop_near_duplicates  # noqa: E402
from sievelab.llm.packing import pack_documents  # noqa: E402
from sievelab.sources.scratch import save_table  # noqa: E402


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier fitted to ``labels`` scores 0.7 or more."""
    return quality.keep_good(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group alike in 80 % of its five-word shingles."""
    return drop_near_duplicates(docs, Spec(words=5))


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    return decontaminate.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def anonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1,024 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality", good),
    ("near_dedup", distinct),
    ("decontamination", unseen),
    ("personal_data", anonymous),
    ("packing", packed),
]

# These return what they have written themselves.
WRITTEN = {"quality", "decontamination"}

# No SQL has the classifier, the minhash tables or the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        if name not in WRITTEN:
            docs = save_table(docs, name)
    return STAGES[-1][1](spark, docs, sf_dir)

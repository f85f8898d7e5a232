"""Registered queries of this subpackage. Those without SQL are held against brute force by tests/llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelab.llm.common import read_documents
from sievelab.llm.decontaminate import find_leaks
from sievelab.llm.fingerprints import fingerprint_documents
from sievelab.llm.language import identify_languages
from sievelab.llm.merkle import verify_documents
from sievelab.llm.near_dedup import Spec, near_duplicates
from sievelab.llm.packing import pack_documents
from sievelab.llm.pieces import decode_pieces, encode_pieces
from sievelab.llm.pii import find_personal_data
from sievelab.llm.quality import document_quality
from sievelab.llm.secrets import scan_secrets
from sievelab.llm.sharding import shard_documents
from sievelab.llm.spelling import document_spelling
from sievelab.llm.sql import LLM_SQL
from sievelab.llm.token_files import token_file_digest

__all__ = ["LLM_QUERIES", "LLM_SQL"]


def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read_documents(spark, sf_dir))


def op3_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(read_documents(spark, sf_dir))


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_documents(spark, sf_dir))


def op5_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_documents(spark, sf_dir))


def op6_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_documents(spark, sf_dir), Spec(words=2))


def op7_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_quality(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_documents(spark, sf_dir))


def op9_patched_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(read_documents(spark, sf_dir))


def op10_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_documents(spark, sf_dir))


def op11_prefix_table_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    decoded = decode_pieces(encode_pieces(read_documents(spark, sf_dir), model), model)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify_documents(read_documents(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_spelling(read_documents(spark, sf_dir))


LLM_QUERIES = {
    "op1_benchmark_leaks": op1_benchmark_leaks,
    "op2_bottom_k_fingerprints": op2_bottom_k_fingerprints,
    "op3_weak_supervision_pii": op3_weak_supervision_pii,
    "op4_language_mixture": op4_language_mixture,
    "op5_retrieval_packing": op5_retrieval_packing,
    "op6_tensored_minhash": op6_tensored_minhash,
    "op7_attention_quality": op7_attention_quality,
    "op8_secret_scan": op8_secret_scan,
    "op9_patched_blocks": op9_patched_blocks,
    "op10_hypergeometric_shards": op10_hypergeometric_shards,
    "op11_prefix_table_pieces": op11_prefix_table_pieces,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_spelling_variants": op13_spelling_variants,
}

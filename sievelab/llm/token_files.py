"""Token ids in segments of patched frame-of-reference blocks.

A segment is one byte string that can be read alone (numbers are little-endian):

    "PFR1" | documents u32 | ids u64 | blocks u32 | packed words u64 | exceptions u64 | ids before it in its bucket u64
    document ids i64[documents], the least for null | ids per document u64[documents]
    block index, for each block: minimum u32 | first packed word u32 | exceptions before it u32 | width u8 | exceptions u8 | 0 u16
    packed words u32[] | exception places u8[] | exception differences u32[]

A block holds 128 ids as differences from its minimum, in the width that the chosen percentile of them needs; larger ones are
exceptions and hold zero in the packed part. Difference i is number i // 4 of lane i % 4; a lane's 32 differences lie bit by bit
in `width` words, and the words of the four lanes alternate. The last block is filled up with its minimum.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelab.llm.common import bucket_of, cut_points, full_text, id_key, small_batches, with_null_ids
from sievelab.llm.word_ids import encoder, forget_encoders
from sievelab.sources.scratch import scratch_path

BLOCK = 128
PERCENTILE = 90
HEAD = "<4sIQIQQQ"
HEAD_BYTES = struct.calcsize(HEAD)
SEGMENT_IDS = 1 << 20
ROWS_PER_BUCKET = 1_000
AT_ONCE = 4_096  # blocks packed or unpacked together


INDEX = [("low", "<u4"), ("first", "<u4"), ("patched", "<u4"), ("width", "u1"), ("number", "u1"), ("zero", "<u2")]


class Packed(NamedTuple):
    index: np.ndarray  # INDEX records
    words: np.ndarray
    places: np.ndarray
    outliers: np.ndarray


def _lanes(width: int) -> Iterator[tuple[int, int, int]]:
    """Number, word and shift of each of a lane's differences."""
    for i in range(BLOCK // 4):
        yield i, i * width // 32, i * width % 32


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> Packed:
    """Blocks of ``ids`` (below 2^32)."""
    parts: list[Packed] = []
    first = patched = 0
    rank = min(BLOCK - 1, max(0, int(np.ceil(BLOCK * percentile / 100)) - 1))
    for at in range(0, len(ids), BLOCK * AT_ONCE):
        part = ids[at : at + BLOCK * AT_ONCE].astype(np.uint32)
        if len(part) % BLOCK:
            tail = part[len(part) // BLOCK * BLOCK :]
            part = np.concatenate([part, np.full(BLOCK - len(tail), tail.min(), dtype=np.uint32)])
        blocks = part.reshape(-1, BLOCK)
        low = blocks.min(axis=1)
        diff = blocks - low[:, None]
        width = np.frexp(np.partition(diff, rank, axis=1)[:, rank].astype(float))[1].astype(np.int64)
        outlier = diff > ((np.int64(1) << width) - 1).astype(np.uint32)[:, None]
        number = outlier.sum(axis=1)
        outliers = diff[outlier]
        places = np.nonzero(outlier)[1].astype(np.uint8)
        diff[outlier] = 0
        size = 4 * width
        start = np.cumsum(size) - size
        words = np.zeros(int(size.sum()), dtype=np.uint32)
        for w in map(int, np.unique(width[width > 0])):
            rows = np.flatnonzero(width == w)
            lanes = np.ascontiguousarray(diff[rows].reshape(-1, BLOCK // 4, 4).transpose(1, 0, 2))
            out = np.zeros((w, len(rows), 4), dtype=np.uint32)
            for i, word, shift in _lanes(w):
                out[word] |= lanes[i] << np.uint32(shift)
                if shift + w > 32:
                    out[word + 1] |= lanes[i] >> np.uint32(32 - shift)
            words[start[rows][:, None] + np.arange(4 * w)] = out.transpose(1, 0, 2).reshape(len(rows), -1)
        index = np.zeros(len(blocks), dtype=INDEX)
        index["low"], index["width"], index["number"] = low, width, number
        index["first"], index["patched"] = start + first, np.cumsum(number) - number + patched
        first, patched = first + len(words), patched + len(outliers)
        parts.append(Packed(index, words, places, outliers))
    if not parts:
        return Packed(np.zeros(0, INDEX), np.zeros(0, np.uint32), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
    return Packed(*[np.concatenate(x) for x in zip(*parts, strict=True)])


def unpack_blocks(packed: Packed, ids: int) -> np.ndarray:
    """The first ``ids`` ids of the blocks in ``packed.index``, which may be a part of all."""
    out = np.zeros((len(packed.index), BLOCK), dtype=np.uint32)
    for at in range(0, len(packed.index), AT_ONCE):
        index = packed.index[at : at + AT_ONCE]
        width, number = index["width"].astype(np.int64), index["number"].astype(np.int64)
        first, patched = index["first"].astype(np.int64), index["patched"].astype(np.int64)
        diff = np.zeros((len(index), BLOCK), dtype=np.uint32)
        for w in map(int, np.unique(width[width > 0])):
            rows = np.flatnonzero(width == w)
            words = packed.words[first[rows][:, None] + np.arange(4 * w)]
            words = np.ascontiguousarray(words.reshape(-1, w, 4).transpose(1, 0, 2))
            lanes = np.empty((BLOCK // 4, len(rows), 4), dtype=np.uint32)
            mask = np.uint32((1 << w) - 1)
            for i, word, shift in _lanes(w):
                value = words[word] >> np.uint32(shift)
                if shift + w > 32:
                    value |= words[word + 1] << np.uint32(32 - shift)
                lanes[i] = value & mask
            diff[rows] = lanes.transpose(1, 0, 2).reshape(len(rows), -1)
        row = np.repeat(np.arange(len(index)), number)
        source = np.arange(len(row)) - np.repeat(np.cumsum(number) - number - patched, number)
        diff[row, packed.places[source]] = packed.outliers[source]
        out[at : at + AT_ONCE] = diff + index["low"][:, None]
    return out.reshape(-1)[:ids]


def write_segment(doc_ids: Sequence[int], texts: Sequence[np.ndarray], before: int) -> bytes:
    ids = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
    packed = pack_blocks(ids)
    parts = [
        struct.pack(HEAD, b"PFR1", len(doc_ids), len(ids), len(packed.index), len(packed.words), len(packed.outliers), before),
        np.array(doc_ids, dtype="<i8").tobytes(),
        np.array([len(t) for t in texts], dtype="<u8").tobytes(),
        packed.index.tobytes(),
        packed.words.astype("<u4").tobytes(),
        packed.places.tobytes(),
        packed.outliers.astype("<u4").tobytes(),
    ]
    return b"".join(parts)


def _blocks(raw: bytes) -> tuple[int, Packed]:
    """Number of ids and the blocks of a segment, as views of its bytes."""
    magic, docs, ids, blocks, words, outliers, _ = struct.unpack_from(HEAD, raw)
    if magic != b"PFR1":
        raise ValueError("not a segment")
    at = HEAD_BYTES + 16 * docs
    index = np.frombuffer(raw, np.dtype(INDEX), blocks, at)
    at += index.nbytes
    places = at + 4 * words
    return ids, Packed(
        index,
        np.frombuffer(raw, "<u4", words, at),
        np.frombuffer(raw, np.uint8, outliers, places),
        np.frombuffer(raw, "<u4", outliers, places + outliers),
    )


def read_segment(raw: bytes) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Document ids, ids per document, ids before the segment in its bucket, and all ids."""
    ids, packed = _blocks(raw)
    _, docs, _, _, _, _, before = struct.unpack_from(HEAD, raw)
    names = np.frombuffer(raw, "<i8", docs, HEAD_BYTES)
    counts = np.frombuffer(raw, "<u8", docs, HEAD_BYTES + 8 * docs).astype(np.int64)
    return names, counts, before, unpack_blocks(packed, ids)


def read_block(raw: bytes, block: int) -> np.ndarray:
    """One block's ids, found by the block index; the rest of the segment stays packed."""
    ids, packed = _blocks(raw)
    return unpack_blocks(packed._replace(index=packed.index[block : block + 1]), min(BLOCK, ids - BLOCK * block))


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str, keeps_space: bool, end_id: int, rows_per_bucket: int = ROWS_PER_BUCKET
) -> None:
    """Write the ids of every text, each followed by ``end_id``, in ascending doc_id order.

    Ranges of the id are buckets; one task holds a bucket in order and writes its segments, so ``bucket, segment`` is the
    order of the whole. Spark's writer commits the files, so a lost executor leaves no partial one. Null texts are
    empty, null ids come first and equal ids go by their text.
    """
    cuts = cut_points(docs, id_key(), rows_per_bucket) or [0]
    rows = docs.select(id_key(), full_text().alias("text"))
    dealt = rows.withColumn("bucket", bucket_of(F.col("doc_id"), cuts)).repartition("bucket")

    def segments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = encoder(vocabulary, keeps_space)
        end = np.array([end_id], dtype=words.dtype)
        bucket, number, before, size, names, held = None, 0, 0, 0, [], []

        def closed() -> pd.DataFrame:
            row = (bucket, number, size, len(names), write_segment(names, held, before))
            return pd.DataFrame([row], columns=["bucket", "segment", "n_ids", "n_documents", "data"])

        for frame in frames:
            found = words.encode(frame["text"].tolist())
            for b, d, ids in zip(frame["bucket"], frame["doc_id"], found, strict=True):
                if names and (b != bucket or size >= SEGMENT_IDS):
                    yield closed()
                    number, before, size, names, held = number + 1, before + size, 0, [], []
                if b != bucket:
                    bucket, number, before = b, 0, 0
                names.append(d)
                held.append(np.concatenate([ids, end]))
                size += len(ids) + 1
        if names:
            yield closed()

    schema = "bucket int, segment int, n_ids long, n_documents long, data binary"
    ordered = dealt.sortWithinPartitions("bucket", "doc_id", "text")
    with small_batches(docs.sparkSession):
        ordered.mapInPandas(segments, schema).write.option("compression", "none").parquet(path)


def read_token_files(df: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in segment rows; start counts all ids before it."""
    totals = df.groupBy("bucket").agg(F.sum("n_ids").alias("n")).collect()  # one row for each bucket, 10,000 at most
    offsets, total = [], 0
    for row in sorted(totals, key=lambda r: r["bucket"]):
        offsets.append((row["bucket"], total))
        total += row["n"]
    places = df.sparkSession.createDataFrame(offsets, "bucket int, ids_before long")

    def documents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_encoders()
        for frame in frames:
            for bucket, raw in zip(frame["bucket"], frame["data"], strict=True):
                names, counts, before, ids = read_segment(raw)
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[e - n : e].astype("<u4")) for e, n in zip(ends, counts, strict=True)]
                yield pd.DataFrame(
                    {
                        "bucket": bucket,
                        "doc_id": names,
                        "start": before + ends - counts,
                        "n_tokens": counts,
                        "ids_crc32": crc,
                    }
                )

    found = df.select("bucket", "data").mapInPandas(
        documents, "bucket int, doc_id long, start long, n_tokens long, ids_crc32 long"
    )
    return with_null_ids(found.join(F.broadcast(places), "bucket")).select(
        "doc_id", (F.col("ids_before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_file_digest(docs: DataFrame, end_id: int = 1) -> DataFrame:
    """Write all documents' ids to files in the shared folder and give what reading them back yields."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), False, end_id)
    return read_token_files(spark.read.parquet(path))

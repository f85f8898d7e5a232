"""Training sequences filled with lexically related texts, found by a BM25 index sharded by content."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelab.llm.common import bucket_of, cut_points, full_text, id_key, small_batches, with_null_ids
from sievelab.llm.word_ids import encoder, forget_encoders
from sievelab.sources.scratch import save_table

WINDOW = 1_024
INDEXED = 1_024  # texts in one shard's index
NEIGHBOURS = 32  # best unused neighbours tried whole before one is cut
K1, B = 1.2, 0.75
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "neighbour_score double"
)


class Terms(NamedTuple):
    """Distinct ids of a whole text, ascending, how often each occurs, and the text's length."""

    ids: np.ndarray
    tf: np.ndarray
    length: int


def terms_of(ids: np.ndarray) -> Terms:
    return Terms(*np.unique(ids, return_counts=True), len(ids))


class Stats(NamedTuple):
    """Number of texts, their mean length, and in how many of them each id occurs."""

    texts: int
    mean: float
    df: np.ndarray

    @property
    def idf(self) -> np.ndarray:
        """Terms in at least half of the texts weigh nothing."""
        return np.maximum(0.0, np.log((self.texts - self.df + 0.5) / (self.df + 0.5)))


def stats_of(texts: list[Terms]) -> Stats:
    df = np.bincount(np.concatenate([t.ids for t in texts]))
    return Stats(len(texts), float(np.mean([t.length for t in texts])), df)


class Index:
    """BM25 postings of a shard's texts; ids are the terms. ``stats`` are those of all texts, else of these."""

    def __init__(self, texts: list[np.ndarray | Terms], k1: float = K1, b: float = B, stats: Stats | None = None):
        self.size = n = len(texts)
        texts = [t if isinstance(t, Terms) else terms_of(t) for t in texts]
        stats = stats or stats_of(texts)
        lengths = np.array([t.length for t in texts], dtype=np.int64)
        terms = np.concatenate([t.ids for t in texts])
        order = np.argsort(terms, kind="stable")
        docs = np.repeat(np.arange(n), [len(t.ids) for t in texts])[order]
        terms, tf = terms[order], np.concatenate([t.tf for t in texts])[order].astype(np.int64)
        found, first, df = np.unique(terms, return_index=True, return_counts=True)
        idf = stats.idf[found]
        norm = k1 * (1 - b + b * lengths / max(1.0, stats.mean))
        weight = np.repeat(idf, df) * tf * (k1 + 1) / (tf + norm[docs])
        useful = np.repeat((idf > 0) & (df > 1), df)
        self.docs, self.weight = docs, weight
        # each text's postings lists, by text
        order = np.argsort(docs[useful], kind="stable")
        number = np.repeat(np.arange(len(df)), df)[useful][order]
        self.lists = np.split(number, np.searchsorted(docs[useful][order], np.arange(1, n)))
        self.first, self.df = first, df

    def scores(self, text: int) -> np.ndarray:
        """Every text's score for the terms of one of them."""
        lists = self.lists[text]
        if not len(lists):
            return np.zeros(self.size)
        length = self.df[lists]
        ends = np.cumsum(length)
        at = np.repeat(self.first[lists] - ends + length, length)
        at += np.arange(ends[-1])
        return np.bincount(self.docs[at], self.weight[at], self.size)

    def drop(self, gone: np.ndarray) -> None:
        """Postings of texts whose scores are not wanted any more; those of the others stay as they are."""
        keep = ~gone[self.docs]
        upto = np.r_[0, np.cumsum(keep)]
        self.first, self.df = upto[self.first], upto[self.first + self.df] - upto[self.first]
        self.docs, self.weight = self.docs[keep], self.weight[keep]


def fill_windows(
    texts: list[np.ndarray],
    window: int = WINDOW,
    neighbours: int = NEIGHBOURS,
    terms: list[Terms] | None = None,
    stats: Stats | None = None,
) -> Iterator[list[tuple]]:
    """Windows as lists of (text, start, length, score); every id of every text is in exactly one.

    ``texts`` are what is to be placed; they are compared by ``terms``, where given.

    The longest unused text is the seed. Its best unused neighbours go in whole where they fit, best first; if there is
    room left, the best one that did not fit is cut and its rest stays unused. Only the last window is not full.
    """
    if not texts:
        return
    index = Index(terms or texts, stats=stats)
    start = np.zeros(len(texts), dtype=np.int64)
    left = np.array([len(t) for t in texts], dtype=np.int64)
    posted = len(texts)  # how many texts the index still holds
    for seed in np.argsort(-left, kind="stable"):
        while left[seed]:
            room = window
            placed = [(seed, start[seed], min(room, left[seed]), None)]
            start[seed] += placed[0][2]
            left[seed] -= placed[0][2]
            room -= placed[0][2]
            if room:
                if (unused := np.count_nonzero(left)) < 0.75 * posted:
                    index.drop(left == 0)
                    posted = unused
                score = index.scores(seed)
            while room and left.any():
                open_ = np.flatnonzero(left)
                if len(open_) > neighbours:
                    open_ = open_[np.argpartition(-score[open_], neighbours)[:neighbours]]
                best = open_[np.argsort(-score[open_], kind="stable")]
                missed = None
                for other in best:
                    if left[other] <= room:
                        placed.append((other, start[other], left[other], score[other]))
                        room -= left[other]
                        start[other] += left[other]
                        left[other] = 0
                        if not room:
                            break
                    elif missed is None:
                        missed = other
                if room and missed is not None:
                    placed.append((missed, start[missed], room, score[missed]))
                    start[missed] += room
                    left[missed] -= room
                    room = 0
            yield placed


def corpus_stats(encoded: DataFrame, size: int, dtype: np.dtype) -> Stats:
    """Counted in tasks over all rows of ``encoded``; the driver holds a number for each of the vocabulary's ids."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_encoders()
        df = np.zeros(size, dtype=np.int64)
        for frame in frames:
            df += np.bincount(np.frombuffer(b"".join(frame["terms"]), dtype), minlength=size)
        found = np.flatnonzero(df)
        yield pd.DataFrame({"term": found, "df": df[found]})

    number, mean = encoded.agg(F.count("*"), F.avg("doc_tokens")).first()
    df = np.zeros(size, dtype=np.int64)
    for term, texts in encoded.select("terms").mapInPandas(count, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = texts
    return Stats(number, mean or 1.0, df)


class ContentKey:
    """A long for each text; texts that share much of their weight are likely to be near one another in its order.

    It joins the places of the text's first terms in ``DRAWS`` random orders of all terms, in which a term comes early with
    odds of its squared idf: two texts have the same first term with the probability of their weighted likeness. ``free`` low bits
    are left for a number that splits equal keys.
    """

    DRAWS = 3

    def __init__(self, stats: Stats, seed: int = 5):
        rng = np.random.default_rng(seed)
        size = len(stats.df)
        self.bits = size.bit_length()
        self.free = 63 - self.DRAWS * self.bits
        late = -np.log(rng.random((self.DRAWS, size))) / np.maximum(stats.idf**2, 1e-9)
        self.place = late.argsort(axis=1).argsort(axis=1)

    def __call__(self, terms: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Keys of texts whose distinct terms, none of them empty, begin at ``first``."""
        key = np.zeros(len(first), dtype=np.int64)
        for place in self.place:
            key = key << self.bits | np.minimum.reduceat(place[terms], first)
        return key << self.free


def pack_documents(
    docs: DataFrame,
    vocabulary: str | None = None,
    keeps_space: bool = True,
    end_id: int = 0,
    window: int = WINDOW,
    indexed: int = INDEXED,
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` ids.

    Whole windows of a long text are sequences of their own. What is left of each text is placed with its neighbours, which
    are found by the terms of whole texts, weighted by counts of the whole corpus. Texts are ordered by a key of their
    content and cut into shards of about ``indexed`` texts; seeds look up neighbours in their shard's index, so a
    neighbour that the order puts into another shard is not found. A key that many texts share is split by a hash of the
    id, and shards larger than twice that size are indexed in parts, so a shard that many equal rows fall into stays bounded.
    Null texts are empty and hold the end id alone. ``neighbour_score`` is null for seeds.
    """
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    words = encoder(vocabulary, keeps_space)
    dtype, size = words.dtype, max(words.tokenizer.get_vocab_size(), end_id + 1)
    rows = docs.select(id_key(), full_text().alias("text"))

    def tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = encoder(vocabulary, keeps_space)
        for frame in frames:
            out = []
            found = words.encode(frame["text"].tolist())
            for doc, ids in zip(frame["doc_id"], found, strict=True):
                ids = np.append(ids.astype("<u4"), np.uint32(end_id))
                whole = len(ids) // window * window
                crc = [zlib.crc32(ids[i : i + window]) for i in range(0, whole, window)]
                terms = terms_of(ids.astype(dtype))
                out.append((doc, len(ids), crc, terms.ids.tobytes(), terms.tf.astype("<u4").tobytes(), ids[whole:].astype(dtype).tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "doc_tokens", "crcs", "terms", "tf", "rest"])

    made = rows.mapInPandas(tokens, "doc_id long, doc_tokens long, crcs array<long>, terms binary, tf binary, rest binary")
    with small_batches(docs.sparkSession):
        encoded = save_table(made, "encoded")
    stats = corpus_stats(encoded, size, dtype)
    content = ContentKey(stats)

    @F.pandas_udf("long")
    def content_key(terms: pd.Series) -> pd.Series:
        length = terms.map(len).to_numpy(dtype=np.int64) // dtype.itemsize
        return pd.Series(content(np.frombuffer(b"".join(terms), dtype), np.cumsum(length) - length))

    key = content_key("terms").bitwiseOR(F.pmod(F.xxhash64("doc_id"), F.lit(1 << content.free)))
    keyed = encoded.withColumn("key", key)
    cuts = cut_points(keyed.select("key"), F.col("key"), indexed) or [0]
    keyed = keyed.withColumn("shard", bucket_of(F.col("key"), cuts).cast("long"))

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_encoders()
        names = [x.split()[0] for x in PIECES.split(", ")]
        shard, number, held = None, 0, []

        def fill() -> pd.DataFrame:
            nonlocal number
            out = []
            texts = [np.frombuffer(rest, dtype) for *_, rest in held]
            terms = [Terms(np.frombuffer(ids, dtype), np.frombuffer(tf, "<u4"), total) for _, total, ids, tf, _ in held]
            for placed in fill_windows(texts, window, terms=terms, stats=stats):
                offset = 0
                for at, start, length, score in placed:
                    doc, total, *_ = held[at]
                    crc = zlib.crc32(texts[at][start : start + length].astype("<u4"))
                    begin = total - len(texts[at]) + start
                    out.append((doc, begin, length, crc, total, (shard << 32) | number, offset, score))
                    offset += length
                number += 1
            return pd.DataFrame(out, columns=names).astype({"neighbour_score": "float64"})

        for frame in frames:
            out = []
            columns = [frame[c] for c in ("shard", "doc_id", "doc_tokens", "crcs", "terms", "tf", "rest")]
            for s, doc, total, crcs, terms, tf, rest in zip(*columns, strict=True):
                if held and (s != shard or len(held) >= 2 * indexed):
                    yield fill()
                    held = []
                if s != shard:
                    shard, number = int(s), 0
                for i, crc in enumerate(crcs):
                    out.append((doc, i * window, window, crc, total, (shard << 32) | number, 0, None))
                    number += 1
                if rest:
                    held.append((doc, int(total), terms, tf, rest))
            if out:
                yield pd.DataFrame(out, columns=names).astype({"neighbour_score": "float64"})
        if held:
            yield fill()

    ordered = keyed.repartition("shard").sortWithinPartitions("shard", "key", "doc_id", "doc_tokens", "rest")
    return with_null_ids(ordered.mapInPandas(packed, PIECES))

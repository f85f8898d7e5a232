"""Document quality by multiple-instance learning: passages, gated attention, one label for each document."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelab.llm.common import fold, frames_by_size, full_text, id_key, small_batches, text_groups, with_null_ids
from sievelab.sources.scratch import save_table

PASSAGE = 400  # characters
CLASSES = 8
HASHED = 64
WIDTH = CLASSES * CLASSES + HASHED + 6
GROUP_CHARS = 1 << 17
SAMPLE = 3_000  # labelled documents of each class that a model is fitted on
THRESHOLD = 0.7


class Model(NamedTuple):
    constant: float | None  # the score where nothing could be learned
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]


def char_classes() -> np.ndarray:
    """Lower case, upper case, other letter, digit, space, line break, sentence mark, other sign; by code below 65,536."""
    found = np.full(0x10000, 7, dtype=np.int64)
    for c in range(0x10000):
        s = chr(c)
        if s.isalpha():
            found[c] = 0 if s.islower() else 1 if s.isupper() else 2
        elif s.isdigit():
            found[c] = 3
        elif s in "\n\r\x0b\x0c\x85  ":
            found[c] = 5
        elif s.isspace():
            found[c] = 4
        elif s in ".,;:?'\"()-":
            found[c] = 6
    return found


def encode(texts: Sequence[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for every passage of every text, and how many passages each text has.

    Passages are consecutive windows of the whole text; an empty text has one empty passage. Features are frequencies of pairs
    of neighbouring character classes and of hashed letter pairs, word length, variety of words and of word pairs, words
    said twice in a row, and lengths.
    """
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    number = np.maximum(1, -(-lengths // PASSAGE))
    passages = int(number.sum())
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    text_start = np.cumsum(lengths) - lengths
    first = np.cumsum(number) - number
    inside = np.arange(len(code)) - np.repeat(text_start, lengths)
    of = np.repeat(first, lengths) + inside // PASSAGE
    out = np.zeros((passages, WIDTH))
    if not len(code):
        return out, number
    size = np.bincount(of, minlength=passages)
    kind = classes[np.minimum(code, 0xFFFF)]
    same = of[1:] == of[:-1]
    pair = (of[1:] * CLASSES + kind[:-1]) * CLASSES + kind[1:]
    pairs = np.bincount(pair[same], minlength=passages * CLASSES**2).reshape(passages, -1)
    out[:, : CLASSES**2] = pairs / np.maximum(1, size - 1)[:, None]
    letters = same & (kind[:-1] < 3) & (kind[1:] < 3)
    low = np.where((code >= 65) & (code <= 90), code + 32, code)
    hashed = (low[:-1] * 40503 + low[1:] * 2654435761) >> 7 & (HASHED - 1)
    grams = np.bincount((of[1:] * HASHED + hashed)[letters], minlength=passages * HASHED).reshape(passages, -1)
    out[:, CLASSES**2 : CLASSES**2 + HASHED] = grams / np.maximum(1, grams.sum(axis=1))[:, None]

    space = (kind == 4) | (kind == 5)
    begins = ~space & np.r_[True, space[:-1] | ~same]
    starts = np.flatnonzero(begins)
    rest = WIDTH - 6
    if len(starts):
        order = np.cumsum(begins) - 1
        place = np.arange(len(code)) - starts[np.maximum(order, 0)]
        value = np.where(space, 0, (low + 1) * (np.minimum(place, 62) * 2 + 3) * 0x9E3779B97F4A7C1 % (1 << 61))
        word = np.add.reduceat(value.astype(np.uint64), starts) & np.uint64((1 << 40) - 1)
        home = of[starts]
        words = np.bincount(home, minlength=passages)
        variety = lambda w, h: np.bincount(np.unique(w | h.astype(np.uint64) << np.uint64(40)) >> np.uint64(40), minlength=passages)
        many = np.maximum(1, words)
        two = (word[:-1] * np.uint64(31) + word[1:]) & np.uint64((1 << 40) - 1)
        beside = home[:-1] == home[1:]
        out[:, rest] = np.log1p((size - np.bincount(of[space], minlength=passages)) / many)
        out[:, rest + 1] = variety(word, home).astype(float) / many
        out[:, rest + 2] = variety(two[beside], home[:-1][beside]) / np.maximum(1, words - 1)
        again = beside & (word[1:] == word[:-1])
        out[:, rest + 3] = np.bincount(home[1:][again], minlength=passages) / many
        out[:, rest + 4] = np.log1p(words)
    out[:, rest + 5] = np.log1p(size)
    return out, number


def forward(x: np.ndarray, number: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Each bag's logit, with what the gradient needs."""
    starts = np.cumsum(number) - number
    h = np.tanh(x @ w["w"] + w["b"])
    t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
    e = (t * g) @ w["a"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), number))
    attention = e / np.repeat(np.add.reduceat(e, starts), number)
    z = np.add.reduceat(attention[:, None] * h, starts)
    return {"h": h, "t": t, "g": g, "attention": attention, "z": z, "logit": z @ w["c"] + w["d"][0], "starts": starts}


def gradient(x: np.ndarray, number: np.ndarray, label: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of the mean log loss of the bags."""
    f = forward(x, number, w)
    out = (1 / (1 + np.exp(-f["logit"])) - label) / len(label)
    dz = np.repeat(out[:, None] * w["c"], number, axis=0)
    da = (dz * f["h"]).sum(axis=1)
    mean = np.repeat(np.add.reduceat(f["attention"] * da, f["starts"]), number)
    de = f["attention"] * (da - mean)
    dt = de[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2)
    dg = de[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
    dh = (dz * f["attention"][:, None] + dt @ w["v"].T + dg @ w["u"].T) * (1 - f["h"] ** 2)
    return {
        "w": x.T @ dh,
        "b": dh.sum(axis=0),
        "v": f["h"].T @ dt,
        "u": f["h"].T @ dg,
        "a": ((f["t"] * f["g"]) * de[:, None]).sum(axis=0),
        "c": f["z"].T @ out,
        "d": np.array([out.sum()]),
    }


def fit(x: np.ndarray, number: np.ndarray, label: np.ndarray, hidden: int = 24, epochs: int = 25, seed: int = 3) -> Model:
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {"w": small(x.shape[1], hidden), "b": np.zeros(hidden), "v": small(hidden, hidden), "u": small(hidden, hidden)}
    w |= {"a": small(hidden), "c": small(hidden), "d": np.zeros(1)}
    first = np.cumsum(number) - number
    m = {k: np.zeros_like(v) for k, v in w.items()}
    s = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for epoch in range(epochs):
        for bags in np.array_split(rng.permutation(len(label)), max(1, len(label) // 64)):
            rows = np.concatenate([np.arange(first[i], first[i] + number[i]) for i in bags])
            step += 1
            rate = 0.004 * (1 - epoch / epochs)
            for k, g in gradient(x[rows], number[bags], label[bags], w).items():
                g = g + 1e-4 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return Model(None, mean, scale, w)


def scores(texts: Sequence[str], model: Model, classes: np.ndarray) -> np.ndarray:
    if model.constant is not None or not len(texts):
        return np.full(len(texts), model.constant if model.constant is not None else 0.0)
    x, number = encode(texts, classes)
    logit = forward(np.clip((x - model.mean) / model.scale, -8, 8), number, model.weights)["logit"]
    return 1 / (1 + np.exp(-logit))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit to a bounded sample of the labelled documents outside fold 2 of 4: the ``sample`` of each class whose ids hash lowest.

    A document with several labels counts as the lowest; null labels and ids are left out. Classes are weighted back to
    their shares by the prior. Where one class has no document, every score is the smoothed share of label 1; without
    labels it is 1, so nothing is rejected.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").dropna().where(fold(4) != 2)
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality IN (0, 1)")
    counts = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    chosen = [
        usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample) for q in (0, 1)
    ]
    chosen = chosen[0].union(chosen[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), full_text().alias("text"))
    picked = texts.join(F.broadcast(chosen), "doc_id")  # 2 x sample rows at most

    def bags(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = char_classes()
        for frame in frames_by_size(frames, "text", GROUP_CHARS):
            x, number = encode(frame["text"].tolist(), classes)
            ends = np.cumsum(number)
            raw = [x[e - n : e].astype("<f4").tobytes() for e, n in zip(ends, number, strict=True)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "quality": frame["quality"], "bag": raw})

    with small_batches(docs.sparkSession):
        found = picked.mapInPandas(bags, "doc_id long, quality int, bag binary").collect()
    found = sorted(found, key=lambda r: (r["doc_id"], bytes(r["bag"])))
    label = np.array([r["quality"] for r in found], dtype=float)
    if len(set(label)) < 2:
        n = sum(counts.values())
        return Model((counts.get(1, 0) + 1) / (n + 1), np.zeros(0), np.zeros(0), {})
    x = [np.frombuffer(r["bag"], "<f4").reshape(-1, WIDTH) for r in found]
    model = fit(np.concatenate(x).astype(float), np.array([len(b) for b in x]), label)
    # the sample has other shares of the classes than the labels
    prior = np.log((counts[1] / counts[0]) / (label.sum() / (len(label) - label.sum())))
    model.weights["d"] = model.weights["d"] + prior
    return model


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out (fold 2 of 4), score and predicted of every text; null texts are empty."""

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = char_classes()
        for frame in frames_by_size(frames, "text", GROUP_CHARS):
            score = scores(frame["text"].tolist(), model, classes)
            out = frame[["doc_id", "held_out"]].assign(score=score)
            yield out.assign(predicted=(score >= threshold).astype("int32"))

    texts = docs.select(id_key(), (fold(4) == 2).alias("held_out"), full_text().alias("text"))
    return with_null_ids(texts.mapInPandas(predict, "doc_id long, held_out boolean, score double, predicted int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, as they were; written, in batches of few rows."""

    @F.pandas_udf("boolean")
    def good(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        classes = char_classes()
        for part in texts:
            found = [scores(part[r.start : r.stop].tolist(), model, classes) for r in text_groups(part.tolist(), GROUP_CHARS)]
            yield pd.Series(np.concatenate([*found, np.zeros(0)]) >= threshold)

    with small_batches(docs.sparkSession):
        return save_table(docs.where(good(full_text())), "good")


def document_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, learn(docs, labels))

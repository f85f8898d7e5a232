"""Language proportions of documents by mixtures of n-gram models."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelab.llm.common import fold, full_text, id_key, with_null_ids

BUCKETS = 1 << 15
SLICE = 1 << 20  # characters of one text counted at once
MOST_LANGUAGES = 500  # bound of the model: languages x buckets numbers
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    log_p: np.ndarray  # language x bucket


def letters() -> np.ndarray:
    """For each code below 65,536, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def gram_counts(text: str, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the text's 1- to 3-grams and how often each occurs; whatever is no letter counts as a space."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, max(len(text), 1), SLICE):
        part = f" {text[max(0, at - 2) : at + SLICE].lower()} "
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
        kept = (code >= 0x10000) | letter[np.minimum(code, 0xFFFF)]
        code = np.where(kept, code, 32).astype(np.uint64)
        one = code * np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] ^ code[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
        three = (two[:-1] ^ code[2:]) * np.uint64(0x165667B19E3779F9)
        for hashed, some in ((one, kept), (two, kept[:-1] | kept[1:]), (three, kept[1:-1])):
            total += np.bincount((hashed[some] >> np.uint64(49)).astype(np.int64), minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found, total[found]


def learn(docs: DataFrame, smoothing: float = 0.05) -> Model:
    """One n-gram model for each language of ``docs`` (text, lang), counted over all of them.

    Each task adds up its own counts; their sums, languages x buckets at most, go to the driver.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letter, sums = letters(), {}
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                found, number = gram_counts(text, letter)
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS, dtype=np.int64)
                sums[lang][found] += number
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at]})

    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    names = [r[0] for r in labelled.select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    sums = labelled.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.full((len(names), BUCKETS), smoothing)
    for row in sums.toLocalIterator():
        table[names.index(row["lang"]), row["bucket"]] += row["n"]
    return Model(names, np.log(table / table.sum(axis=1, keepdims=True)))


def mixture(counts: np.ndarray, log_p: np.ndarray, rounds: int = 20) -> dict[int, float]:
    """Languages of a text and their shares, from the counts of its n-grams and each language's log-probabilities of them.

    The set starts with the likeliest language. The one whose small share would raise the likelihood most is tried; the
    shares are fitted by expectation-maximisation, and it stays if the gain in log-likelihood exceeds the penalty for one
    more share (Bayesian information criterion; each character is in three n-grams, so the gain counts a third).
    """
    if not len(counts):
        return {}
    p = np.exp(log_p - log_p.max(axis=0))
    total = counts.sum()
    penalty = 0.5 * np.log(total / 3 + 1) + np.log(len(log_p))
    chosen = [int((log_p @ counts).argmax())]
    share = np.ones(1)
    mixed = np.maximum(p[chosen[0]], 1e-300)
    while len(chosen) < len(log_p):
        slope = (p / mixed) @ counts / total
        slope[chosen] = 0
        new = int(slope.argmax())
        if slope[new] <= 1:
            break
        tried, weight = [*chosen, new], np.append(share * 0.8, 0.2)
        sub = p[tried]
        for _ in range(rounds):
            both = np.maximum(weight @ sub, 1e-300)
            weight = weight * (sub @ (counts / both)) / total
        both = np.maximum(weight @ sub, 1e-300)
        if (counts * np.log(both / mixed)).sum() / 3 <= penalty:
            break
        chosen, share, mixed = tried, weight, both
    return dict(zip(chosen, share, strict=True))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the mixture of each text; score is the share of the main language.

    Without a letter, or without any learned language, the language is ``und`` and the score 0.
    """
    languages, log_p = model

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letter = letters()
        for frame in frames:
            rows = []
            for text in frame["text"]:
                shares = {}
                if languages and LETTER.search(text):
                    found, number = gram_counts(text, letter)
                    shares = mixture(number, log_p[:, found])
                if not shares:
                    rows.append((UNKNOWN, 0.0, ""))
                    continue
                order = sorted(shares, key=lambda k: (-shares[k], languages[k]))
                text_form = ",".join(f"{languages[k]}:{shares[k]:.4f}" for k in order)
                rows.append((languages[order[0]], float(min(1.0, shares[order[0]])), text_form))
            out = pd.DataFrame(rows, columns=["lang_pred", "score", "mixture"])
            out.insert(0, "doc_id", frame["doc_id"])
            out.insert(1, "held_out", frame["held_out"])
            yield out

    texts = docs.select(id_key(), (fold(5) == 0).alias("held_out"), full_text().alias("text"))
    schema = "doc_id long, held_out boolean, lang_pred string, score double, mixture string"
    return with_null_ids(texts.mapInPandas(predict, schema))


def identify_languages(docs: DataFrame) -> DataFrame:
    """Learn from the folds 1 to 4 of ``docs`` and predict all of it; rows with a null id are held out."""
    return identify(docs, learn(docs.where(fold(5) != 0)))

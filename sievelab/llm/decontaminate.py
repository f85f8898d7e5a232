"""Benchmark passages in documents, found within an edit budget by exact pieces and bit-parallel distances."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelab.llm.common import full_text, id_key, small_batches, with_null_ids
from sievelab.sources.scratch import save_table

ERROR_RATE = 0.08  # edits allowed for each character of an item
MIN_CHARS = 20  # normalised items below this must be whole words of a document, without edits
UNSPACED = "\u2e80"  # scripts from here on are mostly written without spaces
BLOCK_CHARS = 1_000_000  # benchmark text searched in one pass over the documents

WORD = re.compile(r"[^\W_]+")
GAP = re.compile(r"[\W_]+")
LEAKS = "doc_id long, item_id long, distance int, budget int, item_chars int, start long, end long"


class Item(NamedTuple):
    item_id: int | None
    text: str
    budget: int
    whole: bool = False  # found between word boundaries only


class Match(NamedTuple):
    distance: int
    start: int
    end: int


def normalise(text: str) -> str:
    """Lower case, with one space between words of letters and digits."""
    return GAP.sub(" ", text.lower()).strip()


def pieces(text: str, budget: int) -> list[tuple[int, str]]:
    """``budget`` + 1 pieces of nearly equal length with their places; that many edits leave one of them whole."""
    cuts = [len(text) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << i
    return found


def least_distance(pattern: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of ``text``, and the first end that has it (Myers)."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    up, down, score = full, 0, length
    best, end = length, 0
    get = pattern.get
    for j, c in enumerate(text, 1):
        same = get(c, 0)
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        plus = down | (full & ~(horizontal | up))
        minus = up & horizontal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best:
                best, end = score, j
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = minus | (full & ~(vertical | plus))
        down = plus & vertical
    return best, end


def inside_word(text: str, at: int) -> bool:
    """Whether a word of a spaced script goes on across this place."""
    return 0 < at < len(text) and all(c != " " and c < UNSPACED for c in text[at - 1 : at + 1])


class Searcher:
    """Searches a block of items in normalised texts."""

    def __init__(self, items: list[Item]):
        self.items = items
        self.masks = [masks(x.text) for x in items]
        self.reverse = [masks(x.text[::-1]) for x in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for i, item in enumerate(items):
            for at, piece in pieces(item.text, item.budget):
                places.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def matches(self, text: str) -> dict[int, Match]:
        """The closest match of each item (by its place in the block) within its budget; of equals the first."""
        starts: dict[int, set[int]] = {}
        if self.empty or not text:
            return {}
        for end, (length, where) in self.automaton.iter(text):
            for i, at in where:
                starts.setdefault(i, set()).add(end + 1 - length - at)
        found = {}
        for i, diagonals in starts.items():
            if match := self._verified(i, sorted(diagonals), text):
                found[i] = match
        return found

    def _verified(self, i: int, diagonals: list[int], text: str) -> Match | None:
        _, pattern, budget, whole = self.items[i]
        for d in diagonals:
            if whole and (inside_word(text, d) or inside_word(text, d + len(pattern))):
                continue
            if d >= 0 and text.startswith(pattern, d):
                return Match(0, d, d + len(pattern))
        if whole:
            return None
        best: Match | None = None
        first = 0
        for k, d in enumerate(diagonals):
            if k + 1 < len(diagonals) and diagonals[k + 1] - d <= budget:
                continue  # one window for neighbouring diagonals
            low = max(0, diagonals[first] - budget)
            window = text[low : d + len(pattern) + budget]
            first = k + 1
            distance, end = least_distance(self.masks[i], len(pattern), window)
            if distance <= budget and (best is None or distance < best.distance):
                back, length = least_distance(self.reverse[i], len(pattern), window[:end][::-1])
                best = Match(distance, low + end - length, low + end)
        return best


def original_span(text: str, start: int, end: int) -> tuple[int, int]:
    """Code points of ``text`` from the first to the last word that a span of its normalised form touches."""
    at, low, high = 0, None, 0
    for word in WORD.finditer(text):
        length = len(word[0].lower())
        if at < end and at + length > start:
            low = word.start() if low is None else low
            high = word.end()
        at += length + 1
        if at >= end:
            break
    return (0 if low is None else low), high


def benchmark_blocks(
    benchmark: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS
) -> Iterator[list[Item]]:
    """The items in blocks of about ``block_chars`` characters, one at a time on the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull())
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).distinct().collect()
        texts = sorted({(r["item_id"] is not None, r["item_id"] or 0, normalise(r["text"])) for r in rows})
        yield [
            Item(i if known else None, t, 0 if len(t) < min_chars else int(len(t) * error_rate), len(t) < min_chars)
            for known, i, t in texts
            if t
        ]


def find_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Every pair of a document and a benchmark item it contains within the item's edit budget.

    Both texts are compared in lower case with one space between words. An item of m characters has a budget of
    ``error_rate`` x m edits; it is cut into budget + 1 pieces, an exact hit of any piece gives a window, and the window's
    distance is computed bit by bit. So no occurrence within the budget is missed. ``start`` and ``end`` are code points of the
    original text, from the first to the last word touched. Items below ``min_chars`` have no budget and must begin and end
    with words of the document; where a script has no spaces between words, they may lie anywhere. Texts and items that are
    null or have no letter or digit match nothing. A repeated document gives its rows again, an item id with several
    texts its closest one.
    """

    def search(items: list[Item]) -> DataFrame:
        def leaks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            searcher = Searcher(items)
            for frame in frames:
                rows = []
                for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                    closest: dict[int | None, tuple] = {}
                    for i, match in searcher.matches(normalise(text)).items():
                        item = items[i]
                        row = (match.distance, item.budget, len(item.text), match.start, match.end)
                        closest[item.item_id] = min(closest.get(item.item_id, row), row)
                    for item_id, (distance, budget, chars, start, end) in closest.items():
                        span = original_span(text, start, end)
                        rows.append((doc, item_id, distance, budget, chars, *span))
                names = [x.split()[0] for x in LEAKS.split(", ")]
                yield pd.DataFrame(rows, columns=names).astype({"item_id": "Int64"})

        texts = docs.select(id_key(), "text").filter(F.col("text").isNotNull())
        return with_null_ids(texts.mapInPandas(leaks, LEAKS))

    parts = [search(items) for items in benchmark_blocks(benchmark, **options)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    if len(parts) == 1:
        return found
    # an id's texts may lie in several blocks
    best = F.min(F.struct("distance", "budget", "item_chars", "start", "end")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def is_clean(items: list[Item]):
    @F.pandas_udf("boolean")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        searcher = Searcher(items)
        for part in texts:
            yield pd.Series([not searcher.matches(normalise(x)) for x in part], dtype=bool)

    return clean(full_text())


def drop_leaked(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any benchmark item, as they were; rows with a null text stay. Written, in batches of few rows."""
    for items in benchmark_blocks(benchmark, **options):
        docs = docs.where(is_clean(items))
    with small_batches(docs.sparkSession):
        return save_table(docs, "clean")

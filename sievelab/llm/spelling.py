"""Spelling variants of a corpus: words that differ by one character, found by walking a relational trie.

The words' prefixes are the trie's nodes, and its edges a table (depth, node, symbol, child). Every word walks down from the root:
with no edit it stands on its own prefixes; at each of them one edit leads to states (word, position, node, edits = 1), which
from then on must follow the edges of the word's own characters. All states of a depth are joined with the edges of that depth at
once; states that used up their word on a node that is a word are its neighbours.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelab.llm.common import full_text
from sievelab.operators.joins import MAX_BROADCAST_ROWS
from sievelab.sources.scratch import save_table

LETTERS = "[A-Za-zÀ-ÿ]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SLIPS = 199  # one in so many occurrences loses a character
MIN_LETTERS = 6
MIN_COUNT = 5
RATIO = 5  # so many times as frequent is a variant's form
DEEPEST = 48  # longer words are compared by what is left without one character; a trie of that depth takes as many joins
LEVELS_AT_ONCE = 4  # levels between two written tables
SPREAD = 100_000  # words through one node that one task takes
PRIME = 2**61 - 1


def corpus_words(docs: DataFrame, slips: int = SLIPS, letters: int = MIN_LETTERS, count: int = MIN_COUNT) -> DataFrame:
    """word and n of the runs of letters in all texts, A-Z lower-cased, of at least ``letters`` characters and ``count`` occurrences.

    Where ``slips`` divides the crc32 of ``<doc_id>:<run>`` a run has lost one character. A null doc_id reads as empty there, null
    texts have no words, repeated rows count again.
    """
    runs = F.regexp_extract_all(full_text(), F.lit(f"{LETTERS}{{{letters},}}"), F.lit(0))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    each = docs.select(name.alias("name"), F.explode(runs).alias("run"))
    run = F.translate("run", CAPITALS, CAPITALS.lower())
    each = each.select(run.alias("run"), F.crc32(F.concat_ws(":", "name", run).cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % slips == 0, slipped).otherwise(F.col("run"))
    words = each.select(word.alias("word")).where(F.length("word") >= letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def symbol(word: str, at: Column) -> Column:
    """Character ``at`` (from 0) of a word, empty behind its end."""
    return F.substring(word, at + 1, F.lit(1))


class Trie:
    """The edges of the trie of ``words`` (word, size), at most ``deepest`` characters each."""

    def __init__(self, words: DataFrame, deepest: int = DEEPEST, max_rows: int = MAX_BROADCAST_ROWS, spread: int = SPREAD):
        self.words, self.max_rows, self.spread = words.where(F.col("size") <= deepest), max_rows, spread
        steps = self.words.select("word", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("depth"))
        depth = F.col("depth")
        edges = steps.select(
            depth,
            F.substring("word", F.lit(1), depth).alias("node"),
            symbol("word", depth).alias("symbol"),
            F.substring("word", F.lit(1), depth + 1).alias("child"),
            (F.col("size") == depth + 1).alias("ends"),
        )
        edges = edges.groupBy("depth", "node", "symbol", "child").agg(F.max("ends").alias("ends"), F.count("*").alias("through"))
        self.edges = save_table(edges, "edges")
        found = self.edges.groupBy("depth").agg(F.count("*").alias("edges"), F.max("through").alias("through")).collect()
        self.sizes = {r["depth"]: (r["edges"], r["through"]) for r in found}  # one row for each depth, ``deepest`` at most

    @property
    def depth(self) -> int:
        """The length of the longest word."""
        return len(self.sizes)

    def _meet(self, states: DataFrame, depth: int, on: list[str], how: str) -> DataFrame:
        """``states`` (node, ...) joined with the edges of a depth; nodes that very many words pass are spread over tasks."""
        edges = self.edges.where(F.col("depth") == depth).select("node", "symbol", "child", "ends")
        number, through = self.sizes.get(depth, (0, 0))
        if number <= self.max_rows:
            return states.join(F.broadcast(edges), on, how)
        if through <= self.spread:
            return states.join(edges, on, how)
        of_depth = self.edges.where(F.col("depth") == depth).groupBy("node").agg(F.sum("through").alias("through"))
        tasks = F.ceil(F.col("through") / self.spread).cast("int").alias("tasks")
        busy = save_table(of_depth.where(F.col("through") > self.spread).select("node", tasks), "busy-nodes")
        copies = edges.join(busy, "node", "left").withColumn("task", F.explode(F.sequence(F.lit(0), F.coalesce("tasks", F.lit(1)) - 1)))
        dealt = states.join(busy, "node", "left").withColumn("task", F.pmod(F.xxhash64("word"), F.coalesce("tasks", F.lit(1))).cast("int"))
        return dealt.drop("tasks").join(copies.drop("tasks"), [*on, "task"], how).drop("task")

    def _edited(self, depth: int) -> DataFrame:
        """States of ``depth + 1`` that a word reaches from its own prefix by putting another character for its next, or one more in."""
        own = self.words.where(F.col("size") >= depth).select("word", "size", F.substring("word", F.lit(1), F.lit(depth)).alias("node"))
        met = self._meet(own, depth, ["node"], "inner").where(F.col("symbol") != symbol("word", F.lit(depth)))
        both = F.array(F.when(F.col("size") > depth, F.lit(depth + 1)), F.lit(depth))
        states = met.withColumn("position", F.explode(F.array_compact(both)))
        return states.where((F.col("position") < F.col("size")) | F.col("ends")).select("word", "size", "position", F.col("child").alias("node"))

    def _skipped(self, depth: int) -> DataFrame:
        """States of ``depth`` that a word reaches by leaving out its next character; of equal neighbours the first."""
        own = self.words.where(F.col("size") > depth)
        if depth:
            own = own.where(symbol("word", F.lit(depth)) != symbol("word", F.lit(depth - 1)))
        return own.select("word", "size", F.lit(depth + 1).alias("position"), F.substring("word", F.lit(1), F.lit(depth)).alias("node"))

    def _followed(self, states: DataFrame, depth: int) -> DataFrame:
        """The states one edge further along their words; those at their word's end stay."""
        wanted = states.withColumn("symbol", F.when(F.col("position") < F.col("size"), symbol("word", F.col("position"))))
        met = self._meet(wanted, depth, ["node", "symbol"], "left")
        done = F.col("position") == F.col("size")
        further = F.col("child").isNotNull() & ((F.col("position") + 1 < F.col("size")) | F.col("ends"))
        position = F.when(done, F.col("position")).otherwise(F.col("position") + 1)
        return met.where(done | further).select("word", "size", position.alias("position"), F.when(done, F.col("node")).otherwise(F.col("child")).alias("node"))

    def neighbours(self) -> DataFrame:
        """word and near of all pairs of words one inserted, deleted or replaced character apart, from both sides."""
        states = None
        for depth in range(self.depth + 1):
            here = self._skipped(depth)
            here = here if states is None else states.unionByName(here)
            states = self._followed(here, depth).unionByName(self._edited(depth))
            if depth % LEVELS_AT_ONCE == LEVELS_AT_ONCE - 1:
                states = save_table(states, f"states-{depth}")
        if states is None:
            return self.words.select("word", F.col("word").alias("near")).limit(0)
        done = states.where("position = size").select("word", F.col("node").alias("near")).distinct()
        return done.join(self.words.select(F.col("word").alias("near")), "near", "left_semi").select("word", "near")


def lost_forms(frames: Iterator[pd.DataFrame], seed: int = 11) -> Iterator[pd.DataFrame]:
    """For words (id, word): a hash of the whole word (place -1) and of what is left without each of its characters.

    Hashes come from hashes of prefixes, so a word costs its length and not its square; ``first`` marks the first of equal neighbours.
    """
    base = random.Random(seed).randrange(1 << 32, PRIME)
    for frame in frames:
        for number, word in zip(frame["id"], frame["word"], strict=True):
            size = len(word)
            upto, power = [0], [1]
            for char in word:
                upto.append((upto[-1] * base + ord(char)) % PRIME)
                power.append(power[-1] * base % PRIME)
            whole = upto[size]
            left = [
                (upto[i] * power[size - 1 - i] + whole - upto[i + 1] * power[size - 1 - i]) % PRIME for i in range(size)
            ]
            first = [True, *[a != b for a, b in zip(word, word[1:], strict=False)]]
            yield pd.DataFrame(
                {"id": number, "length": [size, *[size - 1] * size], "hash": [whole, *left], "place": range(-1, size), "first": [False, *first]}
            )


def long_neighbours(words: DataFrame, shortest: int) -> DataFrame:
    """The same pairs among ``words`` (word, size) of at least ``shortest`` characters, one of them longer than that.

    Words meet in what is left of them without one character, which at most an alphabet of words shares at one place, and are then
    compared as they are.
    """
    held = save_table(words.where(F.col("size") >= shortest).select("word", "size", F.monotonically_increasing_id().alias("id")), "long-words")
    forms = save_table(held.select("id", "word").mapInPandas(lost_forms, "id long, length int, hash long, place int, first boolean"), "forms")
    lost = forms.where("place >= 0").select(F.col("id").alias("a"), "length", "hash", "place", "first")
    other = lost.select(F.col("a").alias("b"), "length", "hash", "place")
    replaced = lost.join(other, ["length", "hash", "place"]).where("a <> b").select("a", "b", "place", F.lit(True).alias("both"))
    whole = forms.where("place < 0").select(F.col("id").alias("b"), "length", "hash")
    shorter = lost.where("first").join(whole, ["length", "hash"]).select("a", "b", "place", F.lit(False).alias("both"))
    of = lambda end: held.select(F.col("id").alias(end), F.col("word").alias(f"word_{end}"), F.col("size").alias(f"size_{end}"))
    pairs = replaced.union(shorter).join(of("a"), "a").join(of("b"), "b").where((F.col("size_a") > shortest) | (F.col("size_b") > shortest))
    without = lambda w: F.concat(F.substring(w, F.lit(1), F.col("place")), F.substring(w, F.col("place") + 2, F.length(w)))
    same = without("word_a") == F.when(F.col("both"), without("word_b")).otherwise(F.col("word_b"))
    pairs = pairs.where(same).select("word_a", "word_b", "both")
    from_a = pairs.select(F.col("word_a").alias("word"), F.col("word_b").alias("near"))
    from_b = pairs.where("NOT both").select(F.col("word_b").alias("word"), F.col("word_a").alias("near"))
    return from_a.union(from_b).distinct()


def near_words(words: DataFrame, deepest: int = DEEPEST, **options) -> DataFrame:
    """word and near of all pairs in ``words`` (distinct words) that are one character apart, from both sides."""
    words = save_table(words.select("word", F.length("word").alias("size")), "words")
    found = Trie(words, deepest, **options).neighbours()
    if words.where(F.col("size") > deepest).isEmpty():
        return found
    return found.union(long_neighbours(words, deepest))


def roots_of(forms: DataFrame, links: int) -> DataFrame:
    """word and root: the last word from each ``word`` along ``form``, for chains of at most ``links`` links."""
    found = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1, links)))):
        # each round doubles the links that a row has followed
        found = save_table(found, "roots")
        further = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        found = found.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return found


def spelling_variants(words: DataFrame, ratio: int = RATIO, deepest: int = DEEPEST, **options) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of ``words`` (distinct word, n; n at least 1, ``ratio`` at least 2).

    A word's form is its most frequent near word (ties: the first in code-point order) if that is ``ratio`` times as frequent; its root is the
    last word along forms, itself without one. An empty table has no rows; other columns are ignored; no words are left out.
    """
    words = save_table(words.select("word", F.col("n").cast("long").alias("n")), "counted")
    near = near_words(words, deepest, **options).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(best, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    found = found.select(
        "word",
        F.when(enough, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    found = save_table(found, "variants")
    most = words.agg(F.max("n")).first()[0] or 1
    roots = roots_of(found.where("form IS NOT NULL"), math.ceil(math.log(most, ratio)) + 1)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_spelling(docs: DataFrame) -> DataFrame:
    """The variants among all words of ``docs``."""
    return spelling_variants(corpus_words(docs))

"""Near-duplicate documents by tensored MinHash tables, confirmed on whole shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelab.llm.common import full_text, small_batches
from sievelab.llm.components import connected_components
from sievelab.operators.joins import broadcast_small
from sievelab.sources.scratch import save_table

SHINGLES_AT_ONCE = 1 << 17
GUESTS = 256  # sets compared with one another in one part of a room
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Spec(NamedTuple):
    """Two collections of ``groups`` groups of ``rows`` minhashes; every pair of groups is a table.

    2 x groups x rows minhashes so serve groups^2 tables. Documents of likeness s meet in a table unless one collection
    misses: recall (1 - (1 - s^rows)^groups)^2, at the defaults 0.9994 for 0.8 and above 0.99999 for 0.9.
    """

    words: int = 5
    likeness_pct: int = 80
    groups: int = 8
    rows: int = 2
    bins: int = 64  # more minima, of one permutation cut into bins, that only estimate likeness
    deviations: float = 4.0  # a partner whose estimate is so far below the limit is not tried first; it loses no link
    missed: float = 1e-9  # a link is passed over in the last round if its minima agree as rarely as only this share of links do
    block: int = 2_048  # documents of one table key compared in one task
    broadcast_rows: int = 200_000
    seed: int = 7

    @property
    def hashes(self) -> int:
        return 2 * self.groups * self.rows


def word_list(text: Column) -> Column:
    lower = F.translate(text, CAPITALS, CAPITALS.lower())
    return F.filter(F.split(lower, r"[ \x09-\x0D]+"), lambda w: w != "")


def shingle_set(words: Column, size: int) -> Column:
    """Distinct 64-bit hashes of the word shingles; fewer words are one shingle, no words none. ``words`` must be a column."""
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)]))
    short = F.array(F.xxhash64(words, F.lit(size)))
    none = F.array().cast("array<bigint>")
    return F.when(n >= size, F.array_distinct(each)).when(n > 0, short).otherwise(none)


def with_set(df: DataFrame, size: int) -> DataFrame:
    """``df`` with its ``text`` replaced by the shingle ``set``."""
    words = df.withColumn("__words", word_list(F.col("text"))).drop("text")
    return words.withColumn("set", shingle_set(F.col("__words"), size)).drop("__words")


def mix(x: np.ndarray, by: int) -> np.ndarray:
    x = (x ^ np.uint64(by)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def signatures(sets: DataFrame, spec: Spec) -> DataFrame:
    """doc_id, text_hash, n, two digests of the set, its minhashes (32 bits each) and its ``mini``.

    ``mini`` has a byte for every minhash and for every bin of one more permutation; 0 is an empty bin.
    """
    rng = np.random.default_rng(spec.seed)
    factors = rng.integers(0, 2**63, spec.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 2**63, spec.hashes, dtype=np.uint64)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slices of about SHINGLES_AT_ONCE shingles, as several numbers are made of each."""
        for batch in batches:
            offsets, start = batch.column("set").offsets.to_numpy(), 0
            while start < len(batch):
                stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SHINGLES_AT_ONCE, "right")) - 1)
                yield batch.slice(start, stop - start)
                start = stop

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            column = batch.column("set")
            offsets = column.offsets.to_numpy()
            values = column.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
            n = np.diff(offsets)
            full = np.flatnonzero(n)
            starts = (offsets[:-1] - offsets[0])[full]
            digests = np.zeros((2, len(n)), dtype=np.uint64)
            least = np.zeros((len(n), spec.hashes), dtype="<u4")
            mini = np.zeros((len(n), spec.hashes + spec.bins), dtype=np.uint8)
            if len(full):
                hashed = mix(values, 0xA0761D6478BD642F)
                place = np.repeat(np.arange(len(n)) * spec.bins, n) + (hashed % np.uint64(spec.bins)).astype(np.int64)
                lowest = np.full(len(n) * spec.bins, np.iinfo(np.uint64).max)
                np.minimum.at(lowest, place, hashed)
                some = np.flatnonzero(np.bincount(place, minlength=len(lowest)))
                mini[some // spec.bins, spec.hashes + some % spec.bins] = lowest[some] // np.uint64(spec.bins) % np.uint64(255) + np.uint64(1)
                for k, by in enumerate((0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)):
                    digests[k, full] = np.add.reduceat(mix(values, by), starts)
                for h in range(spec.hashes):
                    lowest = np.minimum.reduceat(values * factors[h] + shifts[h], starts)
                    least[full, h] = (lowest >> np.uint64(32)).astype("<u4")
                mini[full, : spec.hashes] = least[full] % 255 + 1
            fixed = lambda x: pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(x[0].nbytes if len(x) else 1), len(x), [None, pa.py_buffer(x.tobytes())]
            ).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(n.astype(np.int64)),
                    pa.array(digests[0].view(np.int64)),
                    pa.array(digests[1].view(np.int64)),
                    fixed(least),
                    fixed(mini),
                ],
                names=["doc_id", "text_hash", "n", "d1", "d2", "sig", "mini"],
            )

    schema = "doc_id long, text_hash long, n long, d1 long, d2 long, sig binary, mini binary"
    return sets.mapInArrow(sign, schema)


def table_keys(sig: Column, spec: Spec) -> Column:
    """One key for each pair of a group of the first and a group of the second collection."""
    width = 4 * spec.rows
    group = lambda i: F.substring(sig, i * width + 1, width)
    g = spec.groups
    first = [F.xxhash64(F.lit(i), group(F.lit(i))) for i in range(g)]
    second = [F.xxhash64(F.lit(i), group(F.lit(g + i))) for i in range(g)]
    return F.flatten(
        F.transform(F.array(*first), lambda a: F.transform(F.array(*second), lambda b: F.xxhash64(a, b)))
    )


class Rows(NamedTuple):
    """Whole groups of consecutive rows with equal keys; group g is rows first[g] to first[g + 1]."""

    first: np.ndarray
    columns: dict[str, np.ndarray]
    mini: np.ndarray

    @property
    def group(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str], at_once: int = 20_000) -> Iterator[Rows]:
    """The rows of a task, about ``at_once`` at a time, never cutting a group."""
    held: list[pd.DataFrame] = []

    def rows(frame: pd.DataFrame) -> Rows:
        key = frame[keys].to_numpy()
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True])
        mini = np.frombuffer(b"".join(frame["mini"]), dtype=np.uint8).reshape(len(frame), -1)
        return Rows(first, {c: frame[c].to_numpy() for c in frame.columns if c != "mini"}, mini)

    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) < at_once:
            continue
        joined = pd.concat(held, ignore_index=True) if len(held) > 1 else frame
        key = joined[keys].to_numpy()
        change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1))
        if not len(change):
            held = [joined]
            continue
        cut = change[-1] + 1
        yield rows(joined.iloc[:cut])
        held = [joined.iloc[cut:]]
    if held and sum(map(len, held)):
        yield rows(pd.concat(held, ignore_index=True))


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of equal minima of pairs of minis, and how many minima it rests on."""
    known = (a | b) != 0
    number = np.maximum(known.sum(axis=-1), 1)
    return ((a == b) & known).sum(axis=-1) / number, number


def sizes_fit(spec: Spec, size_a, size_b) -> np.ndarray:
    """Which pairs can be links by the sizes of their sets, which is exact."""
    return 100 * np.minimum(size_a, size_b) >= spec.likeness_pct * np.maximum(size_a, size_b)


def fewest_equal(spec: Spec) -> np.ndarray:
    """By number of minima, the fewest equal ones of a pair that is compared: links have fewer with probability ``missed`` at most.

    The number of equal minima of a link is binomial with at least the limit's likeness (for bins of one permutation, which are
    drawn without putting back, the tail is smaller still).
    """
    limit = spec.likeness_pct / 100
    found = []
    for number in range(spec.hashes + spec.bins + 1):
        tail, k = 0.0, 0
        while k < number:
            tail += math.comb(number, k) * limit**k * (1 - limit) ** (number - k)
            if tail > spec.missed:
                break
            k += 1
        found.append(k)
    return np.array(found)


def possible(spec: Spec, a: np.ndarray, b: np.ndarray, size_a, size_b) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs are likely to be links by their estimates and sizes, and the estimates."""
    limit = spec.likeness_pct / 100
    share, number = estimate(a, b)
    enough = share >= limit - spec.deviations * np.sqrt(limit * (1 - limit) / number)
    return enough & sizes_fit(spec, size_a, size_b), share


def centres(spec: Spec):
    """For each block of documents with one table key: the pairs with its first document, or in large blocks the one that
    agrees most with a few others."""

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_groups(frames, ["key", "block"]):
            centre = rows.first[:-1].copy()
            for g in np.flatnonzero(np.diff(rows.first) > 8):
                mini = rows.mini[rows.first[g] : rows.first[g + 1]]
                some = np.unique(np.linspace(0, len(mini) - 1, 16).astype(int))
                centre[g] += int(np.argmax(sum((mini == mini[i]).sum(axis=1) for i in some)))
            other = centre[rows.group]
            size, node = rows.columns["n"], rows.columns["nid"]
            ok, share = possible(spec, rows.mini, rows.mini[other], size, size[other])
            ok &= node != node[other]
            yield pd.DataFrame({"a": node[ok], "b": node[other[ok]], "share": share[ok]})

    return pairs


def across(spec: Spec, frames: Iterator[pd.DataFrame]) -> Iterator[tuple[Rows, Iterator[tuple[int, np.ndarray]]]]:
    """For each document that shares a table key with another component: the documents there. The rows are whole pairs of
    blocks; each pair of documents is met from both sides."""

    def found(rows: Rows) -> Iterator[tuple[int, np.ndarray]]:
        label, block, low, high = (rows.columns[c] for c in ("label", "block", "low", "high"))
        for start, end in zip(rows.first, rows.first[1:], strict=False):
            if (label[start:end] == label[start]).all():
                continue
            at = np.arange(start, end)
            for i in at:
                there = True if low[i] == high[i] else block[at] != block[i]
                others = at[(label[at] != label[i]) & there]
                if len(others):
                    yield i, others

    for rows in whole_groups(frames, ["key", "low", "high"]):
        yield rows, found(rows)


def closest(spec: Spec):
    """For each document the likeliest one of another component, for each table key."""

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, found in across(spec, frames):
            node, size = rows.columns["nid"], rows.columns["n"]
            best = []
            for i, others in found:
                ok, share = possible(spec, rows.mini[others], rows.mini[i], size[others], size[i])
                if ok.any():
                    most = np.where(ok, share, -1.0).argmax()
                    best.append((node[i], node[others[most]], share[most]))
            yield pd.DataFrame(best, columns=["a", "b", "share"])

    return pairs


def visitors(spec: Spec):
    """Documents and the other components that they share tables with; of two components the smaller one's visit.

    A pair is ruled out by its sizes, or by minima of which fewer are equal than in all but a share ``missed`` of links; else texts that
    share a passage and little more would all be compared with one another. Two documents that share several tables are
    taken up in the first of them only.
    """

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fewest = fewest_equal(spec)
        for rows, found in across(spec, frames):
            node, label, size, table = (rows.columns[c] for c in ("nid", "label", "size", "table"))
            n, mini = rows.columns["n"], rows.mini
            minima = np.frombuffer(b"".join(rows.columns["sig"]), "<u4").reshape(len(node), 2, spec.groups, spec.rows)
            out = [np.zeros((0, 2), dtype=np.int64)]
            for i, others in found:
                others = others[(size[i] < size[others]) | ((size[i] == size[others]) & (label[i] < label[others]))]
                others = others[sizes_fit(spec, n[others], n[i])]
                known = (mini[others] | mini[i]) != 0
                equal = ((mini[others] == mini[i]) & known).sum(axis=1)
                others = others[equal >= fewest[known.sum(axis=1)]]
                first = (minima[others] == minima[i]).all(axis=3).argmax(axis=2)
                visits = others[first[:, 0] * spec.groups + first[:, 1] == table[i]]
                hosts = np.unique(label[visits])
                out.append(np.stack([np.full(len(hosts), node[i]), hosts], axis=1))
            yield pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b"])

    return pairs


class NearDuplicates:
    """The stages of one run over ``docs`` (doc_id, text)."""

    def __init__(self, docs: DataFrame, spec: Spec):
        self.spec = spec
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), full_text().alias("text"))
        self.docs = self.docs.withColumn("text_hash", F.xxhash64("text"))
        with small_batches(docs.sparkSession):
            self.signed = save_table(signatures(with_set(self.docs, spec.words), spec), "signatures")
        first = F.min(F.struct("doc_id", "text_hash")).alias("one")
        classes = self.signed.where("n > 0").groupBy("d1", "d2", "n")
        nodes = classes.agg(first, F.min("doc_id").alias("least_id"), F.first("sig").alias("sig"), F.first("mini").alias("mini"))
        nodes = nodes.select(
            F.monotonically_increasing_id().alias("nid"),
            "d1",
            "d2",
            "n",
            "least_id",
            F.col("one.doc_id").alias("one_id"),
            F.col("one.text_hash").alias("one_hash"),
            "mini",
            "sig",
        )
        self.nodes = save_table(nodes, "classes")
        rows = self.signed.groupBy("doc_id", "text_hash").count().where("count > 1")
        self.repeated = not rows.isEmpty()  # then a class's document may be several rows

    def members(self) -> DataFrame:
        """Table keys that several classes have, with these classes, dealt into blocks of bounded size."""
        rows = self.nodes.select("nid", F.posexplode(table_keys(F.col("sig"), self.spec)).alias("table", "key"))
        counts = save_table(rows.groupBy("key").count().where("count > 1"), "key-counts")
        block = F.pmod(F.xxhash64("nid", F.lit(1)), F.ceil(F.col("count") / self.spec.block)).cast("int")
        return save_table(rows.join(counts, "key").withColumn("block", block), "members")

    def with_mini(self, rows: DataFrame, *more: str) -> DataFrame:
        return rows.join(self.nodes.select("nid", "n", "mini", *more), "nid")

    def sets_of(self, members: DataFrame) -> DataFrame:
        """nid and whole shingle set of every class that shares a table key, made from one of its documents and written."""
        named = members.select("nid").distinct().join(self.nodes.select("nid", "one_id", "one_hash"), "nid")
        named = broadcast_small(save_table(named, "shared"), self.spec.broadcast_rows)
        texts = self.docs.select(F.col("doc_id").alias("one_id"), F.col("text_hash").alias("one_hash"), "text")
        same = [named["one_hash"] == texts["one_hash"], named["one_id"].eqNullSafe(texts["one_id"])]
        found = with_set(texts.join(named, same).select(named["nid"], texts["text"]), self.spec.words)
        return save_table(found.dropDuplicates(["nid"]) if self.repeated else found, "sets")

    def confirmed(self, guests: DataFrame, hosts: DataFrame) -> DataFrame:
        """Links ``a``, ``b`` between the guests (nid, room, part) and hosts (nid, room, part) of the same room and part."""
        with_sets = lambda rows: rows.join(self.sets, "nid")
        host = with_sets(hosts).select("room", "part", F.col("nid").alias("b"), F.col("set").alias("host_set"))
        both = F.size(F.array_intersect("set", "host_set"))
        union = F.size("set") + F.size("host_set") - both
        alike = (100 * both.cast("long") >= self.spec.likeness_pct * union.cast("long")) & (F.col("nid") != F.col("b"))
        links = with_sets(guests).join(host, ["room", "part"]).where(alike)
        return save_table(links.select(F.col("nid").alias("a"), "b"), "confirmed")

    def confirmed_pairs(self, pairs: DataFrame) -> DataFrame:
        """Links among pairs ``a``, ``b``; many pairs of one ``b`` are spread over parts."""
        pairs = save_table(pairs, "pairs")
        number = pairs.groupBy("b").agg(F.ceil(F.count("*") / GUESTS).alias("parts"))
        part = F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part")
        dealt = save_table(pairs.join(number, "b").select(F.col("a").alias("nid"), F.col("b").alias("room"), part), "dealt-pairs")
        return self.confirmed(dealt, dealt.select(F.col("room").alias("nid"), "room", "part").distinct())

    def confirmed_visits(self, visits: DataFrame, labels: DataFrame) -> DataFrame:
        """Links of classes ``a`` with any member of the component labelled ``b``; large components are spread over parts."""
        visits = save_table(visits, "visits")
        wanted = visits.select(F.col("b").alias("label")).distinct()
        members = wanted.join(labels, "label", "left").select(F.col("label").alias("room"), F.coalesce("node", "label").alias("nid"))
        members = save_table(members, "hosts")
        number = save_table(members.groupBy("room").agg(F.ceil(F.count("*") / GUESTS).cast("int").alias("parts")), "rooms")
        hosts = members.join(number, "room").select("nid", "room", F.pmod(F.xxhash64("nid"), F.col("parts")).cast("int").alias("part"))
        guests = visits.select(F.col("a").alias("nid"), F.col("b").alias("room")).join(number, "room")
        return self.confirmed(guests.select("nid", "room", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), hosts)

    def mixed(self, members: DataFrame, labels: DataFrame, *more: str) -> DataFrame:
        """Members of table keys that hold several components, once for each pair of their key's blocks."""
        known = labels.select(F.col("node").alias("nid"), "label")
        named = members.join(known, "nid", "left").withColumn("label", F.coalesce("label", "nid"))
        sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
        named = named.join(sizes, "label", "left").withColumn("size", F.coalesce("size", F.lit(1)))
        named = save_table(named, "labelled")
        several = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
        last = F.ceil(F.col("count") / self.spec.block).cast("int") - 1
        rows = self.with_mini(named.join(several.select("key"), "key"), *more)
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last))).drop("count")
        rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")
        return rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "nid")

    def joined(self, labels: DataFrame, links: DataFrame) -> DataFrame:
        """Labels after more links: components of the labelled graph."""
        of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
        ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
        ends = ends.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
        found = save_table(connected_components(ends), "components")
        every = labels.select("node").union(found.select("node")).distinct().join(labels, "node", "left")
        last = found.select(F.col("node").alias("label"), F.col("label").alias("last"))
        every = every.withColumn("label", F.coalesce("label", "node")).join(last, "label", "left")
        return save_table(every.select("node", F.coalesce("last", "label").alias("label")), "labels")

    def labels(self) -> DataFrame:
        """node and label of every class that is linked with another.

        First each class is compared with the likeliest of its tables' centres, then with the likeliest class of another
        component in any of its tables, and last with all classes of such a component; the first two only save comparisons.
        """
        spec, members, schema = self.spec, self.members(), "a long, b long, share double"
        self.sets = self.sets_of(members)
        best = lambda pairs: pairs.groupBy("a").agg(F.max_by("b", "share").alias("b"))
        dealt = self.with_mini(members.drop("count", "table")).repartition("key", "block").sortWithinPartitions("key", "block", "nid")
        links = self.confirmed_pairs(best(dealt.mapInPandas(centres(spec), schema)))
        labels = save_table(connected_components(links), "labels")
        links = self.confirmed_pairs(best(self.mixed(members, labels).mapInPandas(closest(spec), schema)))
        labels = self.joined(labels, links)
        visits = self.mixed(members, labels, "sig").mapInPandas(visitors(spec), "a long, b long").distinct()
        return self.joined(labels, self.confirmed_visits(visits, labels))

    def result(self) -> DataFrame:
        labels = self.labels().select(F.col("node").alias("nid"), "label")
        named = self.nodes.select("nid", "d1", "d2", "n", "least_id").join(labels, "nid", "left")
        named = named.withColumn("label", F.coalesce("label", "nid"))
        least = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
        classes = save_table(named.join(least, "label").select("d1", "d2", "n", "component_id"), "components")
        joined = self.signed.drop("sig", "mini", "text_hash").join(classes, ["d1", "d2", "n"], "left")
        component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
        return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
            "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
        )


def near_duplicates(docs: DataFrame, spec: Spec | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Words are runs without ASCII white space, A-Z lower-cased. Documents whose sets of distinct word shingles overlap in at
    least ``likeness_pct`` percent of their union are linked; a component is named after its smallest doc_id, whose
    document is kept. Documents without words are linked with nothing. Null ids never name a component unless it
    has no other; equal ids are one document if their sets are equal.

    Documents of equal sets form one class, and classes meet in tables keyed by pairs of minhash groups. In each table
    every class is compared with a typical one, which links large groups with one comparison for each member. Classes that
    still share a table without being connected are then compared, first with the likeliest partner, then with the whole other
    component, in parts of bounded size; nothing is capped. Estimates from minima choose the partners of the first two rounds. In the
    last one a pair is passed over if so few of its minima agree that a link looks like that once in ``missed`` (10^-9) cases;
    the tables themselves miss a link of the least likeness in 6 of 10,000 cases. Links are confirmed on whole sets of 64-bit
    shingle hashes.
    """
    return NearDuplicates(docs, spec or Spec()).result()


def drop_near_duplicates(docs: DataFrame, spec: Spec | None = None) -> DataFrame:
    """The rows of ``docs`` whose document is kept, one row for each; all columns stay as they were.

    Rows of one id and text are one document. A dropped id takes all its rows along. Rows without an id are only compared by
    their text: one row of each text stays.
    """
    spec = spec or Spec()
    found = save_table(near_duplicates(docs, spec), "near-duplicates")
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    gone = broadcast_small(save_table(gone, "dropped"), spec.broadcast_rows)
    left = docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
    again = found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again"))
    again = save_table(again, "repeated-ids")
    if again.isEmpty():
        return left
    # several rows of one id (or of none): one row of each text
    repeated = F.col("doc_id").cast("long").eqNullSafe(F.col("__again"))
    one = left.join(again, repeated, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, repeated, "left_anti").unionByName(one)

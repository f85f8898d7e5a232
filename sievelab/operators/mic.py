"""Maximal information coefficient of features with the response.

MIC is the highest normalised mutual information of any i x j grid with i * j <= B, B = n^alpha (Reshef et al.,
Science 2011). Spark ranks both axes and counts pairs of ranks, which is all that the two searches see:

``optimized``  the published approximation: one axis cut into equal parts, the other by dynamic programming over
               superclumps (``clumps`` per column), in both orientations;
``grid``       both axes cut into equal parts: a cheaper lower bound. Of a grid's two numbers of parts one is at most the root of
               B; for each of these, and each axis, the points are counted once, in order of the other axis, for all numbers of
               parts there. A grid's column is scored when it ends, so only the open column of each grid is held.

Nothing is capped or binned unless ``max_b`` or ``cells`` ask for it. The work is dealt by feature, orientation and numbers of
parts. A task reads its pairs as a sorted stream and keeps only what it fills from them: for each number of parts at most
clumps x B counts, whatever the number of rows. The dynamic programme would take about clumps^2 B^3 / 40 steps for a feature
without ties, that is n^1.8; it leaves out last groups too long to be best. With few distinct values it is short at every n.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelab.operators.association import name_table
from sievelab.operators.ordering import slot_rows, with_ranks
from sievelab.sources.scratch import save_table

SEARCH_BYTES = 64 << 20  # counts that one task fills at a time
POINTS_AT_ONCE = 1 << 17  # points of a grid search that are put into the counts together
CELLS_AT_ONCE = 1 << 20  # cells of grids that are scored together
DENSE = 448  # superclumps up to which all their spans are held in one matrix
SPANS_AT_ONCE = 1 << 14  # whose entropies are computed together
TABLE = 1 << 20  # rows up to which x log x of all counts is held
UNIT = ["pos", "side", "chunk"]


def cell_counts(packed: DataFrame, rows: int, width: int, cells: int | None = None, **options) -> DataFrame:
    """(pos, cx, cy, c): rows per pair of ranks, from 0, or of at most ``cells`` rank cells. Tied values share one."""

    def cell(rank: str):
        place = F.col(rank) - 1
        return place if cells is None else F.floor(place * F.lit(cells) / F.lit(rows)).cast("long")

    for_rows = {"rows_per_slot": slot_rows(rows, width), **options}
    ranked_y = with_ranks(packed.select("y", "x"), "y", sizes=(rows, 1), **for_rows)
    ranked_y = save_table(ranked_y.select(cell("min_rank").alias("cy"), "x"), "ranked-response")
    long = ranked_y.select("cy", F.posexplode("x").alias("pos", "value"))
    ranked = with_ranks(long, "value", ["pos"], sizes=(rows, width), **options)
    return ranked.groupBy("pos", cell("min_rank").alias("cx"), "cy").agg(F.count(F.lit(1)).alias("c"))


def grid_bound(rows: int, alpha: float = 0.6, max_b: int | None = None) -> int:
    bound = max(int(rows**alpha), 4)
    return bound if max_b is None else min(bound, max_b)


def mic(
    packed: DataFrame,
    names: list[str],
    rows: int | None = None,
    alpha: float = 0.6,
    clumps: int = 15,
    cells: int | None = None,
    max_b: int | None = None,
    method: str = "optimized",
    **options,
) -> DataFrame:
    """(variable, mic, b) of every feature with the response; ``packed`` holds y and x without missing values."""
    if method not in ("optimized", "grid"):
        raise ValueError(f"unknown method {method!r}")
    rows = packed.count() if rows is None else rows
    bound = grid_bound(rows, alpha, max_b)
    counts = save_table(cell_counts(packed, rows, len(names), cells, **options), "rank-pairs")
    if method == "grid":
        scored = _grid_scores(counts, bound, rows if cells is None else cells, rows, len(names))
    else:
        scored = _optimized_scores(counts, rows, bound, clumps)
    best = scored.groupBy("pos").agg(F.max("score").alias("score"))
    found = F.broadcast(name_table(packed, names)).join(best, "pos", "left")
    score = F.least(F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return found.select("variable", score.alias("mic"), F.lit(bound).alias("b"))


def _dealt(costs: list[float], sizes: list[float], cost: float, size: float) -> list[int]:
    """Chunk of each item when consecutive ones share a chunk up to a cost and a size."""
    chunk, found, held_cost, held_size = 0, [], 0.0, 0.0
    for c, s in zip(costs, sizes, strict=True):
        if found and (held_cost + c > cost or held_size + s > size):
            chunk, held_cost, held_size = chunk + 1, 0.0, 0.0
        found.append(chunk)
        held_cost, held_size = held_cost + c, held_size + s
    return found


def _in_tasks(stream: DataFrame, order: list[str], work: Callable, schema: str, unit: list[str] = UNIT) -> DataFrame:
    """Whole units, in order, in tasks. The search is heavy and its input small, so the number of tasks is not left to data size."""
    tasks = 4 * stream.sparkSession.sparkContext.defaultParallelism
    return stream.repartition(tasks, *unit).sortWithinPartitions(*unit, *order).mapInPandas(work, schema)


def _task_keys(spark: SparkSession, units: int) -> list[int]:
    """A long for each unit, such that ``_in_tasks`` deals no two of them to a task before each has one."""
    tasks = 4 * spark.sparkContext.defaultParallelism
    task = F.pmod(F.hash("id"), F.lit(tasks)).alias("task")
    found: dict[int, list[int]] = {i: [] for i in range(tasks)}
    for key, of in spark.range(0, 16 * (tasks + units), 1, 1).select("id", task).collect():
        found[of].append(key)
    turns = sorted((turn, of, key) for of, keys in found.items() for turn, key in enumerate(keys))
    return [key for _, _, key in turns[:units]]


def _segments(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Frames cut where a key changes; a unit may come in several frames."""
    for frame in frames:
        key = frame[keys].to_numpy()
        ends = [*(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(frame)]
        start = 0
        for end in ends:
            if end > start:
                yield tuple(key[start]), frame.iloc[start:end]
            start = end


# Equal parts on one axis, the best columns on the other


def _optimized_scores(counts: DataFrame, rows: int, bound: int, clumps: int) -> DataFrame:
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("cx").alias("u"), F.col("cy").alias("v")),
                              F.struct(F.lit(1).alias("side"), F.col("cy").alias("u"), F.col("cx").alias("v"))))
    points = counts.select("pos", "c", sides.alias("s")).select("pos", "s.side", "s.u", "s.v", "c")
    margins = points.groupBy("pos", "side", "v").agg(F.sum("c").alias("c")).withColumn("chunk", F.lit(0))
    cuts = _in_tasks(margins, ["v"], equal_cuts(rows, bound, clumps), "pos int, side int, chunk int, parts int, starts array<long>")
    cuts = save_table(cuts, "cuts")
    wanted = cuts.select(*UNIT).distinct()  # at most a few dozen for each feature and side
    nothing = [F.lit(None).cast("int").alias("parts"), F.lit(None).cast("array<long>").alias("starts")]
    dealt = points.join(F.broadcast(wanted), ["pos", "side"]).select(*UNIT, "u", "v", "c", *nothing)
    first = [F.lit(-1).cast("long").alias(name) for name in ("u", "v", "c")]
    stream = dealt.unionByName(cuts.select(*UNIT, *first, "parts", "starts"))
    return _in_tasks(stream, ["u", "v"], column_search(rows, bound, clumps), "pos int, score double")


def equal_cuts(rows: int, bound: int, clumps: int):
    """For each axis the first ranks of all but the first part, for every number of parts; equal partitions once.

    Tied ranks are one block and never split. All numbers of parts advance together over the blocks as they come.
    """
    parts = np.arange(2, bound // 2 + 1)
    most = bound // parts
    chunks = _dealt((most.astype(float) ** 3).tolist(), (16.0 * (clumps * most + 1) * parts).tolist(), float(most[0]) ** 3, SEARCH_BYTES)

    def cuts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = None

        def closed() -> pd.DataFrame:
            seen, out = set(), []
            for p, chunk, at in zip(parts.tolist(), chunks, starts, strict=True):
                if at and tuple(at) not in seen:
                    seen.add(tuple(at))
                    out.append((key[0], key[1], chunk, p, at))
            return pd.DataFrame(out, columns=[*UNIT, "parts", "starts"])

        for found, frame in _segments(frames, ["pos", "side"]):
            if found != key:
                if key is not None:
                    yield closed()
                key, starts = found, [[] for _ in parts]
                held, current = np.zeros(len(parts), dtype=np.int64), np.zeros(len(parts), dtype=np.int64)
                left = np.full(len(parts), rows, dtype=np.int64)
            for v, size in zip(frame["v"].tolist(), frame["c"].tolist(), strict=True):
                # nearer to an equal share without this block
                close = (held > 0) & ((2 * held + size) * np.maximum(parts - current, 1) >= 2 * left)
                if close.any():
                    for i in np.flatnonzero(close):
                        starts[i].append(v)
                    left -= np.where(close, held, 0)
                    held[close] = 0
                    current += close
                held += size
        if key is not None:
            yield closed()

    return cuts


class Superclumps:
    """Counts (superclump, part) of one partition into parts, filled from points in the order of the other axis.

    Neighbouring ranks whose points all lie in one and the same part form a clump. If there are more than ``limit`` clumps they
    are merged into about equal superclumps; which of the two is known at the end only, so both tables are kept.
    """

    def __init__(self, starts: np.ndarray, limit: int, rows: int):
        self.starts, self.limit, self.used = starts, limit, len(starts) + 1
        self.fine = np.zeros((limit, self.used))
        self.coarse = np.zeros((limit + 1, self.used))
        self.open = np.zeros(self.used)  # the last clump, which may go on
        self.clumps, self.last = 0, -2
        self.number, self.held, self.left = 0, 0, rows

    def feed(self, first: np.ndarray, v: np.ndarray, c: np.ndarray) -> None:
        """Points of whole ranks; rank i of them is points first[i] to first[i + 1]."""
        part = np.searchsorted(self.starts, v, side="right")
        low, high = np.minimum.reduceat(part, first), np.maximum.reduceat(part, first)
        top = np.where(low == high, low, -1)
        new = (top < 0) | (top != np.r_[self.last, top[:-1]])
        self.last = int(top[-1])
        local = np.repeat(np.cumsum(new), np.diff(np.r_[first, len(v)]))  # 0 is the clump that was open
        end = int(local[-1])
        known = np.flatnonzero(self.clumps - 1 + local < self.limit)
        if len(known):
            place = (self.clumps - 1 + local[known]) * self.used + part[known]
            self.fine += np.bincount(place, c[known], self.fine.size).reshape(self.fine.shape)
        going = local == end
        still = np.bincount(part[going], c[going], self.used)
        if end:
            sizes = np.bincount(local[~going], c[~going], end).astype(np.int64)
            sizes[0] += int(self.open.sum())
            skip = int(not self.clumps)  # nothing was open
            group = np.zeros(end, dtype=np.int64)
            group[skip:] = self._merged(sizes[skip:])
            self.coarse[group[0]] += self.open
            self.coarse += np.bincount(group[local[~going]] * self.used + part[~going], c[~going], self.coarse.size).reshape(self.coarse.shape)
            self.open = still
        else:
            self.open = self.open + still
        self.clumps += end

    def _merged(self, sizes: np.ndarray) -> np.ndarray:
        """Superclump of each of the next clumps."""
        upto = np.r_[0, np.cumsum(sizes)]
        middle = upto[:-1] + upto[1:]
        found, at = np.zeros(len(sizes), dtype=np.int64), 0
        while at < len(sizes):
            share = -(-2 * self.left // max(self.limit - self.number, 1))
            end = int(np.searchsorted(middle, share - 2 * self.held + 2 * upto[at]))
            end = min(max(end, at + (self.held == 0)), len(sizes))
            found[at:end] = self.number
            self.held += int(upto[end] - upto[at])
            if end < len(sizes):
                self.left, self.held, self.number = self.left - self.held, 0, self.number + 1
            at = end
        return found

    def table(self) -> np.ndarray:
        if self.clumps <= self.limit:
            return self.fine[: self.clumps]
        group = int(self._merged(np.array([int(self.open.sum())]))[0])
        self.coarse[group] += self.open
        return self.coarse[self.coarse.sum(1) > 0]


def column_search(rows: int, bound: int, clumps: int):
    """Best score of each unit, from its partitions (rows that come first, with u = -1) and its points in order of u."""

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tables, rest = None, {}, None

        def feed(points: np.ndarray) -> None:
            first = np.flatnonzero(np.r_[True, points[1:, 0] != points[:-1, 0]])
            for held in tables.values():
                held.feed(first, points[:, 1], points[:, 2])

        def closed() -> pd.DataFrame:
            if rest is not None and len(rest):
                feed(rest)
            best = 0.0
            for parts, held in tables.items():
                table = held.table()
                for columns, information in enumerate(best_columns(table, bound // parts), start=2):
                    best = max(best, information / math.log(min(columns, held.used)))
            return pd.DataFrame({"pos": [int(key[0])], "score": [best]})

        for found, frame in _segments(frames, UNIT):
            if found != key:
                if key is not None:
                    yield closed()
                key, tables, rest = found, {}, None
            head = (frame["u"] < 0).to_numpy()
            for parts, starts in zip(frame["parts"][head], frame["starts"][head], strict=True):
                tables[int(parts)] = Superclumps(np.asarray(starts, dtype=np.int64), clumps * (bound // int(parts)), rows)
            points = frame.loc[~head, ["u", "v", "c"]].to_numpy()
            if rest is not None:
                points = np.concatenate([rest, points])
            if not len(points):
                continue
            whole = int(np.searchsorted(points[:, 0], points[-1, 0]))  # the last rank may go on
            if whole:
                feed(points[:whole])
            rest = points[whole:]
        if key is not None:
            yield closed()

    return search


# Equal parts on both axes


class Grids(NamedTuple):
    """Grids of ``parts`` parts on one axis (x for side 0, y for side 1) and ``low`` to ``high`` - 1 parts on the other."""

    side: int
    parts: int
    low: int
    high: int

    @property
    def cells(self) -> int:
        """Numbers that are held for them."""
        return (self.parts + 2) * (self.high - self.low)

    @property
    def cost(self) -> int:
        """Cells of all these grids."""
        return self.parts * sum(range(self.low, self.high))


def grids(bound: int, most: int) -> list[Grids]:
    """All grids of at least 2 x 2 and at most ``bound`` cells, each once, in sets that hold about ``most`` numbers."""
    found = []
    for parts in range(2, math.isqrt(bound) + 1):
        for side in (0, 1):
            low, end = parts + side, bound // parts + 1
            while low < end:
                high = min(end, low + max(1, most // (parts + 2)))
                found.append(Grids(side, parts, low, high))
                low = high
    return found


def distinct(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of ascending ranks, and the place of each rank among them."""
    new = np.r_[True, ranks[1:] != ranks[:-1]]
    return ranks[new], np.cumsum(new) - 1


class GridCounts:
    """One set of grids over points that come in order of the other axis.

    Of each grid the column that points still come to is held, and the sum of the scores of those before it.
    """

    def __init__(self, of: Grids, span: int):
        self.of, self.span = of, span
        self.others = np.arange(of.low, of.high)
        self.open = np.zeros((of.parts, len(self.others)))
        self.closed = np.zeros(len(self.others))
        self.held = np.zeros(of.parts)
        self.last = 0  # rank of the last point

    def feed(self, fixed: np.ndarray, other: np.ndarray, c: np.ndarray, seen: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """Points by their ranks on both axes; those on the other one ascend, from feed to feed too, and ``seen`` are the distinct ones."""
        values, place = distinct(other) if seen is None else seen
        part = fixed * self.of.parts // self.span
        self.held += np.bincount(part, c, self.of.parts)
        at = self.last * self.others // self.span
        ends = np.minimum(values[-1] * self.others // self.span - at, len(values))  # columns that end here, at most
        upto = None
        if self.of.parts * len(values) <= CELLS_AT_ONCE:
            upto = self._upto(part, place, c, len(values))
        chunk = np.cumsum(ends + 1) * self.of.parts // CELLS_AT_ONCE
        edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(self.others)]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            grid, cut = self._cuts(slice(i, j), at[i:j], ends[i:j], values)
            if upto is not None:
                self._close(slice(i, j), grid, cut, upto)
                continue
            kept = np.unique(np.r_[0, cut])  # values between two cuts count as one
            group = np.searchsorted(kept, np.arange(len(values)), side="right") - 1
            self._close(slice(i, j), grid, np.searchsorted(kept, cut), self._upto(part, group[place], c, len(kept)))
        self.last = int(values[-1])

    def _upto(self, part: np.ndarray, place: np.ndarray, c: np.ndarray, places: int) -> np.ndarray:
        """Points by part and below each place."""
        upto = np.zeros((self.of.parts, places + 1))
        counts = np.bincount(part * places + place, c, self.of.parts * places).reshape(self.of.parts, places)
        np.cumsum(counts, axis=1, out=upto[:, 1:])
        return upto

    def _cuts(self, some: slice, at: np.ndarray, ends: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Grid, and number of the values before it, of each place where a column of a grid ends, by grid and place."""
        others = self.others[some]
        many = np.flatnonzero(ends == len(values))  # more columns than values, perhaps: those that hold a value
        grid, cut = [], []
        step = max(1, CELLS_AT_ONCE // len(values))
        for i in range(0, len(many), step):
            of = many[i : i + step]
            column = values * others[of, None] // self.span
            g, k = np.nonzero(np.diff(column, axis=1, prepend=at[of, None]))
            grid.append(of[g])
            cut.append(k)
        few = np.flatnonzero((ends < len(values)) & (ends > 0))
        of = np.repeat(few, ends[few])
        number = at[of] + 1 + np.arange(len(of)) - np.repeat(np.cumsum(ends[few]) - ends[few], ends[few])
        grid.append(of)
        cut.append(np.searchsorted(values, (number * self.span + others[of] - 1) // others[of]))
        grid, cut = np.concatenate(grid), np.concatenate(cut)
        if len(many) and len(few):
            order = np.argsort(grid, kind="stable")
            grid, cut = grid[order], cut[order]
        return grid, cut

    def _close(self, some: slice, grid: np.ndarray, cut: np.ndarray, upto: np.ndarray) -> None:
        """Scores the columns that end at the cuts; the points behind a grid's last cut are its open column."""
        grids = some.stop - some.start
        at = np.arange(len(cut)) + grid  # each grid has one column more than cuts
        low, high = (np.zeros(len(cut) + grids, dtype=np.int64) for _ in range(2))
        low[at + 1], high[at] = cut, cut
        last = np.cumsum(np.bincount(grid, minlength=grids) + 1) - 1
        first = np.r_[0, last[:-1] + 1]
        high[last] = upto.shape[1] - 1
        joint = upto.take(high, axis=1) - upto.take(low, axis=1)
        joint[:, first] += self.open[:, some]
        self.open[:, some] = joint[:, last]
        joint[:, last] = 0.0
        self.closed[some] += np.add.reduceat(_column_scores(joint), first)

    def best(self) -> float:
        """Highest score of the grids."""
        n = self.held.sum()
        if not n:
            return 0.0
        left = self.closed + _column_scores(self.open)
        found = (left - _xlogx(self.held).sum() + _xlogx(n)) / n / np.log(np.minimum(self.of.parts, self.others))
        return max(0.0, float(found.max()))


def _column_scores(joint: np.ndarray) -> np.ndarray:
    """What each column of whole numbers adds to n x information."""
    total = joint.sum(axis=0)
    if total.max(initial=0.0) >= TABLE:
        return _xlogx(joint).sum(axis=0) - _xlogx(total)
    known = _xlogx_of_counts(TABLE)
    return known.take(joint.astype(np.int64)).sum(axis=0) - known.take(total.astype(np.int64))


def _grid_scores(counts: DataFrame, bound: int, span: int, rows: int, width: int) -> DataFrame:
    sets = grids(bound, SEARCH_BYTES // 8)
    cores = counts.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(8, cores // (2 * max(width, 1))))  # of one feature and side: as many copies of its points are shuffled
    held: list[list[list[Grids]]] = []
    for side in (0, 1):
        own = [s for s in sets if s.side == side]
        costs = [2e-8 * rows + 1e-8 * s.cost for s in own]  # about the seconds of counting and of scoring
        share = max(sum(costs) / tasks, max(costs, default=0.0)) * (1 + 1e-9)
        chunks = _dealt(costs, [8.0 * s.cells for s in own], share, SEARCH_BYTES)
        held.append([[s for s, c in zip(own, chunks, strict=True) if c == chunk] for chunk in sorted(set(chunks))])
    of_copy = [chunk for own in held for chunk in own]
    keys = _task_keys(counts.sparkSession, max(width, 1) * len(of_copy))
    copies = [
        F.struct(F.lit(number).alias("copy"), F.col(fixed).alias("fixed"), F.col(other).alias("other"))
        for number, (fixed, other) in enumerate([("cx", "cy")] * len(held[0]) + [("cy", "cx")] * len(held[1]))
    ]
    stream = counts.select("pos", "c", F.explode(F.array(*copies)).alias("s"))
    unit = F.get(F.lit(keys), F.col("pos") * len(of_copy) + F.col("s.copy")).cast("long")
    stream = stream.select(unit.alias("unit"), "s.other", "s.fixed", "c")
    units = {key: divmod(number, len(of_copy)) for number, key in enumerate(keys)}

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tables = None, []
        points: list[pd.DataFrame] = []

        def feed() -> None:
            fixed, other, c = (np.concatenate([p[name].to_numpy() for p in points]) for name in ("fixed", "other", "c"))
            points.clear()
            seen = distinct(other)
            for table in tables:
                table.feed(fixed, other, c.astype(float), seen)

        def closed() -> pd.DataFrame:
            if points:
                feed()
            best = max((table.best() for table in tables), default=0.0)
            return pd.DataFrame({"pos": [units[int(key[0])][0]], "score": [best]})

        for found, frame in _segments(frames, ["unit"]):
            if found != key:
                if key is not None:
                    yield closed()
                key, tables = found, []  # the last counts are let go first
                tables = [GridCounts(s, span) for s in of_copy[units[int(key[0])][1]]]
            points.append(frame)
            if sum(map(len, points)) >= POINTS_AT_ONCE:
                feed()
        if key is not None:
            yield closed()

    return _in_tasks(stream, ["other"], search, "pos int, score double", ["unit"])


def information(joint: np.ndarray) -> float:
    n = joint.sum()
    return (_xlogx(joint).sum() - _xlogx(joint.sum(1)).sum() - _xlogx(joint.sum(0)).sum() + _xlogx(n)) / n


def _xlogx(values: np.ndarray) -> np.ndarray:
    return values * np.log(np.where(values > 0, values, 1.0))


def equal_parts(sizes: np.ndarray, parts: int) -> np.ndarray:
    """Part of each tied block when blocks, in order, are cut into about equal parts without splitting any."""
    part = np.zeros(len(sizes), dtype=int)
    left, current, held = float(sizes.sum()), 0, 0.0
    wanted = left / parts
    for i, size in enumerate(sizes):
        if held and abs(held + size - wanted) >= abs(held - wanted):
            current, left = current + 1, left - held
            held, wanted = 0.0, left / max(parts - current, 1)
        part[i] = current
        held += size
    return part


def optimized_score(x: np.ndarray, y: np.ndarray, c: np.ndarray, bound: int, clumps: int) -> float:
    """Best normalised information with equal parts on y and the best columns on x; points are distinct.

    The plain form of what ``column_search`` does on streams, for counts that fit into memory.
    """
    xs, column = np.unique(x, return_inverse=True)
    ys, row = np.unique(y, return_inverse=True)
    dense = np.zeros((len(xs), len(ys)))
    dense[column, row] = c
    row_sizes = dense.sum(0)
    best = 0.0
    for parts in range(2, bound // 2 + 1):
        row_part = equal_parts(row_sizes, parts)
        used = int(row_part[-1]) + 1
        if used < 2:
            continue
        most = bound // parts
        table = _merge_clumps(np.add.reduceat(dense, np.flatnonzero(np.diff(row_part, prepend=-1)), axis=1))
        if len(table) > clumps * most:
            merged = np.zeros((clumps * most, used))
            np.add.at(merged, equal_parts(table.sum(1), clumps * most), table)
            table = merged[merged.sum(1) > 0]
        for columns, information in enumerate(best_columns(table, most), start=2):
            best = max(best, information / np.log(min(columns, used)))
    return best


def _merge_clumps(table: np.ndarray) -> np.ndarray:
    """Neighbouring columns whose points all lie in one and the same row become one column."""
    pure = (table > 0).sum(1) == 1
    top = table.argmax(1)
    new = np.ones(len(table), dtype=bool)
    new[1:] = ~(pure[1:] & pure[:-1] & (top[1:] == top[:-1]))
    return np.add.reduceat(table, np.flatnonzero(new), axis=0)


def best_columns(table: np.ndarray, most: int) -> list[float]:
    """Highest mutual information with exactly 2, 3, ... ``most`` contiguous groups of the table's columns."""
    k, n = len(table), table.sum()
    if k < 2 or most < 2:
        return [0.0] * max(most - 1, 0)
    upto = np.vstack([np.zeros(table.shape[1]), table.cumsum(0)])
    left = (_least_dense if k <= DENSE else _least_by_column)(upto, min(most, k))
    rows_entropy = _xlogx(n) - _xlogx(table.sum(0)).sum()
    found = [(rows_entropy - x) / n for x in left]
    return found + [found[-1]] * (most - 1 - len(found))


@lru_cache(maxsize=2)
def _xlogx_of_counts(n: int) -> np.ndarray:
    return _xlogx(np.arange(n + 1.0))


class Spans:
    """n x conditional entropy left in the columns from each start to each end, by the counts before each column.

    Counts are whole numbers, so that up to TABLE rows their logarithms are looked up.
    """

    def __init__(self, upto: np.ndarray):
        self.columns = len(upto) - 1
        self.upto = np.ascontiguousarray(np.column_stack([upto.sum(1), upto]).T)
        n = float(self.upto[0, -1])
        self.looked_up = n <= TABLE and bool((self.upto == np.rint(self.upto)).all())
        if self.looked_up:
            self.upto, self.known = self.upto.astype(np.int64), _xlogx_of_counts(int(n))
        # More than the rounding of a span's entropy, that splitting a span cannot raise otherwise.
        self.rounding = 16 * len(self.upto) * np.finfo(float).eps * float(_xlogx(np.float64(n)))

    def _part(self, counts: np.ndarray, ends: slice, starts: slice) -> np.ndarray:
        size = counts[ends, None] - counts[None, starts]
        return self.known.take(size, mode="clip") if self.looked_up else _xlogx(np.maximum(size, 0.0))

    def cost(self, ends: slice, starts: slice) -> np.ndarray:
        """Entropy left, a row for each end; 0 where the start is not before it."""
        left = self._part(self.upto[0], ends, starts)
        for counts in self.upto[1:]:
            left -= self._part(counts, ends, starts)
        return left


def _least_dense(upto: np.ndarray, most: int) -> list[float]:
    """Least entropy left by 2, 3, ... ``most`` groups of all columns, with the costs of all spans at once."""
    spans = Spans(upto)
    k = spans.columns
    step = max(1, SPANS_AT_ONCE // (k + 1))
    cost = np.concatenate([spans.cost(slice(i, min(i + step, k + 1)), slice(0, k + 1)) for i in range(0, k + 1, step)])
    cost[np.triu_indices(k + 1)] = np.inf
    reach, found = cost[:, 0].copy(), []
    for _ in range(2, most + 1):
        reach = (cost + reach).min(axis=1)
        found.append(reach[-1])
    return found


def _least_by_column(upto: np.ndarray, most: int, block: int = 512) -> list[float]:
    """The same, a last column at a time: memory grows with columns x groups and not with the square of the columns."""
    spans = Spans(upto)
    k, end = spans.columns, 1
    reach = np.full((most, k + 1), np.inf)  # groups - 1, columns
    while end <= k:
        after = min(end + max(1, SPANS_AT_ONCE // end), k + 1)
        for cost in spans.cost(slice(end, after), slice(0, after - 1)):
            reach[0, end] = cost[0]
            groups = min(most, end)  # no more groups than columns
            reach[1:groups, end], _ = _best_last(reach[:groups, :end], cost[:end], spans.rounding, block)
            end += 1
    return reach[1:, k].tolist()


def _best_last(reach: np.ndarray, cost: np.ndarray, rounding: float, block: int) -> tuple[np.ndarray, int]:
    """Least entropy left by 2, 3, ... groups up to one end, from ``reach`` before it and the ``cost`` of last groups; also the sums tried.

    The last group is tried from its shortest form on. Cutting a span in two never leaves more entropy, so with a last group that
    starts before m at least as much is left as by one more group for the columns before m and a last one from m on. Once
    this is no less than the best found, longer last groups need not be tried, and the result is that of trying all.
    """
    groups, stop, size, tried = len(reach) - 1, len(cost), 32, 0
    best = np.full(groups, np.inf)
    while groups and stop > 1:
        start = max(1, stop - size)
        np.minimum(best[:groups], (reach[:groups, start:stop] + cost[start:stop]).min(axis=1), out=best[:groups])
        tried += groups * (stop - start)
        longer = reach[1 : groups + 1, start] + cost[start] < best[:groups] + rounding
        groups = len(longer) - int(longer[::-1].argmax()) if longer.any() else 0
        stop, size = start, min(2 * size, block)
    return best, tried

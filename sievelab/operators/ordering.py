"""Exact ranks and order statistics of groups that do not fit one task.

A rank needs the number of smaller values in the whole group, which a plain window computes by putting the
group into one task. Here large groups are cut at approximate quantiles first. Whatever the cut points are, the
rank is exact: rows in lower slots (counted once, with map-side combine) plus the rank inside the row's own
slot. A value so frequent that it fills the span between two cut points gets a slot of its own; all its rows tie, so
their rank does not depend on the task they go to. Groups of few distinct values are not moved at all: their ranks
are looked up in a table of values.

Cost for n rows: three scans with tiny aggregates and at most one shuffle of the rows, in groups x slots balanced tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sievelab.operators.joins import fix_small
from sievelab.sources.scratch import save_table

ROWS_PER_SLOT = 500_000
MAX_CUT_POINTS = 1 << 18
MAX_SLOTS = 1 << 14
MANY_GROUPS = 1 << 12
TABLE_VALUES = 100_000

_SLOT, _HOT, _BEFORE, _SIZE, _NUMBER, _TASK = "__slot", "__hot", "__before", "__size", "__number", "__task"


def slot_rows(rows: int, width: int) -> int:
    """Slot size for one ranking of all ``rows`` when each carries an array of ``width`` numbers.

    A single slot would put everything downstream into one task, so there are up to 64 even for few rows.
    """
    return max(1, min(ROWS_PER_SLOT // (width + 1), max(20_000, rows // 64)))


def group_sizes(df: DataFrame, by: list[str]) -> tuple[int, int]:
    """(rows of the largest group, number of groups)."""
    if by:
        counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        row = counts.agg(F.max("n").alias("largest"), F.count(F.lit(1)).alias("groups")).first()
        return int(row["largest"] or 0), int(row["groups"])
    return df.count(), 1


def _slot_count(largest: int, groups: int, rows_per_slot: int, by: list[str]) -> int:
    if by and largest <= 2 * rows_per_slot:
        return 1  # the groups themselves are tasks enough
    wanted = max(1, math.ceil(largest / rows_per_slot))
    return max(1, min(wanted, MAX_SLOTS, MAX_CUT_POINTS // max(groups, 1)))


def _cut_points(df: DataFrame, by: list[str], value: str, slots: int) -> DataFrame:
    """(by..., cuts): approximate quantiles per group, fixed once so every later pass sees the same cuts."""
    shares = [i / slots for i in range(1, slots)]
    accuracy = max(10_000, 4 * slots)  # no slot without a hot value exceeds 1.5 average slots
    cuts = df.groupBy(*by).agg(F.percentile_approx(value, shares, accuracy).alias("__cuts"))
    rows = cuts.collect()  # groups x slots numbers, at most MAX_CUT_POINTS
    return df.sparkSession.createDataFrame(rows, cuts.schema)


def _place(df: DataFrame, by: list[str], value: str, slots: int) -> DataFrame:
    """Adds the slot number (ordered by value) and whether the slot holds one frequent value only."""
    cuts = _cut_points(df, by, value, slots)
    if by:
        placed = df.join(F.broadcast(cuts), by)
    else:
        placed = df.withColumn("__cuts", cuts.scalar())
    # Binary search for the number of cuts below the value, as one expression, so that the plan does not grow with the slots.
    # It is never null; else a join on it would add a filter that repeats it.
    halvings = F.array(*[F.lit(1 << b) for b in reversed(range((slots - 1).bit_length()))])

    def halved(low: Column, step: Column) -> Column:
        probe = low + step
        below = (probe <= F.lit(slots - 1)) & (F.try_element_at("__cuts", probe) < F.col(value))
        return F.when(below, probe).otherwise(low)

    placed = placed.withColumn("__lo", F.coalesce(F.aggregate(halvings, F.lit(0), halved), F.lit(0)))
    here = F.try_element_at("__cuts", F.col("__lo") + F.lit(1))
    following = F.try_element_at("__cuts", F.col("__lo") + F.lit(2))
    hot = F.coalesce((here == F.col(value)) & (following == F.col(value)), F.lit(False))
    return (
        placed.withColumn(_HOT, hot)
        .withColumn(_SLOT, F.col("__lo") * 2 + F.col(_HOT).cast("int"))
        .drop("__cuts", "__lo")
    )


def _slot_offsets(placed: DataFrame, by: list[str]) -> DataFrame:
    """(by..., slot, its number, rows before it, rows in it, rows in the group); at most 2 x MAX_CUT_POINTS rows."""
    sizes = placed.groupBy(*by, _SLOT).agg(F.count(F.lit(1)).alias(_SIZE))
    whole = Window.partitionBy(*by)
    running = whole.orderBy(_SLOT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sizes.select(
        *by,
        _SLOT,
        _SIZE,
        F.row_number().over(Window.orderBy(*by, _SLOT)).cast("long").alias(_NUMBER),
        (F.sum(_SIZE).over(running) - F.col(_SIZE)).alias(_BEFORE),
        F.sum(_SIZE).over(whole).alias("group_rows"),
    )


def _ties(group: WindowSpec, value: str) -> Column:
    """Rows equal to this one: last minus first rank, so that one sort and one window give both."""
    ordered = group.orderBy(value)
    upto = F.count(F.lit(1)).over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return upto - F.rank().over(ordered) + 1


def with_ranks(
    df: DataFrame,
    value: str,
    by: list[str] | None = None,
    sizes: tuple[int, int] | None = None,
    rows_per_slot: int = ROWS_PER_SLOT,
    table_values: int = TABLE_VALUES,
) -> DataFrame:
    """Adds ``min_rank`` (rank of the first tied row, ascending), ``ties`` and ``group_rows``.

    ``value`` must be numeric and not null. ``sizes`` is (largest group, number of groups) if the caller knows it.
    Groups of few distinct values take their ranks from a table of at most ``table_values`` values; the others are cut into slots.
    """
    by = by or []
    tables = ValueTables(df, value, by, table_values)
    if tables.ranked is not None:
        if tables.rest is None:
            return tables.ranked
        return tables.ranked.unionByName(_with_ranks(tables.rest, value, by, sizes, rows_per_slot))
    return _with_ranks(df, value, by, sizes, rows_per_slot)


def _with_ranks(df: DataFrame, value: str, by: list[str], sizes: tuple[int, int] | None, rows_per_slot: int) -> DataFrame:
    largest, groups = sizes or group_sizes(df, by)
    if groups > MANY_GROUPS and largest > 2 * rows_per_slot:
        big, rest, n_big = _by_group_size(df, by, 2 * rows_per_slot)
        cut = _ranks_in_slots(big, value, by, _slot_count(largest, n_big, rows_per_slot, by))
        return cut.unionByName(_ranks_in_groups(rest, value, by))
    slots = _slot_count(largest, groups, rows_per_slot, by)
    return _ranks_in_groups(df, value, by) if slots == 1 else _ranks_in_slots(df, value, by, slots)


def _by_group_size(df: DataFrame, by: list[str], limit: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows of groups above ``limit`` rows, all other rows, and the number of groups above.

    Keeps a few very large groups among countless small ones from being ranked by one task each.
    """
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    large, n_large = fix_small(counts.where(F.col("__n") > limit).select(*by))
    while n_large is None:  # more than 200,000 groups of that size: only the larger ones are worth cutting
        limit *= 4
        large, n_large = fix_small(counts.where(F.col("__n") > limit).select(*by))
    large = F.broadcast(large)
    return df.join(large, by, "left_semi"), df.join(large, by, "left_anti"), n_large


def _ranks_in_groups(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """One task per group, for groups that fit."""
    group = Window.partitionBy(*by)
    return df.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.rank().over(group.orderBy(value)).cast("long").alias("min_rank"),
        _ties(group, value).alias("ties"),
        F.count(F.lit(1)).over(group).alias("group_rows"),
    )


def _ranks_in_slots(df: DataFrame, value: str, by: list[str], slots: int) -> DataFrame:
    """Rows are read and shuffled once: a slot is a task, and the rows of hot values, which all tie, are dealt by input partition."""
    columns = df.columns
    placed = _place(df, by, value, slots)
    offsets = _slot_offsets(placed, by)
    task = F.when(F.col(_HOT), -1 - F.spark_partition_id()).otherwise(F.col(_NUMBER)).cast("long")
    rows = placed.join(F.broadcast(offsets), [*by, _SLOT]).withColumn(_TASK, task)
    slot = Window.partitionBy(_TASK)
    inside = F.when(F.col(_HOT), F.lit(1)).otherwise(F.rank().over(slot.orderBy(value)))
    return rows.select(
        *[F.col(f"`{c}`") for c in columns],
        (F.col(_BEFORE) + inside).cast("long").alias("min_rank"),
        F.when(F.col(_HOT), F.col(_SIZE)).otherwise(_ties(slot, value)).alias("ties"),
        F.col("group_rows"),
    )


class ValueTables:
    """Ranks of groups whose values repeat, by one small table (by..., value, min_rank, ties, group_rows) for all of them.

    A group is taken if its distinct values, as estimated in one hash aggregate, are at most an eighth of its rows, and as long
    as all tables together have at most ``most`` rows. The table comes from a second hash aggregate and is broadcast once its size
    is known, so no row is shuffled.
    """

    def __init__(self, df: DataFrame, value: str, by: list[str], most: int):
        self.df, self.value, self.by, self.most = df, value, by, most
        self.rest: DataFrame | None = df
        self.ranked: DataFrame | None = None
        stats = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__rows"), F.approx_count_distinct(value, 0.02).alias("__values"))
        found = stats.orderBy("__values", *by).limit(MANY_GROUPS + 1).collect()
        if len(found) > MANY_GROUPS or any(r[c] is None for r in found for c in by):
            return
        taken, held = [], 0
        for row in found:
            held += row["__values"]
            if 8 * row["__values"] > row["__rows"] or held > most:
                break
            taken.append(row)
        if taken:
            self._take(taken, len(taken) == len(found))

    def _take(self, groups: list, every: bool) -> None:
        chosen = F.broadcast(self.df.sparkSession.createDataFrame([tuple(r[c] for c in self.by) for r in groups], self._by_schema())) if self.by else None
        some = self.df if every else self.df.join(chosen, self.by, "left_semi")
        counts = save_table(some.groupBy(*self.by, self.value).agg(F.count(F.lit(1)).alias("ties")), "value-counts")
        if counts.count() > 2 * self.most:
            return  # the estimate was too low
        group = Window.partitionBy(*self.by)
        rank = _first_rank(F.lit(0), group, self.value).cast("long").alias("min_rank")
        table = counts.select(*self.by, self.value, rank, "ties", F.sum("ties").over(group).alias("group_rows"))
        self.ranked = some.join(F.broadcast(table), [*self.by, self.value]).select(
            *[F.col(f"`{c}`") for c in self.df.columns], "min_rank", "ties", "group_rows"
        )
        self.rest = None if every else self.df.join(chosen, self.by, "left_anti")

    def _by_schema(self):
        return self.df.select(*self.by).schema


def average_rank(
    df: DataFrame,
    value: str,
    by: list[str] | None = None,
    descending: bool = False,
    alias: str = "avg_rank",
    **options,
) -> DataFrame:
    """Rank from 1, tied rows share the mean of their positions."""
    ranked = with_ranks(df, value, by, **options)
    rank = F.col("min_rank") + (F.col("ties") - 1) / F.lit(2.0)
    if descending:
        rank = F.col("group_rows") + 1 - rank
    return ranked.select(*[F.col(f"`{c}`") for c in df.columns], rank.cast("double").alias(alias))


def values_at(
    df: DataFrame,
    value: str,
    positions: Callable[[Column], Column],
    by: list[str] | None = None,
    sizes: tuple[int, int] | None = None,
    rows_per_slot: int = ROWS_PER_SLOT,
) -> DataFrame:
    """Exact order statistics: (by..., position, value, group_rows), position counted from 1.

    ``positions`` maps the group's row count to an array of positions. Only the slots that hold a wanted position
    are shuffled and sorted; every other row stops at a filter on its slot.
    """
    by = by or []
    largest, groups = sizes or group_sizes(df, by)
    narrow = df.select(*by, value)
    if groups > MANY_GROUPS and largest > 2 * rows_per_slot:
        big, rest, n_big = _by_group_size(narrow, by, 2 * rows_per_slot)
        cut = _counted_in_slots(big, value, by, _slot_count(largest, n_big, rows_per_slot, by), positions)
        counted = cut.unionByName(_counted_in_groups(rest, value, by))
    else:
        slots = _slot_count(largest, groups, rows_per_slot, by)
        if slots == 1:
            counted = _counted_in_groups(narrow, value, by)
        else:
            counted = _counted_in_slots(narrow, value, by, slots, positions)
    inside = F.filter(
        positions(F.col("group_rows")),
        lambda p: (p >= F.col("min_rank")) & (p < F.col("min_rank") + F.col("ties")),
    )
    return counted.select(*by, F.explode(F.array_distinct(inside)).alias("position"), value, "group_rows")


def _first_rank(before: Column | int, group: WindowSpec, value: str) -> Column:
    """Rank of the first row of each distinct value, from the values' counts."""
    upto = F.sum("ties").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return before + upto - F.col("ties") + 1


def _counted_in_groups(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., value, min_rank, ties, group_rows) per distinct value."""
    group = Window.partitionBy(*by)
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"))
    rank = _first_rank(F.lit(0), group, value).alias("min_rank")
    return counted.select(*by, value, rank, "ties", F.sum("ties").over(group).alias("group_rows"))


def _counted_in_slots(
    df: DataFrame, value: str, by: list[str], slots: int, positions: Callable[[Column], Column]
) -> DataFrame:
    """The same for the values of slots that hold a wanted position."""
    placed = _place(df, by, value, slots)
    offsets = _slot_offsets(placed, by)
    first, last = F.col(_BEFORE) + 1, F.col(_BEFORE) + F.col(_SIZE)
    wanted = offsets.where(F.exists(positions(F.col("group_rows")), lambda p: (p >= first) & (p <= last)))
    rows = placed.join(F.broadcast(wanted), [*by, _SLOT])
    counted = rows.groupBy(*by, _SLOT, _BEFORE, "group_rows", value).agg(F.count(F.lit(1)).alias("ties"))
    rank = _first_rank(F.col(_BEFORE), Window.partitionBy(*by, _SLOT), value).alias("min_rank")
    return counted.select(*by, value, rank, "ties", "group_rows")


def quantiles(
    df: DataFrame,
    value: str,
    shares: dict[str, float],
    by: list[str] | None = None,
    **options,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``shares``."""
    by = by or []

    def target(n: Column, share: float) -> Column:
        return F.lit(share) * (n - 1)

    def positions(n: Column) -> Column:
        ends = []
        for share in shares.values():
            at = target(n, share)
            ends += [F.floor(at).cast("long") + 1, F.ceil(at).cast("long") + 1]
        return F.array_distinct(F.array(*ends))

    found = values_at(df, value, positions, by, **options)
    columns = []
    for name, share in shares.items():
        at = target(F.col("group_rows"), share)
        low = F.max(F.when(F.col("position") == F.floor(at) + 1, F.col(value)))
        high = F.max(F.when(F.col("position") == F.ceil(at) + 1, F.col(value)))
        weight = F.max(at - F.floor(at))
        columns.append((low + (high - low) * weight).alias(name))
    return found.groupBy(*by).agg(*columns)

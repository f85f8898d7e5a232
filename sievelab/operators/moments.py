"""Cross-moments of packed rows: the one data pass behind every linear model.

Least squares, the lasso and their R2 on any set of rows depend on the rows only through counts, sums and
products. Those are summed once per row group (split x fold), in tiles of the matrix per Arrow batch; a p-feature job then
needs (p + 2)(p + 3)/2 numbers per group, whatever the number of rows, of which a task holds a bounded part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RCOND = 1e-10
TILE = 256  # rows and columns of a tile of a moment matrix
HELD_BYTES = 64 << 20  # of tiles that a task sums before it hands them on
SLICE_BYTES = 16 << 20  # of rows multiplied at once
SALTS = 32  # sums of one tile in the middle stage
TILE_COLUMNS = ["grp", "width", "top", "left", "cells"]


def tile_corners(width: int) -> list[tuple[int, int]]:
    """First row and column of each tile on or above the diagonal."""
    return [(i, j) for i in range(0, width, TILE) for j in range(i, width, TILE)]


def tile_sums(
    batches: Iterable[pa.RecordBatch], keys: list[str], part: int = 0, parts: int = 1, held_bytes: int = HELD_BYTES
) -> Iterator[pa.RecordBatch]:
    """(keys..., grp, width, top, left, cells): tiles of sum(a a') with a = (1, y, x...), summed as far as they are held.

    Sums are given out and forgotten once they fill ``held_bytes``, so a label may come in several rows. Of every
    ``parts`` tiles only those with remainder ``part`` are made.
    """
    sums: dict[tuple, np.ndarray] = {}
    held = 0

    def flushed() -> pa.RecordBatch:
        *labels, grp, width, top, left = zip(*sums, strict=True)
        columns = [pa.array(label, pa.string()) for label in labels]
        columns += [pa.array(c, pa.int32()) for c in (grp, width, top, left)]
        columns.append(pa.array([m.ravel() for m in sums.values()], pa.list_(pa.float64())))
        return pa.RecordBatch.from_arrays(columns, names=[*keys, *TILE_COLUMNS])

    for whole in batches:
        if whole.num_rows == 0:
            continue
        width = 2 + len(whole.column("x").flatten()) // whole.num_rows
        rows_at_once = max(1, SLICE_BYTES // (8 * width))
        for start in range(0, whole.num_rows, rows_at_once):
            batch = whole.slice(start, rows_at_once)
            n = batch.num_rows
            a = np.empty((n, width))
            a[:, 0] = 1.0
            a[:, 1] = np.asarray(batch.column("y"), dtype=np.float64)
            a[:, 2:] = np.asarray(batch.column("x").flatten(), dtype=np.float64).reshape(n, -1)
            codes = np.asarray(batch.column("grp"))
            names = [batch.column(k).to_pylist() for k in keys]
            owners = [np.asarray(batch.column(k).dictionary_encode("encode").indices) for k in keys]
            _, first, member = np.unique(np.stack([*owners, codes], axis=1), axis=0, return_index=True, return_inverse=True)
            order = np.argsort(member.ravel(), kind="stable")
            ends = np.cumsum(np.bincount(member.ravel()))
            for row, low, high in zip(first, [0, *ends[:-1]], ends, strict=True):
                label = (*(column[row] for column in names), int(codes[row]), width)
                rows = a if high - low == n else a[order[low:high]]
                for top, left in tile_corners(width)[part::parts]:
                    tile = rows[:, top : top + TILE].T @ rows[:, left : left + TILE]
                    key = (*label, top, left)
                    if key in sums:
                        sums[key] += tile
                        continue
                    sums[key] = tile
                    held += tile.nbytes
                    if held >= held_bytes:
                        yield flushed()
                        sums, held = {}, 0
    if sums:
        yield flushed()


def tile_cells(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """(keys..., grp, i, j, pos, value) of tiles whose parts come one after the other, for the cells with i <= j."""
    names = [*keys, "grp", "i", "j", "pos", "value"]

    def cells(label: tuple, total: np.ndarray) -> pa.RecordBatch:
        *owner, grp, width, top, left = label
        total = total.reshape(min(TILE, width - top), -1)
        i, j = np.indices(total.shape)
        upper = i + top <= j + left
        i, j, values = (i + top)[upper], (j + left)[upper], total[upper]
        columns = [pa.array([o] * len(values), pa.string()) for o in owner]
        numbers = (np.full(len(values), grp), i, j, i * width - i * (i - 1) // 2 + j - i)
        columns += [pa.array(c.astype(np.int32)) for c in numbers]
        return pa.RecordBatch.from_arrays([*columns, pa.array(values)], names=names)

    last: tuple | None = None
    total = np.zeros(0)
    ready: list[pa.RecordBatch] = []
    for batch in batches:
        labels = zip(*(batch.column(c).to_pylist() for c in (*keys, *TILE_COLUMNS[:-1])), strict=True)
        for row, label in enumerate(labels):
            part = np.asarray(batch.column("cells")[row].values)
            if label == last:
                total += part
                continue
            if last is not None:
                ready.append(cells(last, total))
            last, total = label, part.copy()
            if sum(r.num_rows for r in ready) >= TILE * TILE:
                yield from ready
                ready = []
    if last is not None:
        ready.append(cells(last, total))
    yield from ready


def _cell_parts(
    packed: DataFrame, group: Column | None, y: str, x: str, keys: list[str], width: int | None
) -> DataFrame:
    """(keys..., grp, i, j, pos, value) with at most ``SALTS`` rows a cell.

    Tasks sum tiles of a matrix and hold at most HELD_BYTES of them; rows come sorted by their label, so that each label's
    tiles are mostly complete when they leave. Beyond that size the tiles are made in several passes over the rows, for which
    ``width``, the number of features, must be known. A middle stage sums the tiles of many tasks.
    """
    narrow = packed.select(
        *[F.col(k).cast("string").alias(k) for k in keys],
        (group if group is not None else F.lit(0)).cast("int").alias("grp"),
        F.col(y).cast("double").alias("y"),
        F.col(x).alias("x"),
    )
    if keys or group is not None:
        narrow = narrow.sortWithinPartitions(*keys, "grp")
    fields = "".join(f"`{k}` string, " for k in keys)
    parts = 1 if width is None else max(1, -(-len(tile_corners(width + 2)) * 8 * TILE * TILE // HELD_BYTES))
    tiles = None
    for part in range(parts):
        made = narrow.mapInArrow(
            lambda batches, part=part: tile_sums(batches, keys, part, parts),
            f"{fields}grp int, width int, top int, left int, cells array<double>",
        )
        tiles = made if tiles is None else tiles.unionByName(made)
    place = [*keys, *TILE_COLUMNS[:-1]]
    dealt = tiles.withColumn("__salt", F.spark_partition_id() % SALTS).repartition(*place, "__salt")
    ordered = dealt.sortWithinPartitions(*place).drop("__salt")
    return ordered.mapInArrow(
        lambda batches: tile_cells(batches, keys), f"{fields}grp int, i int, j int, pos int, value double"
    )


def moment_cells(
    packed: DataFrame,
    group: Column | None = None,
    y: str = "y",
    x: str = "x",
    keys: list[str] | None = None,
    width: int | None = None,
) -> DataFrame:
    """(keys..., grp, pos, value): upper triangle of sum(a a') with a = (1, y, x...), one matrix per group.

    ``group`` is an integer column. ``keys`` are string columns that identify a job, when many jobs share a table; any
    number of jobs and groups takes the same memory. ``width`` is the number of features, if known.
    """
    keys = keys or []
    cells = _cell_parts(packed, group, y, x, keys, width)
    return cells.groupBy(*keys, "grp", "pos").agg(F.sum("value").alias("value"))


def gram_matrix(packed: DataFrame, names: list[str]) -> DataFrame:
    """(var_i, var_j, value): sum of products of every ordered feature pair."""
    parts = _cell_parts(packed.withColumn("y", F.lit(0.0)), None, "y", "x", [], len(names))
    cells = parts.where("i >= 2").groupBy("i", "j").agg(F.sum("value").alias("value"))
    labels = packed.sparkSession.createDataFrame([(p + 2, n) for p, n in enumerate(names)], "p int, name string")
    for place, alias in (("i", "var_i"), ("j", "var_j")):  # one row per feature
        cells = cells.join(F.broadcast(labels.select(F.col("p").alias(place), F.col("name").alias(alias))), place)
    upper = cells.select("var_i", "var_j", "value", "i", "j")
    both = F.array(F.struct("var_i", "var_j"), F.struct(F.col("var_j").alias("var_i"), F.col("var_i").alias("var_j")))
    ordered = upper.select(F.explode(F.when(F.col("i") == F.col("j"), F.slice(both, 1, 1)).otherwise(both)).alias("p"), "value")
    return ordered.select("p.var_i", "p.var_j", "value")


def cross_sums(
    batches: Iterable[pa.RecordBatch], left: list[int], slice_bytes: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """(cells): a task's sums of squares of (y, x...), then of the products of y and of each ``left`` feature with them."""
    total: np.ndarray | None = None
    for whole in batches:
        if whole.num_rows == 0:
            continue
        width = 1 + len(whole.column("x").flatten()) // whole.num_rows
        rows_at_once = max(1, slice_bytes // (8 * width))
        for start in range(0, whole.num_rows, rows_at_once):
            batch = whole.slice(start, rows_at_once)
            a = np.empty((batch.num_rows, width))
            a[:, 0] = np.asarray(batch.column("y"), dtype=np.float64)
            a[:, 1:] = np.asarray(batch.column("x").flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            made = np.vstack([np.einsum("ij,ij->j", a, a), a[:, [0, *(p + 1 for p in left)]].T @ a])
            total = made if total is None else total + made
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["cells"])


def cross_moments(packed: DataFrame, left: list[int], width: int) -> DataFrame:
    """(i, j, value): sums of products of column j of (y, x...) with itself (i = 0), with y (i = 1) and with each feature of
    ``left`` (i = 2 on). A task holds len(left) + 2 rows of ``width`` + 1 numbers."""
    made = packed.select(F.col("y").cast("double").alias("y"), "x").mapInArrow(
        lambda batches: cross_sums(batches, left), "cells array<double>"
    )
    cells = made.select(F.posexplode("cells").alias("pos", "value")).groupBy("pos").agg(F.sum("value").alias("value"))
    d = F.lit(width + 1)
    return cells.select(F.floor(F.col("pos") / d).cast("int").alias("i"), (F.col("pos") % d).alias("j"), "value")


@dataclass(frozen=True)
class Moments:
    """Sums over one group of rows."""

    n: float
    sy: float
    syy: float
    sx: np.ndarray
    xy: np.ndarray
    xx: np.ndarray

    @staticmethod
    def from_triangle(upper: np.ndarray) -> "Moments":
        d = int(round((np.sqrt(8 * len(upper) + 1) - 1) / 2))
        full = np.zeros((d, d))
        full[np.triu_indices(d)] = upper
        full = full + np.triu(full, 1).T
        n, sy, syy = float(full[0, 0]), float(full[0, 1]), float(full[1, 1])
        return Moments(n, sy, syy, full[0, 2:], full[1, 2:], full[2:, 2:])

    def __add__(self, other: "Moments") -> "Moments":
        return Moments(
            self.n + other.n,
            self.sy + other.sy,
            self.syy + other.syy,
            self.sx + other.sx,
            self.xy + other.xy,
            self.xx + other.xx,
        )

    def rescaled(self, divisor: np.ndarray) -> "Moments":
        """Moments after dividing each feature by a constant."""
        return Moments(
            self.n, self.sy, self.syy, self.sx / divisor, self.xy / divisor, self.xx / np.outer(divisor, divisor)
        )

    def take(self, columns: list[int]) -> "Moments":
        at = np.asarray(columns, dtype=int)
        return Moments(self.n, self.sy, self.syy, self.sx[at], self.xy[at], self.xx[np.ix_(at, at)])

    @property
    def norms(self) -> np.ndarray:
        """Euclidean norm of each feature over the rows."""
        norm = np.sqrt(np.diag(self.xx))
        return np.where(norm > 0, norm, 1.0)

    def r2(self, coefficients: np.ndarray, intercept: float = 0.0) -> float:
        """1 - SSE / SST, SST about the mean of these rows."""
        sse = (
            self.syy
            - 2 * intercept * self.sy
            - 2 * coefficients @ self.xy
            + self.n * intercept**2
            + 2 * intercept * (coefficients @ self.sx)
            + coefficients @ self.xx @ coefficients
        )
        sst = self.syy - self.sy**2 / self.n
        if sst <= 0:
            return 1.0 if sse <= 0 else 0.0
        return float(1.0 - sse / sst)


def total(parts: Iterable[Moments]) -> Moments:
    first, *rest = parts
    for part in rest:
        first = first + part
    return first


def collect_moments(cells: DataFrame) -> dict[int, Moments]:
    """Group code -> moments. Size is fixed by the number of features and groups, not by rows."""
    rows = cells.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("c"))
    return {
        r["grp"]: Moments.from_triangle(np.array([cell["value"] for cell in r["c"]])) for r in rows.collect()
    }


def ols(m: Moments, columns: list[int]) -> tuple[np.ndarray, float]:
    """Least squares without intercept on the named columns, and its R2 on the same rows.

    Rank-deficient sets get the minimum-norm solution. With no more rows than columns the fit is exact.
    """
    part = m.take(columns)
    coefficients = np.linalg.pinv(part.xx, rcond=RCOND, hermitian=True) @ part.xy
    if len(set(columns)) >= m.n:
        return coefficients, 1.0
    return coefficients, part.r2(coefficients)


def univariate_r2(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per variable (and ``by``): slope and R2 of the one-feature fit without intercept; null without spread.

    ``long`` holds (variable, value, y).
    """
    v, y = F.col("value"), F.col("y")
    sums = long.groupBy(*(by or []), "variable").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(v * y).alias("xy"),
        F.sum(v * v).alias("xx"),
        F.sum(y * y).alias("yy"),
        F.sum(y).alias("sy"),
    )
    slope = F.try_divide(F.col("xy"), F.col("xx"))
    explained = F.try_divide(F.col("xy") * F.col("xy"), F.col("xx"))
    spread = F.col("yy") - F.col("sy") * F.col("sy") / F.col("n")
    return sums.select(
        *(by or []),
        "variable",
        "n",
        slope.alias("slope"),
        (F.lit(1.0) - F.try_divide(F.col("yy") - explained, spread)).alias("r2"),
    )


def soft_threshold_path(long: DataFrame, alphas: DataFrame) -> DataFrame:
    """One-feature lasso without intercept for every variable and penalty: (variable, alpha step, coefficient).

    ``alphas`` is a penalty grid; it is attached to one row per variable, after the sums.
    """
    grid = alphas.agg(F.sort_array(F.collect_list(F.struct("step", "alpha"))).alias("grid"))
    v, y = F.col("value"), F.col("y")
    sums = long.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n"), F.sum(v * y).alias("xy"), F.sum(v * v).alias("xx")
    )
    points = sums.withColumn("a", F.explode(grid.scalar()))
    shrunk = F.greatest(F.abs("xy") - F.col("n") * F.col("a.alpha"), F.lit(0.0))
    return points.select(
        "variable", F.col("a.step").alias("step"), F.try_divide(F.signum("xy") * shrunk, F.col("xx")).alias("coef")
    )

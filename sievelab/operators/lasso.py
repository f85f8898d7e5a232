"""Lasso from cross-moments: all penalties after one data pass."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelab.operators.moments import Moments

TOLERANCE = 5e-4
MAX_SWEEPS = 1000


class Fit(NamedTuple):
    weights: np.ndarray
    gap: float  # how far the objective may be above its minimum, relative to y'y
    sweeps: int
    converged: bool


def descend(
    gram: np.ndarray,
    xy: np.ndarray,
    yy: float,
    penalty: float,
    tol: float = TOLERANCE,
    sweeps: int = MAX_SWEEPS,
    start: np.ndarray | None = None,
    columns: np.ndarray | None = None,
) -> Fit:
    """Minimise |y - Xw|^2 / 2 + penalty |w|_1 given X'X, X'y and y'y.

    Cyclic updates of ``columns`` (all, if not given) from ``start`` (or zero). Once a sweep moves no weight by more than ``tol``
    (relative), the duality gap over all columns decides: the fit has converged when it is below tol x y'y.
    """
    w = np.zeros(len(xy)) if start is None else start.copy()
    fitted = gram @ w
    scale = np.diag(gram)
    moved = np.flatnonzero(scale > 0) if columns is None else columns[scale[columns] > 0]
    gap, sweep = np.inf, 0
    for sweep in range(sweeps):
        largest_move = largest_weight = 0.0
        for j in moved:
            before = w[j]
            gradient = xy[j] - fitted[j] + scale[j] * before
            after = np.sign(gradient) * max(abs(gradient) - penalty, 0.0) / scale[j]
            if after != before:
                fitted += (after - before) * gram[j]
                w[j] = after
            largest_move = max(largest_move, abs(after - before))
            largest_weight = max(largest_weight, abs(after))
        if largest_weight == 0 or largest_move / largest_weight < tol or sweep == sweeps - 1:
            gap = _duality_gap(w, fitted, xy, yy, penalty)
            # a column that is left out keeps the gap open, and more sweeps would not close it
            if gap < tol * yy or (columns is not None and largest_move <= 1e-3 * tol * largest_weight):
                break
    share = gap / yy if yy > 0 else 0.0
    return Fit(w, share, sweep + 1, bool(gap < tol * yy or yy <= 0))


def coordinate_descent(
    gram: np.ndarray, xy: np.ndarray, yy: float, penalty: float, tol: float = TOLERANCE, sweeps: int = MAX_SWEEPS
) -> np.ndarray:
    """Weights of a fit from zero over all columns."""
    return descend(gram, xy, yy, penalty, tol, sweeps).weights


def _duality_gap(w: np.ndarray, fitted: np.ndarray, xy: np.ndarray, yy: float, penalty: float) -> float:
    residual = yy - 2 * w @ xy + w @ fitted
    steepest = np.max(np.abs(xy - fitted), initial=0.0)
    shrink = penalty / steepest if steepest > penalty else 1.0
    return 0.5 * residual * (1 + shrink**2) + penalty * np.abs(w).sum() - shrink * (yy - w @ xy)


def path_fits(
    gram: np.ndarray, xy: np.ndarray, yy: float, penalties: list[float], tol: float = TOLERANCE, sweeps: int = MAX_SWEEPS
) -> list[Fit]:
    """Fits for descending ``penalties``, each from the one before.

    Columns are screened by the sequential strong rule: with the last fit's gradient c at the last penalty k, a column with
    |c_j| < 2 penalty - k is left out at first. Its optimality condition |c_j| <= penalty is checked after the fit, and columns
    that break it are taken up until none does, so the rule can only save time.
    """
    found: list[Fit] = []
    w, last = np.zeros(len(xy)), float(np.max(np.abs(xy), initial=0.0))
    for penalty in penalties:
        if found and penalty > last:
            raise ValueError("penalties must descend")
        gradient = np.abs(xy - gram @ w)
        taken = (gradient >= 2 * penalty - last) | (w != 0)
        spent = 0
        while True:
            fit = descend(gram, xy, yy, penalty, tol, sweeps, w, np.flatnonzero(taken))
            w, spent = fit.weights, spent + fit.sweeps
            broken = (np.abs(xy - gram @ w) > penalty * (1 + 1e-9)) & ~taken
            if fit.converged or not broken.any():
                break
            taken |= broken
        found.append(fit._replace(sweeps=spent))
        last = penalty
    return found


def fit_lasso(
    m: Moments, alpha: float, intercept: bool, tol: float = TOLERANCE, sweeps: int = MAX_SWEEPS
) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) of the lasso with objective |y - Xw|^2 / (2n) + alpha |w|_1."""
    gram, xy, yy = _problem(m, intercept)
    w = coordinate_descent(gram, xy, yy, alpha * m.n, tol, sweeps)
    return w, float((m.sy - w @ m.sx) / m.n) if intercept else 0.0


def _problem(m: Moments, intercept: bool) -> tuple[np.ndarray, np.ndarray, float]:
    if not intercept:
        return m.xx, m.xy, m.syy
    return m.xx - np.outer(m.sx, m.sx) / m.n, m.xy - m.sx * m.sy / m.n, m.syy - m.sy**2 / m.n


PATH_SCHEMA = "alpha double, train_score double, test_score double, n_nonzero int, converged boolean, gap double, sweeps int"


def lasso_path(
    spark: SparkSession, train: Moments, test: Moments, alphas: list[float], tol: float = TOLERANCE, sweeps: int = MAX_SWEEPS
) -> DataFrame:
    """(alpha, train_score, test_score, n_nonzero, converged, gap, sweeps) per penalty, fitted with intercept on the training moments.

    A task walks down a run of neighbouring penalties, each fit from the last; the two moment matrices go to every task.
    ``converged`` is false where the sweeps ran out before the duality gap closed.
    """
    ordered = sorted({float(a) for a in alphas}, reverse=True)
    runs = max(1, min(len(ordered), spark.sparkContext.defaultParallelism))
    grid = [(i * runs // len(ordered), a) for i, a in enumerate(ordered)]
    dealt = spark.createDataFrame(grid, "run int, alpha double").repartition(runs, "run").sortWithinPartitions("run", F.desc("alpha"))
    names = [c.split()[0] for c in PATH_SCHEMA.split(", ")]

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, xy, yy = _problem(train, True)
        for frame in frames:
            rows = []
            for _, part in frame.groupby("run", sort=False):
                walk = part["alpha"].tolist()
                for alpha, found in zip(walk, path_fits(gram, xy, yy, [a * train.n for a in walk], tol, sweeps), strict=True):
                    w = found.weights
                    b = float((train.sy - w @ train.sx) / train.n)
                    rows.append((alpha, train.r2(w, b), test.r2(w, b), int(np.count_nonzero(w)), found.converged, found.gap, found.sweeps))
            yield pd.DataFrame(rows, columns=names)

    return dealt.mapInPandas(fit, PATH_SCHEMA)


def lasso_select(spark: SparkSession, m: Moments, names: list[str], alpha: float, tol: float = TOLERANCE) -> DataFrame:
    """(variable, score, abs_score) with non-zero score: the lasso without intercept on all rows, fitted in a task."""

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in frame["alpha"]:
                w, _ = fit_lasso(m, a, False, tol)
                kept = np.flatnonzero(w)
                if len(kept):
                    yield pd.DataFrame({"variable": [names[i] for i in kept], "score": w[kept], "abs_score": np.abs(w[kept])})

    one = spark.createDataFrame([(float(alpha),)], "alpha double").coalesce(1)
    return one.mapInPandas(fit, "variable string, score double, abs_score double")

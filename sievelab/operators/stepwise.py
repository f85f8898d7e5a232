"""Forward selection by k-fold adjusted R2, on the cross-moments of each fold.

The moments are swept on every feature that enters the model: the swept matrix holds the model's coefficients, its squared error and,
for every feature outside, what is left of it. All candidates of a step are scored from that in one vector operation, and
entering a feature costs one rank-one update of each fold's matrix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelab.operators.moments import RCOND, Moments, ols, total
from sievelab.operators.ranking import argmax

MIN_ROWS_FOR_FOLDS = 30
PATIENCE = 10
TRACE_SCHEMA = (
    "step int, n_var int, var_included array<string>, coefs array<double>, adj_r2 double, kfold_adj_r2 double"
)


def adjusted(r2: float, n: float, p: int) -> float:
    return 1.0 - (1.0 - r2) * (n - 1) / (n - p - 1)


def model_score(m: Moments, columns: list[int], penalty: str = "single") -> float:
    """Adjusted R2 of the least-squares model on the given columns, fitted and scored on the same rows."""
    _, r2 = ols(m, columns)
    p = 1 if penalty == "single" else len(set(columns))
    return r2 if m.n - p - 1 <= 0 else adjusted(r2, m.n, p)


class Swept:
    """Moments swept on the features of a model without intercept.

    A feature that the model's features explain (what is left of its sum of squares is below RCOND of the whole) adds nothing and is not
    swept; ``dependent`` then tells that the coefficients are not unique.
    """

    def __init__(self, m: Moments):
        p = len(m.xy)
        self.a = np.empty((p + 1, p + 1))
        self.a[:p, :p], self.a[:p, p], self.a[p, :p], self.a[p, p] = m.xx, m.xy, m.xy, m.syy
        self.least = RCOND * np.diag(m.xx)
        self.n, self.spread = m.n, m.syy - m.sy**2 / m.n
        self.inside: list[int] = []
        self.dependent = False

    def gains(self) -> np.ndarray:
        """By how much each feature outside the model would lower the squared error."""
        left = np.diag(self.a)[:-1]
        free = left > self.least
        free[self.inside] = False
        return np.where(free, self.a[:-1, -1] ** 2 / np.where(free, left, 1.0), 0.0)

    def add(self, column: int) -> None:
        a, pivot = self.a, self.a[column, column]
        self.inside.append(column)
        if pivot <= self.least[column]:
            self.dependent = True
            return
        row, below = a[column] / pivot, a[:, column].copy()
        a -= np.outer(below, row)
        a[column], a[:, column] = row, -below / pivot
        a[column, column] = 1.0 / pivot

    def scores(self, gains: np.ndarray, size: int, penalty: str) -> np.ndarray:
        """Adjusted R2 of models of ``size`` features whose squared error is lower by ``gains``."""
        error = self.a[-1, -1] - gains
        if size >= self.n:
            r2 = np.ones(len(gains))
        elif self.spread <= 0:
            r2 = np.where(error <= 0, 1.0, 0.0)
        else:
            r2 = 1.0 - error / self.spread
        p = 1 if penalty == "single" else size
        return r2 if self.n - p - 1 <= 0 else 1.0 - (1.0 - r2) * (self.n - 1) / (self.n - p - 1)

    def score(self, penalty: str) -> float:
        return float(self.scores(np.zeros(1), len(self.inside), penalty)[0])


def candidate_scores(
    m: Moments, names: list[str], included: list[str], penalty: str = "single"
) -> list[tuple[str, float]]:
    """Score of ``included`` plus each remaining feature, in name order."""
    place = {name: i for i, name in enumerate(names)}
    swept = Swept(m)
    for c in included:
        swept.add(place[c])
    scores = swept.scores(swept.gains(), len(included) + 1, penalty)
    return [(c, float(scores[place[c]])) for c in sorted(set(names) - set(included))]


def forward_trace(
    folds: list[Moments], names: list[str], tol: float = 0.0, patience: int = PATIENCE, penalty: str = "single"
) -> list[tuple]:
    """Recorded steps of one job.

    ``penalty="single"`` counts one parameter in the adjustment whatever the model's size. Both scores can then only
    rise, so the search normally adds every candidate; ``"n_vars"`` is the textbook count. A fold's score is that of
    the model fitted and scored on the fold itself. The step that ends the search is not recorded.
    """
    if penalty not in ("single", "n_vars"):
        raise ValueError(f"unknown penalty {penalty!r}")
    everything = total(folds)
    place = {name: i for i, name in enumerate(names)}
    whole = Swept(everything)
    parts = [Swept(fold) for fold in folds] if everything.n >= MIN_ROWS_FOR_FOLDS else [whole]

    included: list[str] = []
    rest = sorted(set(names))
    best_adjusted = best_kfold = -np.inf
    strikes = 0
    trace: list[tuple] = []
    while rest:
        columns = [place[c] for c in rest]
        scores = whole.scores(whole.gains(), len(included) + 1, penalty)[columns]
        top = int(np.argmax(scores))
        if not scores[top] - best_adjusted > tol:
            break
        candidate, best_adjusted = rest.pop(top), float(scores[top])
        for swept in {id(s): s for s in (whole, *parts)}.values():
            swept.add(place[candidate])
        included = [*sorted(included), candidate]
        kfold = float(np.mean([part.score(penalty) for part in parts]))
        if kfold > best_kfold:
            best_kfold = kfold
        else:
            strikes += 1
        if strikes == patience:
            break
        at = [place[c] for c in included]
        coefs = ols(everything, at)[0] if whole.dependent else whole.a[at, -1]
        trace.append((len(trace), len(included), list(included), coefs.tolist(), best_adjusted, kfold))
    return trace


def _per_job(cells: DataFrame, keys: list[str] | None, work, schema: str) -> DataFrame:
    """Applies ``work`` to each job's moments by fold, in tasks; its rows get the job's keys. Jobs run in parallel.

    A job's input is its fold matrices, so its size depends on features and folds only.
    """
    keys = keys or []
    fields = "".join(f"`{k}` string, " for k in keys)
    grouped = cells.withColumn("__job", F.lit(0)) if not keys else cells
    columns = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        folds = [
            Moments.from_triangle(part.sort_values("pos")["value"].to_numpy())
            for _, part in frame.sort_values("grp").groupby("grp")
        ]
        found = pd.DataFrame(work(folds), columns=columns)
        for i, key in enumerate(keys):
            found.insert(i, key, frame[key].iloc[0])
        return found

    return grouped.groupBy(*(keys or ["__job"])).applyInPandas(run, fields + schema)


def step_forward(
    cells: DataFrame,
    names: list[str],
    keys: list[str] | None = None,
    tol: float = 0.0,
    patience: int = PATIENCE,
    penalty: str = "single",
    normalise: bool = True,
) -> DataFrame:
    """Trace of every job in ``cells``: (keys..., grp = fold, pos, value) as made by ``moment_cells``.

    ``normalise`` first divides each feature by its norm over all rows.
    """

    def search(folds: list[Moments]) -> list[tuple]:
        if normalise:
            norms = total(folds).norms
            folds = [fold.rescaled(norms) for fold in folds]
        return forward_trace(folds, names, tol, patience, penalty)

    return _per_job(cells, keys, search, TRACE_SCHEMA)


def first_scores(cells: DataFrame, names: list[str], keys: list[str] | None = None, penalty: str = "single") -> DataFrame:
    """(keys..., variable, adj_r2) of every one-feature model of every job."""
    return _per_job(cells, keys, lambda folds: candidate_scores(total(folds), names, [], penalty), "variable string, adj_r2 double")


def model_qualities(cells: DataFrame, models: dict[str, np.ndarray], keys: list[str] | None = None) -> DataFrame:
    """(keys..., model, r2, adj_r2) of given coefficients on every job's rows."""

    def score(folds: list[Moments]) -> list[tuple]:
        return [(name, *model_quality(total(folds), weights)) for name, weights in models.items()]

    return _per_job(cells, keys, score, "model string, r2 double, adj_r2 double")


def best_model(trace: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys..., variable, score, abs_score) of the step with the highest k-fold score, earliest on ties."""
    best = argmax(trace, "kfold_adj_r2", ["step"], keys)
    terms = best.select(*(keys or []), F.explode(F.arrays_zip("var_included", "coefs")).alias("t"))
    return terms.select(
        *(keys or []),
        F.col("t.var_included").alias("variable"),
        F.col("t.coefs").alias("score"),
        F.abs("t.coefs").alias("abs_score"),
    ).orderBy(*(keys or []), F.desc("abs_score"), "variable")


def model_quality(m: Moments, coefficients: np.ndarray) -> tuple[float, float]:
    """(R2, R2 adjusted by the number of non-zero coefficients) of a model without intercept."""
    r2 = m.r2(coefficients)
    p = int(np.count_nonzero(coefficients))
    return r2, r2 if m.n - p - 1 <= 0 else adjusted(r2, m.n, p)

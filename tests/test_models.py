import itertools
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievelab.operators import forest, lasso, moments, sampling, stepwise
from sievelab.operators.moments import Moments


def moments_of(x, y):
    a = np.column_stack([np.ones(len(y)), y, x])
    return Moments.from_triangle((a.T @ a)[np.triu_indices(a.shape[1])])


def planted(n, p, seed=0, noise=0.5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    y = 2 * x[:, 0] - x[:, 1] + noise * rng.normal(size=n)
    return x, y - y.mean()


def packed(spark, x, y, extra=None):
    rows = [(i, float(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id long, y double, x array<double>")


def test_moments_by_group_match_numpy(spark):
    x, y = planted(300, 6)
    df = packed(spark, x, y).repartition(5)
    parts = moments.collect_moments(moments.moment_cells(df, (F.col("row_id") % 3).cast("int")))
    for g in range(3):
        want = moments_of(x[g::3], y[g::3])
        assert parts[g].n == want.n
        for name in ("sx", "xy", "xx"):
            assert np.allclose(getattr(parts[g], name), getattr(want, name), rtol=1e-12, atol=1e-10)


def test_moments_by_job(spark):
    x, y = planted(200, 4)
    df = packed(spark, x, y).withColumn("job", F.concat(F.lit("j"), F.col("row_id") % 2))
    cells = moments.moment_cells(df, sampling.fold_of([99]), keys=["job"])
    trace = stepwise.step_forward(cells, ["a", "b", "c", "d"], keys=["job"], normalise=False).toPandas()
    for j in range(2):
        rows = np.arange(200)[j::2]
        folds = [moments_of(x[part], y[part]) for part in (rows[rows <= 99], rows[rows > 99])]
        want = stepwise.forward_trace(folds, ["a", "b", "c", "d"])
        got = trace[trace.job == f"j{j}"].sort_values("step")
        assert got.var_included.map(list).tolist() == [t[2] for t in want]
        assert np.allclose(got.kfold_adj_r2, [t[5] for t in want])


def test_tiles_of_wide_matrices_by_parts_and_flushes(spark):
    x, y = planted(40, 600, seed=3)
    df = packed(spark, x, y).repartition(3)
    want = moments_of(x, y)
    for width in (None, 600):
        got = moments.collect_moments(moments.moment_cells(df, width=width))[0]
        assert np.allclose(got.xx, want.xx, atol=1e-9) and np.allclose(got.xy, want.xy) and np.allclose(got.sx, want.sx)
    rows = pa.RecordBatch.from_pydict({"grp": pa.array([0] * 40, pa.int32()), "y": y, "x": x.tolist()})
    made = [list(moments.tile_sums([rows] * 2, [], part, 2, held_bytes=1 << 20)) for part in range(2)]
    parts = sorted((t for part in made for b in part for t in b.to_pylist()), key=lambda t: (t["top"], t["left"]))
    assert len(parts) > 6 and sum(map(len, made)) > 2  # three strips, some tiles twice
    batch = pa.RecordBatch.from_pylist(parts, schema=made[0][0].schema)
    cells = pa.Table.from_batches(moments.tile_cells([batch.slice(0, 5), batch.slice(5)], [])).sort_by("pos")
    assert cells["pos"].to_pylist() == list(range(602 * 603 // 2))
    assert np.allclose(moments.Moments.from_triangle(cells["value"].to_numpy()).xx, 2 * want.xx)


@pytest.mark.parametrize("jobs, width, rows", [(5_000, 30, 2), (1, 5_000, 500)])
def test_moment_tasks_hold_a_bounded_part(jobs, width, rows):
    def batches():
        for start in range(0, jobs, 250):
            names = [f"j{i}" for i in range(start, min(jobs, start + 250)) for _ in range(rows)]
            x = np.random.default_rng(start).normal(size=(len(names), width))
            values = pa.ListArray.from_arrays(np.arange(0, x.size + 1, width, dtype=np.int32), x.ravel())
            codes = pa.array([0] * len(names), pa.int32())
            yield pa.RecordBatch.from_pydict({"job": names, "grp": codes, "y": x[:, 0], "x": values})

    tracemalloc.start()
    seen, tiles = set(), 0
    corners = len(moments.tile_corners(width + 2))
    parts = max(1, -(-corners * 8 * moments.TILE**2 // moments.HELD_BYTES))
    for part in range(parts):
        for batch in moments.tile_sums(batches(), ["job"], part, parts):
            tiles += batch.num_rows
            seen |= set(batch.column("job").to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(seen) == jobs and tiles == jobs * corners
    assert peak < 4 * moments.HELD_BYTES


def test_ols_matches_lstsq_with_duplicated_column():
    x, y = planted(50, 4)
    x = np.column_stack([x, x[:, 0]])
    for columns in ([0], [0, 1, 2], [0, 1, 4], [0, 0, 1]):
        coefficients, r2 = moments.ols(moments_of(x, y), columns)
        want, *_ = np.linalg.lstsq(x[:, columns], y, rcond=None)
        fitted = x[:, columns] @ want
        assert np.allclose(coefficients, want, atol=1e-8)
        assert r2 == pytest.approx(1 - ((y - fitted) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-9)


def test_saturated_fit_is_exact():
    x, y = planted(3, 4)
    assert moments.ols(moments_of(x, y), [0, 1, 2, 3])[1] == 1.0


def test_lasso_on_orthogonal_columns_is_soft_threshold():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(80, 5)))
    y = q @ np.array([3.0, -2.0, 0.4, 0.0, 1.0]) + 0.01 * rng.normal(size=80)
    alpha = 0.005
    w, _ = lasso.fit_lasso(moments_of(q, y), alpha, False, tol=1e-12)
    c = q.T @ y
    assert np.allclose(w, np.sign(c) * np.maximum(np.abs(c) - 80 * alpha, 0), atol=1e-9)


@pytest.mark.parametrize("alpha", [1e-4, 1e-2, 0.3])
@pytest.mark.parametrize("intercept", [True, False])
def test_lasso_optimality(alpha, intercept):
    x, y = planted(120, 8, seed=3)
    x[:, 5] = x[:, 0] + 0.1 * x[:, 5]
    y = y + 4.0
    w, b = lasso.fit_lasso(moments_of(x, y), alpha, intercept, tol=1e-12, sweeps=100_000)
    residual = y - x @ w - b
    gradient = x.T @ residual / len(y)
    active = w != 0
    assert np.allclose(gradient[active], alpha * np.sign(w[active]), atol=1e-6)
    assert (np.abs(gradient[~active]) <= alpha + 1e-6).all()
    if intercept:
        assert residual.mean() == pytest.approx(0, abs=1e-9)


def test_lasso_path_scores(spark):
    x, y = planted(200, 6, seed=4)
    train, test = moments_of(x[:140], y[:140]), moments_of(x[140:], y[140:])
    alphas = [1e-4, 0.05, 5.0]
    got = lasso.lasso_path(spark, train, test, alphas).toPandas().sort_values("alpha").reset_index(drop=True)
    for i, alpha in enumerate(alphas):
        w, b = lasso.fit_lasso(train, alpha, True)
        for rows, column in ((slice(0, 140), "train_score"), (slice(140, 200), "test_score")):
            err = y[rows] - x[rows] @ w - b
            want = 1 - (err**2).sum() / ((y[rows] - y[rows].mean()) ** 2).sum()
            assert got[column][i] == pytest.approx(want, abs=1e-9)
    assert got["n_nonzero"].tolist()[-1] == 0


def test_lasso_select_without_survivors(spark):
    x, y = planted(60, 3)
    assert lasso.lasso_select(spark, moments_of(x, y), ["a", "b", "c"], 100.0).count() == 0


def direct_trace(x, y, names, k, patience, penalty):
    """Forward selection by least squares on the rows themselves."""
    n = len(y)
    place = {c: i for i, c in enumerate(names)}
    bounds = np.cumsum([0, *sampling.fold_sizes(n, k)])
    slices = [slice(a, b) for a, b in itertools.pairwise(bounds)] if n >= 30 else [slice(0, n)]

    def score(rows, chosen):
        at = [place[c] for c in chosen]
        a, b = x[rows][:, at], y[rows]
        w, *_ = np.linalg.lstsq(a, b, rcond=None)
        r2 = 1 - ((b - a @ w) ** 2).sum() / ((b - b.mean()) ** 2).sum()
        p = 1 if penalty == "single" else len(set(chosen))
        return r2 if len(b) - p - 1 <= 0 else 1 - (1 - r2) * (len(b) - 1) / (len(b) - p - 1)

    chosen, best, best_fold, strikes, trace = [], -np.inf, -np.inf, 0, []
    while len(chosen) < len(names):
        rest = sorted(set(names) - set(chosen))
        scores = [score(slice(0, n), [*chosen, c]) for c in rest]
        top = int(np.argmax(scores))
        if scores[top] - best <= 0:
            break
        best = scores[top]
        chosen = [*sorted(chosen), rest[top]]
        fold = np.mean([score(rows, chosen) for rows in slices])
        strikes += not fold > best_fold
        best_fold = max(fold, best_fold)
        if strikes == patience:
            break
        trace.append((list(chosen), scores[top], fold))
    return trace


@pytest.mark.parametrize("penalty", ["single", "n_vars"])
@pytest.mark.parametrize(("n", "p"), [(203, 20), (60, 14), (25, 8)])
def test_forward_trace_matches_direct_least_squares(n, p, penalty):
    x, y = planted(n, p, seed=n, noise=1.5)
    names = [f"v.{i:02d}" for i in range(p)]
    bounds = np.cumsum([0, *sampling.fold_sizes(n, 5)])
    folds = [moments_of(x[a:b], y[a:b]) for a, b in itertools.pairwise(bounds)]
    got = stepwise.forward_trace(folds, names, penalty=penalty)
    want = direct_trace(x, y, names, 5, 10, penalty)
    assert [t[2] for t in got] == [t[0] for t in want]
    assert np.allclose([t[4] for t in got], [t[1] for t in want], atol=1e-8)
    assert np.allclose([t[5] for t in got], [t[2] for t in want], atol=1e-8)


def test_single_penalty_runs_to_exhaustion():
    x, y = planted(203, 12, noise=3.0)
    folds = [moments_of(x[i::5], y[i::5]) for i in range(5)]
    names = [f"v.{i:02d}" for i in range(12)]
    assert len(stepwise.forward_trace(folds, names)) == 12
    assert len(stepwise.forward_trace(folds, names, penalty="n_vars")) < 12


def test_patience_stops_the_search():
    x, y = planted(100, 12, noise=2.0)
    folds = [moments_of(x[i::5], y[i::5]) for i in range(5)]
    names = [f"v.{i:02d}" for i in range(12)]
    assert len(stepwise.forward_trace(folds, names, penalty="n_vars", tol=-1.0, patience=1)) < len(
        stepwise.forward_trace(folds, names, penalty="n_vars", tol=-1.0, patience=5)
    )


def test_unknown_penalty():
    x, y = planted(40, 2)
    with pytest.raises(ValueError):
        stepwise.forward_trace([moments_of(x, y)], ["a", "b"], penalty="other")


def test_best_model_takes_earliest_maximum(spark):
    rows = [
        (0, 1, ["b"], [1.0], 0.1, 0.2),
        (1, 2, ["b", "a"], [1.0, -3.0], 0.2, 0.4),
        (2, 3, ["a", "b", "c"], [1.0, 2.0, 3.0], 0.3, 0.4),
    ]
    got = stepwise.best_model(spark.createDataFrame(rows, stepwise.TRACE_SCHEMA)).collect()
    assert [(r["variable"], r["score"], r["abs_score"]) for r in got] == [("a", -3.0, 3.0), ("b", 1.0, 1.0)]


def test_forest_finds_planted_features(spark):
    x, y = planted(400, 6, seed=8)
    names = [f"v.{i}" for i in range(6)]
    spec = forest.ForestSpec(replicates=2, trees=8, depth=6)
    importances = forest.rf_bootstrap(packed(spark, x, y), names, spec)
    ranked = forest.rank_importance(importances).toPandas()
    assert np.allclose(ranked.groupby("replicate")["importance"].sum(), 1.0)
    frame = ranked.set_index(["replicate", "variable"])
    want = frame.groupby("replicate")["importance"].rank()
    assert np.array_equal(frame["i_rank"], want)
    stats = forest.importance_stats(importances).toPandas()
    assert stats["variable"].tolist()[:2] == ["v.0", "v.1"]
    assert (stats["count"] == 2).all()
    again = forest.rf_bootstrap(packed(spark, x, y), names, spec).toPandas()
    keys = ["replicate", "variable"]
    pd.testing.assert_frame_equal(
        again.sort_values(keys).reset_index(drop=True),
        importances.toPandas().sort_values(keys).reset_index(drop=True),
    )


def test_model_quality_counts_non_zero_coefficients():
    x, y = planted(50, 3)
    r2, adj = stepwise.model_quality(moments_of(x, y), np.array([2.0, -1.0, 0.0]))
    want = 1 - ((y - 2 * x[:, 0] + x[:, 1]) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert r2 == pytest.approx(want) and adj == pytest.approx(1 - (1 - want) * 49 / 47)


def collinear(n, p, seed):
    """Features that repeat, sum up or vanish."""
    x, y = planted(n, p, seed=seed, noise=1.0)
    x[:, 3] = x[:, 1]
    x[:, 4] = x[:, 0] + x[:, 2]
    x[:, 5] = 0.0
    return x, y


def test_swept_scores_equal_least_squares():
    x, y = collinear(90, 9, 5)
    m = moments_of(x, y)
    names = [f"v.{i}" for i in range(9)]
    for included in ([], ["v.0"], ["v.0", "v.2"], ["v.1", "v.3", "v.6"], names[:8]):
        for penalty in ("single", "n_vars"):
            base = [names.index(c) for c in included]
            for c, got in stepwise.candidate_scores(m, names, included, penalty):
                assert got == pytest.approx(stepwise.model_score(m, [*base, names.index(c)], penalty), abs=1e-9)


def test_dependent_features_keep_minimum_norm_coefficients():
    x, y = collinear(90, 9, 6)
    names = [f"v.{i}" for i in range(9)]
    trace = stepwise.forward_trace([moments_of(x[i::3], y[i::3]) for i in range(3)], names, tol=-1.0, patience=99)
    assert len(trace) == 9
    whole = moments_of(x, y)
    for _, _, included, coefs, score, _ in trace:
        at = [names.index(c) for c in included]
        assert np.allclose(coefs, moments.ols(whole, at)[0], atol=1e-7)
        assert score == pytest.approx(stepwise.model_score(whole, at), abs=1e-9)


def test_screened_path_equals_cold_fits():
    x, y = planted(150, 40, seed=7, noise=2.0)
    x[:, 9] = x[:, 2] + 0.05 * x[:, 9]
    m = moments_of(x, y)
    gram, xy, yy = lasso._problem(m, True)
    penalties = [float(v) for v in np.geomspace(np.abs(xy).max() * 1.1, 1e-3, 30)]
    fits = lasso.path_fits(gram, xy, yy, penalties, tol=1e-12, sweeps=200_000)
    assert all(f.converged for f in fits) and not fits[0].weights.any()
    for penalty, fit in zip(penalties, fits, strict=True):
        cold = lasso.coordinate_descent(gram, xy, yy, penalty, 1e-12, 200_000)
        assert np.allclose(fit.weights, cold, atol=1e-5)
        gradient = xy - gram @ fit.weights
        assert (np.abs(gradient) <= penalty * (1 + 1e-3) + 1e-6).all()
    with pytest.raises(ValueError):
        lasso.path_fits(gram, xy, yy, [1.0, 2.0])


def test_a_fit_that_ran_out_of_sweeps_says_so(spark):
    x, y = planted(120, 12, seed=9, noise=1.0)
    x[:, 1:] = x[:, :1] + 0.01 * x[:, 1:]
    m = moments_of(x, y)
    path = lasso.lasso_path(spark, m, m, [1e-9, 1e-3], tol=1e-13, sweeps=3).toPandas().set_index("alpha")
    assert not path.loc[1e-9, "converged"] and path.loc[1e-9, "gap"] > 1e-13
    assert lasso.lasso_path(spark, m, m, [1e9]).first()["converged"]


def test_first_scores_and_qualities_by_job(spark):
    x, y = planted(60, 3, seed=1)
    rows = [("a" if i % 2 else "b", float(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    jobs = spark.createDataFrame(rows, "job string, y double, x array<double>")
    cells = moments.moment_cells(jobs, keys=["job"])
    first = {(r["job"], r["variable"]): r["adj_r2"] for r in stepwise.first_scores(cells, ["p", "q", "r"], ["job"]).collect()}
    quality = {r["job"]: r["r2"] for r in stepwise.model_qualities(cells, {"m": np.array([1.0, 0.0, 2.0])}, ["job"]).collect()}
    for job, part in (("a", slice(1, None, 2)), ("b", slice(0, None, 2))):
        m = moments_of(x[part], y[part])
        assert first[job, "q"] == pytest.approx(stepwise.model_score(m, [1]))
        assert quality[job] == pytest.approx(m.r2(np.array([1.0, 0.0, 2.0])))

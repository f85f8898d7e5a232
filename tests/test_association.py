import itertools
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievelab.functions.special import correlation_tail, incomplete_beta, spearman_pvalue
from sievelab.operators import association, mic


def packed(spark, x, y):
    rows = [(i, float(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id long, y double, x array<double>")


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 5))
    x[:, 1] = np.round(x[:, 1])
    x[:, 2] = np.where(rng.random(400) < 0.4, 0.0, x[:, 2])
    x[:, 4] = 3.0
    y = np.exp(x[:, 0]) + x[:, 1]
    return x, y


NAMES = ["a.a", "b.b", "c.c", "d.d", "e.e"]


@pytest.mark.parametrize("rows_per_slot", [10**6, 60])
def test_spearman_matches_rank_correlation(spark, sample, rows_per_slot):
    x, y = sample
    ranks = pd.DataFrame(x, columns=NAMES).assign(y=y).rank()
    with np.errstate(all="ignore"):
        want = ranks.corr()
    got = association.spearman_target(packed(spark, x, y), NAMES, rows_per_slot=rows_per_slot).toPandas()
    rho = got.set_index("variable")["rho"]
    for name in NAMES[:4]:
        assert rho[name] == pytest.approx(want.loc[name, "y"], abs=1e-12)
    assert np.isnan(rho["e.e"])
    pairs = association.spearman_pairs(
        packed(spark, x, y), NAMES, ["b.b", "a.a"], rows_per_slot=rows_per_slot
    ).toPandas()
    assert len(pairs) == 10
    for r in pairs.itertuples():
        if r.suggestion == "e.e":
            assert np.isnan(r.abs_spearman_fs)
        else:
            assert r.abs_spearman_fs == pytest.approx(abs(want.loc[r.final, r.suggestion]), abs=1e-12)
            assert r.abs_spearman_ts == pytest.approx(abs(want.loc[r.suggestion, "y"]), abs=1e-12)
    own = pairs[pairs.final == pairs.suggestion]
    assert np.allclose(own.abs_spearman_fs, 1.0)


# Two-sided 5% and 1% points of Student's t.
@pytest.mark.parametrize(
    ("df", "t", "p"),
    [(1, 12.7062, 0.05), (5, 2.5706, 0.05), (10, 3.1693, 0.01), (30, 2.0423, 0.05), (120, 2.6174, 0.01)],
)
def test_p_values_against_tabulated_quantiles(df, t, p):
    rho = t / np.sqrt(df + t * t)
    assert correlation_tail(rho, df + 2) == pytest.approx(p, abs=2e-6 + 1e-4 * p)


def test_p_value_edges(spark):
    assert correlation_tail(1.0, 50) == 0.0
    assert correlation_tail(0.0, 50) == pytest.approx(1.0)
    assert incomplete_beta(2.0, 3.0, 0.4) == pytest.approx(0.5248, abs=1e-12)
    assert 0 < correlation_tail(0.9, 300) < 1e-100
    df = spark.createDataFrame([(0.5, 2), (None, 9), (0.3, 40)], "rho double, n long")
    got = [r["p"] for r in df.select(spearman_pvalue(F.col("rho"), F.col("n")).alias("p")).collect()]
    assert got[0] is None and got[1] is None and 0 < got[2] < 1


def brute_force_columns(table, most):
    """Best information with exactly l contiguous column groups, by trying all cuts."""
    k, n = len(table), table.sum()

    def entropy(p):
        p = p[p > 0]
        return -(p * np.log(p)).sum()

    found = []
    for groups in range(2, most + 1):
        best = 0.0
        for cuts in itertools.combinations(range(1, k), groups - 1):
            parts = np.add.reduceat(table, [0, *cuts], axis=0)
            left = sum(part.sum() / n * entropy(part / part.sum()) for part in parts)
            best = max(best, entropy(table.sum(0) / n) - left)
        found.append(best)
    return found


@pytest.mark.parametrize("seed", range(4))
def test_column_search_is_optimal(seed):
    rng = np.random.default_rng(seed)
    table = rng.integers(0, 6, size=(8, 3)).astype(float) + 0.0
    table = table[table.sum(1) > 0]
    assert np.allclose(mic.best_columns(table, 5), brute_force_columns(table, 5))


def test_clumps_do_not_change_the_optimum():
    rng = np.random.default_rng(1)
    row = rng.integers(0, 2, 14)
    table = np.zeros((14, 2))
    table[np.arange(14), row] = 1.0
    merged = mic._merge_clumps(table)
    assert len(merged) < 14 and merged.sum() == 14
    assert np.allclose(mic.best_columns(merged, 4), brute_force_columns(table, 4))


def naive_half(x, y, bound):
    """Equal parts on y point by point, all column cuts on x."""
    n, best = len(x), 0.0
    order = sorted(range(n), key=lambda i: y[i])
    for parts in range(2, bound // 2 + 1):
        row, current, held, left = {}, 0, 0, n
        i = 0
        while i < n:
            tied = [j for j in order if y[j] == y[order[i]]]
            wanted = left / (parts - current)
            if held and abs(held + len(tied) - wanted) >= abs(held - wanted):
                left, current, held = left - held, current + 1, 0
            row.update(dict.fromkeys(tied, current))
            held, i = held + len(tied), i + len(tied)
        values = sorted(set(x))
        used = len(set(row.values()))
        if used < 2:
            continue
        table = np.zeros((len(values), parts))
        for j in range(n):
            table[values.index(x[j]), row[j]] += 1
        for columns, score in enumerate(brute_force_columns(table, min(bound // parts, len(values))), start=2):
            best = max(best, score / np.log(min(columns, used)))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_mic_against_all_grids(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.permutation(13).astype(float) if seed % 2 else rng.integers(0, 9, 13).astype(float)
    y = np.round(x / 2 + rng.normal(size=13))
    got = mic.mic(packed(spark, x[:, None], y), ["v"], alpha=0.9).first()["mic"]
    bound = int(13**0.9)
    assert got == pytest.approx(max(naive_half(x, y, bound), naive_half(y, x, bound)), abs=1e-9)


def test_equal_parts_keep_ties_together():
    assert mic.equal_parts(np.ones(10), 5).tolist() == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert mic.equal_parts(np.array([8.0, 1.0, 1.0]), 5).tolist()[0] == 0
    assert mic.equal_parts(np.array([3.0, 3.0, 3.0]), 2).tolist() in ([0, 0, 1], [0, 1, 1])


@pytest.mark.parametrize("method", ["grid", "optimized"])
def test_mic_of_known_shapes(spark, method):
    rng = np.random.default_rng(3)
    t = rng.uniform(-1, 1, 300)
    x = np.column_stack([t, -np.exp(t), t**2, rng.normal(size=300), np.full(300, 2.0)])
    got = mic.mic(packed(spark, x, t), NAMES, method=method).toPandas().set_index("variable")["mic"]
    assert got["a.a"] == pytest.approx(1.0) and got["b.b"] == pytest.approx(1.0)
    assert got["c.c"] > 0.6 and got["d.d"] < 0.35 and abs(got["e.e"]) < 1e-9
    assert got.between(0, 1).all()


def test_mic_is_invariant_and_symmetric(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=250)
    b = np.round(a**2 + 0.3 * rng.normal(size=250), 1)
    first = mic.mic(packed(spark, np.column_stack([a, np.exp(a)]), b), ["x", "e"]).toPandas().set_index("variable")
    swapped = mic.mic(packed(spark, b[:, None], a), ["y"]).first()["mic"]
    assert first.loc["x", "mic"] == pytest.approx(first.loc["e", "mic"])
    assert first.loc["x", "mic"] == pytest.approx(swapped)


def test_mic_does_not_depend_on_slots(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(500, 2)), 1)
    y = x[:, 0] + rng.normal(size=500)
    whole = mic.mic(packed(spark, x, y), ["a", "b"]).orderBy("variable").collect()
    cut = mic.mic(packed(spark, x, y), ["a", "b"], rows_per_slot=40).orderBy("variable").collect()
    assert whole == cut


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=12, max_size=60))
def test_information_stays_in_range(points):
    (x, y), c = zip(*np.unique(points, axis=0).tolist()), np.unique(points, axis=0, return_counts=True)[1].astype(float)
    x, y = np.array(x), np.array(y)
    score = mic.optimized_score(x, y, c, 12, 15)
    assert -1e-9 <= score <= 1 + 1e-9


def test_pairs_to_suggestions(spark):
    pairs = spark.createDataFrame(
        [
            ("f", "a", 0.9, 0.8), ("g", "a", 0.9, 0.8), ("f", "b", 0.2, 0.1),
            ("g", "b", 0.3, 0.1), ("f", "c", 0.1, 0.5), ("g", "c", 0.6, 0.5), ("f", "n", None, None),
        ],
        "final string, suggestion string, abs_spearman_fs double, abs_spearman_ts double",
    )
    values = spark.createDataFrame([("a", 0.4), ("b", 0.3), ("c", 0.2)], "variable string, mic double")
    scored = association.pair_table(pairs, values)
    assert {(r["final"], r["suggestion"]) for r in scored.collect()} == {("f", "a"), ("g", "a")}
    best = association.suggestions(association.blend_scores(association.mic_lookup(pairs, values))).collect()
    assert [(r["suggestion"], r["final"]) for r in best] == [("a", "f"), ("c", "g"), ("b", "g")]
    assert best[0]["mean_of_corr"] == pytest.approx(0.85) and best[0]["mean_of_corr_mic"] == pytest.approx(0.65)


def test_feature_pairs_include_self(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "variable string")
    got = {(r["final"], r["suggestion"]) for r in association.feature_pairs(names, ["b", "a"]).collect()}
    assert got == set(itertools.product(["a", "b"], ["a", "b", "c"]))


def test_tail_for_very_many_rows():
    """Beyond any sample the t distribution is normal."""
    for rho in (1e-4, 1e-3, 4e-3):
        assert correlation_tail(rho, 1e6 + 1) == pytest.approx(incomplete_beta(5e5 - 0.5, 0.5, 1 - rho**2), rel=1e-5)
    for n in (1e8, 1e10, 1e12):
        for z in (0.5, 1.96, 4.0):
            assert correlation_tail(z / math.sqrt(n), n) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-6)


def streamed(x, y, c, rows, bound, clumps, step):
    """The search on streams, from counts in frames of ``step`` rows, without Spark's sorting."""
    best = 0.0
    for u, v in ((x, y), (y, x)):
        margin = pd.DataFrame({"pos": 0, "side": 0, "v": v, "c": c}).groupby(["pos", "side", "v"], as_index=False).sum()
        margins = [margin.iloc[i : i + step] for i in range(0, len(margin), step)]
        cuts = pd.concat(mic.equal_cuts(rows, bound, clumps)(margins))
        points = pd.DataFrame({"pos": 0, "side": 0, "u": u, "v": v, "c": c, "parts": None, "starts": None})
        heads = cuts.assign(u=-1, v=-1, c=-1)
        every = [frame.assign(chunk=k) for k in cuts["chunk"].unique() for frame in (heads[heads["chunk"] == k], points.sort_values(["u", "v"]))]
        stream = pd.concat(every)[[*mic.UNIT, "u", "v", "c", "parts", "starts"]]
        frames = [stream.iloc[i : i + step] for i in range(0, len(stream), step)]
        found = [float(f["score"].iloc[0]) for f in mic.column_search(rows, bound, clumps)(frames)]
        assert len(found) == cuts["chunk"].nunique()
        best = max(best, *found)
    return best


@pytest.mark.parametrize("step", [7, 64, 10**6])
@pytest.mark.parametrize("seed", range(6))
def test_streamed_search_equals_the_plain_one(monkeypatch, seed, step):
    """Ties on either axis, clumps that go on over frames, more clumps than superclumps, every way to add up the columns."""
    rng = np.random.default_rng(seed)
    n = 400
    x = rng.normal(size=n) if seed % 2 else np.round(rng.normal(size=n), 1)
    y = np.round(x**2 + rng.normal(size=n) * (seed % 3), 1 + seed % 2)
    place = lambda values: pd.Series(values).rank(method="min").to_numpy().astype(int) - 1
    counts = pd.DataFrame({"x": place(x), "y": place(y)}).value_counts().reset_index()
    arrays = [counts[name].to_numpy() for name in ("x", "y", "count")]
    clumps, bound = (2, 30) if seed < 3 else (15, 36)
    want = max(mic.optimized_score(arrays[0], arrays[1], arrays[2] * 1.0, bound, clumps), mic.optimized_score(arrays[1], arrays[0], arrays[2] * 1.0, bound, clumps))
    monkeypatch.setattr(mic, "DENSE", 16 if seed % 2 else 1024)
    assert streamed(*arrays, n, bound, clumps, step) == pytest.approx(want, abs=1e-9)


def test_columns_add_up_alike_in_both_orders():
    rng = np.random.default_rng(2)
    table = rng.integers(0, 5, size=(60, 4)) + np.eye(60, 4)
    upto = np.vstack([np.zeros(4), table.cumsum(0)])
    assert np.allclose(mic._least_dense(upto, 20), mic._least_by_column(upto, 20, block=8))
    assert np.allclose(mic._least_dense(upto, 60), mic._least_by_column(upto, 60))


@pytest.mark.parametrize("kind", ["noise", "steps", "pure"])
def test_long_last_groups_are_left_out_without_loss(monkeypatch, kind):
    rng = np.random.default_rng(4)
    own, k, most = rng.integers(0, 1500, 20_000), 1500, 100
    part = {"noise": rng.integers(0, 3, 20_000), "steps": own // 50 % 3, "pure": own // 500}[kind]
    table = np.zeros((k, 3))
    np.add.at(table, (own, part), 1)
    upto = np.vstack([np.zeros(3), table.cumsum(0)])
    tried, best_last = [0], mic._best_last

    def counted(*args):
        best, sums = best_last(*args)
        tried[0] += sums
        return best, sums

    monkeypatch.setattr(mic, "_best_last", counted)
    assert mic._least_by_column(upto, most) == pytest.approx(mic._least_dense(upto, most), abs=1e-9)
    assert kind == "pure" or tried[0] < most * k * k / 2 / 3  # pure columns are one clump before they come here
    want = [mic._xlogx(upto[40].sum() - upto[i].sum()) - mic._xlogx(upto[40] - upto[i]).sum() for i in range(40)]
    for rows in (mic.TABLE, 1):  # x log x looked up, and computed
        monkeypatch.setattr(mic, "TABLE", rows)
        assert mic.Spans(upto).cost(slice(40, 41), slice(0, 40))[0] == pytest.approx(np.array(want), abs=1e-9)


def test_mic_is_not_capped(spark):
    """The bound grows with the rows, and a grid that only fits it raises the score."""
    rng = np.random.default_rng(0)
    x = rng.permutation(600).astype(float)
    y = x % 20
    whole = mic.mic(packed(spark, x[:, None], y), ["v"]).first()
    assert whole["b"] == int(600**0.6) and whole["mic"] > mic.mic(packed(spark, x[:, None], y), ["v"], max_b=20).first()["mic"]


@pytest.mark.parametrize("bound, most", [(4, 10**6), (90, 10**6), (317, 500), (2930, 1 << 23)])
def test_grid_sets_hold_each_grid_once(bound, most):
    sets = mic.grids(bound, most)
    shapes = [(s.parts, v)[:: 1 if s.side == 0 else -1] for s in sets for v in range(s.low, s.high)]
    assert sorted(shapes) == [(i, j) for i in range(2, bound // 2 + 1) for j in range(2, bound // i + 1)]
    assert all(s.cells <= most or s.high == s.low + 1 for s in sets)
    if most > 10**5:  # the points are counted once for each set, not for each grid
        assert len(sets) <= 2 * bound**0.5


def test_copies_of_points_do_not_grow_with_the_bound(spark, monkeypatch):
    streams = []

    def kept(stream, *args):
        streams.append(stream)
        return spark.createDataFrame([], "pos int, score double")

    monkeypatch.setattr(mic, "_in_tasks", kept)
    counts = spark.createDataFrame([(0, i, i, 1) for i in range(10)], "pos int, cx long, cy long, c long")
    mic._grid_scores(counts, 11_665, 6_000_000, 6_000_000, 3)
    assert streams[0].count() <= 16 * 10


def test_units_are_dealt_evenly_to_tasks(spark):
    tasks = 4 * spark.sparkContext.defaultParallelism
    for units in (1, 6, tasks, 3 * tasks - 1):
        keys = mic._task_keys(spark, units)
        dealt = spark.createDataFrame([(k,) for k in keys], "unit long").repartition(tasks, "unit").groupBy(F.spark_partition_id()).count()
        sizes = [r["count"] for r in dealt.collect()]
        assert len(set(keys)) == units == sum(sizes) and max(sizes) <= -(-units // tasks) and len(sizes) == min(units, tasks)


@pytest.mark.parametrize("at_once", [1 << 20, 40])
@pytest.mark.parametrize("values", [5, 40, 2000])
def test_grids_of_few_values_and_in_small_steps(monkeypatch, at_once, values):
    """Fewer values than columns, columns that end in no point, and counts that are reduced to the cuts."""
    monkeypatch.setattr(mic, "CELLS_AT_ONCE", at_once)
    rng, n, bound = np.random.default_rng(values), 2000, 120
    x, y, c = (np.sort(rng.choice(n, values, replace=False))[rng.integers(0, values, 600)] for _ in range(3))
    c = c % 3 + 1
    for s in mic.grids(bound, 1 << 20):
        counts, fixed, other = mic.GridCounts(s, n), *((x, y)[:: 1 if s.side == 0 else -1])
        for part in np.array_split(np.argsort(other, kind="stable"), 4):
            counts.feed(fixed[part], other[part], c[part].astype(float))
        want = 0.0
        for v in range(s.low, s.high):
            joint = np.zeros((s.parts, v))
            np.add.at(joint, (fixed * s.parts // n, other * v // n), c)
            want = max(want, mic.information(joint) / np.log(min(s.parts, v)))
        assert counts.best() == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("n, bound", [(7, 12), (300, 60), (2000, 90)])
def test_grid_counts_equal_those_of_each_grid(monkeypatch, n, bound):
    rng = np.random.default_rng(n)
    x, y, c = rng.integers(0, n, 500), rng.integers(0, n, 500), rng.integers(1, 4, 500)
    for s in mic.grids(bound, 400):
        counts, fixed, other = mic.GridCounts(s, n), *((x, y)[:: 1 if s.side == 0 else -1])
        for part in np.array_split(np.argsort(other, kind="stable"), 3):
            counts.feed(fixed[part], other[part], c[part].astype(float))
        want = 0.0
        for v in range(s.low, s.high):
            joint = np.zeros((s.parts, v))
            np.add.at(joint, (fixed * s.parts // n, other * v // n), c)
            want = max(want, mic.information(joint) / np.log(min(s.parts, v)))
        assert counts.best() == pytest.approx(want, abs=1e-12)

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievelab.operators import joins, ordering
from sievelab.operators.ordering import average_rank, quantiles, values_at, with_ranks
from sievelab.operators.profile import describe_features


@pytest.fixture(scope="module")
def skewed(spark):
    """Three groups; in each a third of the rows share one value and the rest span many magnitudes."""
    rng = np.random.default_rng(5)
    frames = []
    for g in range(3):
        n = 3000 + 500 * g
        v = np.round(rng.lognormal(0, 3, n), 2)
        v[rng.random(n) < 0.34] = 1.5
        v[rng.random(n) < 0.12] = -3.0
        frames.append(pd.DataFrame({"variable": f"g.{g}", "value": v}))
    data = pd.concat(frames, ignore_index=True)
    data["row_id"] = np.arange(len(data))
    return data, spark.createDataFrame(data).cache()


@pytest.mark.parametrize("rows_per_slot", [10**6, 900, 100])
@pytest.mark.parametrize("descending", [False, True])
def test_average_rank_by_group(skewed, rows_per_slot, descending):
    data, df = skewed
    want = data.groupby("variable")["value"].rank(ascending=not descending)
    got = average_rank(df, "value", ["variable"], descending, rows_per_slot=rows_per_slot).toPandas()
    got = got.set_index("row_id")["avg_rank"].sort_index()
    assert np.array_equal(got.to_numpy(), want.to_numpy())


@pytest.mark.parametrize("rows_per_slot", [10**6, 200])
def test_rank_over_whole_table(skewed, rows_per_slot):
    data, df = skewed
    got = with_ranks(df.select("row_id", "value"), "value", rows_per_slot=rows_per_slot).toPandas().set_index("row_id")
    got = got.sort_index()
    assert np.array_equal(got["min_rank"], data["value"].rank(method="min").astype(int))
    assert np.array_equal(got["ties"], data.groupby("value")["value"].transform("size"))


def test_integer_keys_keep_exact_order(spark):
    ids = spark.range(0, 10_000).select((F.col("id") * 1_000_003 + (1 << 55)).alias("k"))
    got = values_at(ids, "k", lambda n: F.array(F.lit(1).cast("long"), F.lit(5000).cast("long"), n), rows_per_slot=300)
    at = {r["position"]: r["k"] for r in got.collect()}
    assert at == {i: (i - 1) * 1_000_003 + (1 << 55) for i in (1, 5000, 10_000)}


def test_constant_group_is_spread_over_tasks(spark):
    df = spark.range(0, 4000).select("id", F.lit(7.0).alias("v"))
    ranked = average_rank(df, "v", rows_per_slot=100)
    assert ranked.select("avg_rank").distinct().collect()[0]["avg_rank"] == 2000.5
    assert ranked.count() == 4000


@pytest.mark.parametrize("rows_per_slot", [10**6, 150])
def test_quantiles_interpolate(skewed, rows_per_slot):
    data, df = skewed
    shares = {"a": 0.0, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.777, "f": 1.0}
    got = quantiles(df, "value", shares, ["variable"], rows_per_slot=rows_per_slot).toPandas()
    got = got.set_index("variable").sort_index()
    want = data.groupby("variable")["value"].quantile(list(shares.values())).unstack()
    assert np.allclose(got[list(shares)].to_numpy(), want.to_numpy(), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("rows_per_slot", [10**6, 150])
def test_describe_matches_pandas(skewed, rows_per_slot):
    data, df = skewed
    got = describe_features(df, rows_per_slot=rows_per_slot).toPandas().set_index("variable").sort_index()
    want = data.groupby("variable")["value"].describe()
    want.columns = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    assert np.allclose(got.to_numpy(dtype=float), want.to_numpy(dtype=float), rtol=1e-9)


def test_describe_sketch_is_close(skewed):
    data, df = skewed
    got = describe_features(df, approximate=True).toPandas().set_index("variable").sort_index()
    low, high = data.groupby("variable")["value"].quantile([0.49, 0.51]).unstack().to_numpy().T
    assert ((low <= got["p50"]) & (got["p50"] <= high)).all()


def test_one_large_group_among_many_small_ones(spark, monkeypatch):
    monkeypatch.setattr(ordering, "MANY_GROUPS", 50)
    rng = np.random.default_rng(9)
    data = pd.DataFrame({"k": np.where(rng.random(6000) < 0.35, 0, rng.integers(1, 400, 6000)), "v": rng.normal(size=6000)})
    data["v"] = data["v"].round(2)
    data["row_id"] = np.arange(6000)
    df = spark.createDataFrame(data)
    got = average_rank(df, "v", ["k"], rows_per_slot=200).toPandas().set_index("row_id")["avg_rank"].sort_index()
    assert np.array_equal(got, data.groupby("k")["v"].rank())
    middle = quantiles(df, "v", {"m": 0.5}, ["k"], rows_per_slot=200).toPandas().set_index("k")["m"].sort_index()
    assert np.allclose(middle, data.groupby("k")["v"].median())


def test_attach_small_falls_back_to_salted_join(spark, skewed):
    data, df = skewed
    small = spark.createDataFrame([("g.0", 1), ("g.1", 2), ("g.3", 3)], "variable string, tag int")
    broadcast = joins.attach_small(df, small, ["variable"])
    salted = joins.attach_small(df, small, ["variable"], max_rows=1)
    assert sorted(broadcast.columns) == sorted(salted.columns)
    assert broadcast.exceptAll(salted.select(broadcast.columns)).isEmpty()
    assert salted.count() == broadcast.count() == (data["variable"] != "g.2").sum()
    semi = joins.attach_small(df, small.select("variable"), ["variable"], "left_semi", max_rows=1)
    assert semi.count() == salted.count()


def test_value_tables_equal_slots(spark):
    """Groups of few and of many distinct values, signed zeros, and groups too small to repeat a value."""
    rng = np.random.default_rng(11)
    parts = {"few": rng.integers(0, 9, 3000) / 4, "zero": rng.choice([0.0, -0.0, 1.0], 900), "many": rng.normal(size=2500), "one": np.array([3.0])}
    data = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in parts.items()], ignore_index=True)
    data["row_id"] = np.arange(len(data))
    df = spark.createDataFrame(data)
    columns = ["k", "v", "row_id", "min_rank", "ties", "group_rows"]
    found = {}
    for name, options in {"tables": {}, "slots": {"table_values": 0, "rows_per_slot": 150}, "part": {"table_values": 10}}.items():
        ranked = with_ranks(df, "v", ["k"], **options).select(columns).toPandas().set_index("row_id").sort_index()
        assert np.array_equal(ranked["min_rank"], data.groupby("k")["v"].rank(method="min").astype(int))
        found[name] = ranked
    assert found["tables"].equals(found["slots"]) and found["tables"].equals(found["part"])
    whole = with_ranks(df.where("k = 'few'").select("row_id", "v"), "v").toPandas().set_index("row_id").sort_index()
    assert np.array_equal(whole["ties"], found["tables"].loc[whole.index, "ties"])

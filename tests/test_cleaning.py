import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievelab.functions import columns as fc
from sievelab.operators import cleaning
from sievelab.plans import fixtures as fx


def job(spark, y):
    return spark.createDataFrame([(i, v) for i, v in enumerate(y)], "row_id long, y double")


@pytest.mark.parametrize(
    ("y", "code"),
    [
        ([], "-1"),
        ([float(i) for i in range(9)], "-4"),
        ([1.0] * 9, "-4"),
        ([1.0] * 10, "-2"),
        ([1.0, 1.0, None] * 4, "-2"),
        ([float(i) for i in range(10)], None),
        ([5.0] + [None] * 11, None),
    ],
)
def test_guard_code_first_match_wins(spark, y, code):
    assert cleaning.guard_code(job(spark, y), "y").first()["code"] == code


def test_feature_columns():
    columns = ["row", "END_TIME", "LOT_ID", "a.b", "a.b.c", "x.y", "oper"]
    keep = cleaning.feature_columns(columns, "a.b.c", cleaning.METADATA_COLUMNS | {"row"})
    assert keep == ["a.b", "x.y"]
    assert cleaning.feature_columns(columns, "a.b.c", legacy_name_match=True) == ["row", "x.y"]


def test_text_feature_is_refused(spark):
    df = spark.createDataFrame([(1.0, "a")], "`a.b` double, `c.d` string")
    with pytest.raises(ValueError, match="c.d"):
        cleaning.require_numeric(df, ["a.b", "c.d"])


def test_long_steps_match_pandas(spark, sf):
    wide = fx.orders_wide(spark, sf)
    frame = wide.toPandas().set_index("row_id")[fx.ORDER_FEATURES].astype(float)
    long = cleaning.to_long(wide, fx.ORDER_FEATURES, ["row_id"])

    def back(df):
        got = df.toPandas().pivot(index="row_id", columns="variable", values="value")
        return got.sort_index()

    filled = frame.fillna(frame.mean()).sort_index()
    imputed = cleaning.mean_impute(long)
    pd.testing.assert_frame_equal(back(imputed), filled[sorted(filled)], check_names=False, check_dtype=False)

    kept = cleaning.drop_null_features(cleaning.drop_constant(imputed))
    names = sorted(set(fx.ORDER_FEATURES) - {"const.one", "null.all"})
    assert sorted(r[0] for r in kept.select("variable").distinct().collect()) == names

    scaled = (filled[names] - filled[names].mean()) / filled[names].std(ddof=0)
    pd.testing.assert_frame_equal(back(cleaning.standardize(kept)), scaled, check_names=False)
    unit = filled[names] / np.sqrt((filled[names] ** 2).sum())
    pd.testing.assert_frame_equal(back(cleaning.l2_normalize(kept)), unit, check_names=False)


def test_constant_keeps_divisor_one(spark):
    long = spark.createDataFrame([(1, "c.c", 4.0), (2, "c.c", 4.0)], "row_id long, variable string, value double")
    assert [r["value"] for r in cleaning.standardize(long).collect()] == [0.0, 0.0]
    assert cleaning.l2_normalize(long).count() == 0


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1, 2.0), (2, float("nan")), (3, None)], "row_id long, `a.b` double")
    long = cleaning.to_long(df, ["a.b"], ["row_id"])
    assert long.where("value IS NULL").count() == 2
    assert cleaning.drop_null_target(df, "a.b").count() == 1


def test_job_profile_counts_rows_with_a_response(spark):
    data = [(1.0, 1.0, None), (2.0, 2.0, 5.0), (None, 99.0, 99.0), (4.0, 6.0, 7.0), (5.0, None, None)]
    df = spark.createDataFrame(data, "y double, a double, b double")
    rows = {r["pos"]: r for r in cleaning.job_profile(df, "y", ["a", "b"]).collect()}
    frame = df.toPandas()
    assert (rows[0]["n"], rows[0]["n_present"]) == (5, 4)
    assert rows[0]["std_pop"] == pytest.approx(frame["y"].std(ddof=0))
    kept = frame.dropna(subset=["y"])
    filled = kept.fillna(kept.mean())
    for pos, name in ((1, "a"), (2, "b")):
        assert (rows[pos]["n"], rows[pos]["n_present"]) == (4, kept[name].count())
        assert rows[pos]["mean"] == pytest.approx(kept[name].mean())
        assert rows[pos]["std_pop_filled"] == pytest.approx(filled[name].std(ddof=0))


def test_names_are_split_null_safe(spark):
    df = spark.createDataFrame([("a.b",), ("a",), ("a.b.c",)], "variable string")
    got = {r["variable"]: (r["step"], r["param"]) for r in fc.split_name(df).collect()}
    assert got == {"a.b": ("a", "b"), "a": ("a", None), "a.b.c": ("a", "b")}


def test_column_functions(spark):
    row = spark.range(1).select(
        fc.adjusted_r2(F.lit(0.5), F.lit(11), F.lit(4)).alias("adj"),
        fc.adjusted_r2(F.lit(0.5), F.lit(5), F.lit(4)).alias("undefined"),
        fc.scaled_importance(F.lit(0.5), F.lit(0.25)).alias("s"),
        fc.scaled_importance(F.lit(0.5), F.lit(0.0)).alias("inf"),
        fc.scaled_importance(F.lit(0.0), F.lit(0.0)).alias("none"),
    ).first()
    assert row["adj"] == pytest.approx(1 - 0.5 * 10 / 6)
    assert row["undefined"] is None
    assert row["s"] == 2.0 and math.isinf(row["inf"]) and row["none"] is None


def test_correlation_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(fc.correlation(F.col("a"), F.col("b")).alias("r")).first()["r"] is None

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelab.operators import sampling


def reference_order(seed, replicate, ids):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{replicate}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("rows_per_bucket", [10**6, 40])
@pytest.mark.parametrize("n", [1, 10, 203, 1000])
def test_exact_split(spark, n, rows_per_bucket):
    df = spark.range(n).withColumnRenamed("id", "row_id")
    got = sampling.train_test(df, 0.3, 42, rows_per_bucket=rows_per_bucket).toPandas()
    want = set(reference_order(42, 0, range(n))[: math.ceil(0.3 * n - 1e-9)])
    assert set(got[got.is_test].row_id) == want


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(500).withColumnRenamed("id", "row_id")
    a = sampling.train_test(df.repartition(7), 0.3, 1).where("is_test")
    b = sampling.train_test(df.coalesce(1), 0.3, 1).where("is_test")
    assert a.exceptAll(b).isEmpty() and a.count() == b.count() == 150


@pytest.mark.parametrize("rows_per_bucket", [10**6, 30])
def test_subsamples(spark, rows_per_bucket):
    df = spark.range(203).withColumnRenamed("id", "row_id")
    got = sampling.subsamples(df, 4, 0.3, 9, rows_per_bucket=rows_per_bucket).toPandas()
    for r in range(4):
        want = set(reference_order(9, r, range(203))[math.ceil(0.3 * 203) :])
        assert set(got[got.replicate == r].row_id) == want


def test_hashed_share_is_about_right(spark):
    n = spark.range(20_000).withColumnRenamed("id", "row_id").where(sampling.hashed_share(0.3, 3)).count()
    assert abs(n - 6000) < 300


@pytest.mark.parametrize("n", [*range(10, 24), 203])
def test_fold_sizes(n):
    sizes = sampling.fold_sizes(n, 5)
    assert sum(sizes) == n and sorted(sizes, reverse=True) == sizes and sizes[0] - sizes[-1] <= 1


@pytest.mark.parametrize("rows_per_slot", [10**6, 25])
@pytest.mark.parametrize("n", [3, 5, 23, 203])
def test_kfold_is_contiguous(spark, n, rows_per_slot):
    ids = [i * i * 7 + 3 for i in range(n)]
    df = spark.createDataFrame([(i,) for i in ids], "row_id long").orderBy(F.rand(1))
    got = sampling.kfold(df, 5, rows_per_slot=rows_per_slot).toPandas().sort_values("row_id")
    want = np.repeat(range(5), sampling.fold_sizes(n, 5))
    assert got.fold.tolist() == want.tolist()


def test_alpha_grid(spark):
    got = [r["alpha"] for r in sampling.alpha_grid(spark).orderBy("step").collect()]
    assert np.allclose(np.log10(got), np.log10(np.logspace(-10, -3, 100)), atol=1e-12)
    assert np.allclose(got, sampling.alpha_values(), rtol=1e-12)

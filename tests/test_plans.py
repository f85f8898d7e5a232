"""Shapes of the physical plans the scaling claims rest on."""

import datetime as dt
import re

from pyspark.sql import functions as F

from sievelab.operators import cleaning, moments, ordering, ranking, sampling
from sievelab.plans import fixtures as fx
from sievelab.plans.feature_selection import _dealt, _scaled_matrix
from sievelab.sources.scratch import save_table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return re.findall(r"Exchange (hashpartitioning\([^)]*\)|rangepartitioning\([^)]*\)|SinglePartition)", plan(df))


def test_scaling_moves_no_row(spark, sf):
    wide = save_table(fx.orders_wide(spark, sf), "wide")
    usable = [("line.qty", 1.0, 2.0), ("cust.acctbal", 3.0, 4.0)]
    scaled = _scaled_matrix(wide, "y", "row_id", usable, 0.0, 1.0)
    assert shuffles(scaled) == []
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan(scaled)).group(1)
    assert schema == "row_id:bigint,y:double,line.qty:double,cust.acctbal:double"


def test_response_filter_reaches_the_scan(spark, sf):
    wide = save_table(fx.orders_wide(spark, sf), "wide")
    assert "PushedFilters: [IsNotNull(y)]" in plan(cleaning.drop_null_target(wide, "y"))
    dealt = _dealt(_scaled_matrix(wide, "y", "row_id", [("line.qty", 1.0, 2.0)], 0.0, 1.0), 10)
    assert "Coalesce 1" not in plan(dealt) and "PushedFilters: [IsNotNull(y)]" in plan(dealt)


def test_equal_rows_are_ranked_where_they_are(spark):
    same = save_table(spark.range(40_000).select((F.col("id") % 3).cast("double").alias("v")), "same")
    ranked = ordering.average_rank(same, "v", rows_per_slot=500)
    assert sorted((r["v"], r["avg_rank"], r["n"]) for r in ranked.groupBy("v", "avg_rank").agg(F.count("*").alias("n")).collect()) == [
        (0.0, 6667.5, 13334), (1.0, 20001.0, 13333), (2.0, 33334.0, 13333)
    ]
    metrics = ranked.where(F.lit(True))
    tasks = metrics.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in tasks) <= 2 * 40_000 / spark.sparkContext.defaultParallelism


def test_long_statistics_shuffle_only_partial_sums(spark, sf):
    long = save_table(fx.orders_long(spark, sf), "long")
    for step in (cleaning.mean_impute, cleaning.standardize, cleaning.l2_normalize, cleaning.drop_constant):
        text = plan(step(long, 9))
        assert len(shuffles(step(long, 9))) == 1 and "BroadcastHashJoin" in text and "partial_" in text


def test_applying_a_split_or_folds_moves_no_row(spark, sf):
    ids = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"))
    assert shuffles(sampling.train_test(ids)) == []
    assert shuffles(sampling.subsamples(ids, 3)) == []
    assert shuffles(sampling.kfold(ids)) == []


def test_ranking_shuffles_rows_once(spark, sf):
    long = save_table(fx.orders_filled(spark, sf), "filled")
    ranked = ordering.average_rank(long, "value", ["variable"], rows_per_slot=100)
    by_rows = [s for s in shuffles(ranked) if "__task" in s]
    assert len(by_rows) == 1
    assert len(re.findall(r"\+- Window|:- Window|Window \[", plan(ranked))) >= 1
    assert "NestedLoop" not in plan(ranked) and "Cartesian" not in plan(ranked)


def test_target_rank_is_not_recomputed_for_feature_cuts(spark, sf):
    packed = save_table(fx.embeddings_packed(spark, sf), "packed")
    ranked = ordering.average_rank(packed.select("y", "x"), "y", alias="y_rank", sizes=(500, 1), rows_per_slot=50)
    cuts = ranked.select(F.posexplode("x").alias("pos", "value")).groupBy("pos").agg(
        F.percentile_approx("value", 0.5)
    )
    assert "Window" not in re.sub(r"__\w+", "", plan(cuts))


def test_aggregates_combine_before_the_shuffle(spark, sf):
    orders = fx.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    assert "partial_min_by" in plan(ranking.argmax(orders, "o_totalprice", ["o_orderkey"], ["o_custkey"]))
    assert "TakeOrderedAndProject" in plan(ranking.top_n(orders, "o_totalprice", 5, tie="o_orderkey"))
    cells = moments.moment_cells(fx.embeddings_packed(spark, sf))
    assert "partial_sum" in plan(cells) and "MapInArrow" in plan(cells)


def test_rank_plans_do_not_grow_with_the_slots(spark):
    rows = save_table(spark.range(40_000).select(F.col("id"), F.rand(3).alias("v")), "rows")
    length = {n: len(plan(ordering.average_rank(rows, "v", rows_per_slot=40_000 // n))) for n in (8, 1024)}
    assert length[1024] < 2 * length[8]
    ranked = ordering.average_rank(rows, "v", rows_per_slot=40_000 // 1024)
    assert plan(ranked).count("Scan parquet") == 2  # the rows once, and the cuts' or counts' own
    assert ranked.agg(F.sum("avg_rank")).first()[0] == 40_000 * 40_001 / 2


def test_few_values_are_ranked_without_moving_a_row(spark):
    rows = save_table(spark.range(50_000).select((F.col("id") % 3).alias("k"), (F.hash("id") % 40).cast("double").alias("v")), "rows")
    ranked = ordering.average_rank(rows, "v", ["k"], rows_per_slot=100)
    text = plan(ranked)
    assert "BroadcastHashJoin" in text and "v" in ranked.columns
    # only the table of values, by its group; rows would go by task
    assert shuffles(ranked) and all(x.startswith("hashpartitioning(k#") for x in shuffles(ranked))
    assert ranked.groupBy(F.spark_partition_id()).count().count() == rows.rdd.getNumPartitions()


def test_the_target_travels_with_its_row(spark):
    rows = [(1, 2.0, dt.datetime(2024, 1, 1), 3.0, None), (2, None, dt.datetime(2024, 1, 2), 5.0, 6.0)]
    wide = spark.createDataFrame(rows, "row_id long, `r.y` double, END_TIME timestamp, `a.b` double, `c.d` double")
    long = cleaning.long_with_target(wide, ["a.b", "c.d"], "r.y", "END_TIME")
    assert not shuffles(long) and "Join" not in plan(long)
    target = wide.select("row_id", F.col("`r.y`").alias("y"), F.unix_micros("END_TIME").alias("end_micros"))
    joined = cleaning.attach_target(cleaning.to_long(wide, ["a.b", "c.d"], ["row_id"]), target)
    assert sorted(map(str, joined.select(long.columns).collect())) == sorted(map(str, long.collect()))

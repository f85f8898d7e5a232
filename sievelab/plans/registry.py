"""Queries over the shared test tables, one per operator. Each reads its tables whole."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelab.functions import columns as fc
from sievelab.functions.special import spearman_pvalue
from sievelab.operators import (
    association,
    cleaning,
    forest,
    lasso,
    mic,
    moments,
    ordering,
    profile,
    ranking,
    results,
    sampling,
    status,
    stepwise,
)
from sievelab.plans import fixtures as fx
from sievelab.plans.feature_selection import Settings, feature_selection
from sievelab.sources import files
from sievelab.sources.scratch import save_table, scratch_path

AS_OF = dt.datetime(2024, 3, 1, 12, 0)
FOREST = forest.ForestSpec()  # 10 replicates of 100 trees
FINALS = list(fx.PLANTED)
FOLDS = 5
SIX = 6

# Event types read as the stage they report.
STAGE_OF_EVENT = {
    "signup": "STARTED",
    "view": "RF_COMPLETED",
    "click": "LASSO_COMPLETED",
    "purchase": "STEP_FORWARD_COMPLETED",
    "error": "MIC_COMPLETED",
}


def _r(df: DataFrame, *names: str, places: int = SIX) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), places) for n in names})


# Sources


def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "orders-csv")
    wide = fx.orders_wide(spark, sf).select("row_id", "y", *[files.column(c) for c in fx.ORDER_FEATURES[:7]])
    wide.write.option("header", True).csv(path)
    back = files.read_job_csv(spark, path, wide.schema)
    return cleaning.to_long(back, fx.ORDER_FEATURES[:7], ["row_id", "y"])


def table_count(spark: SparkSession, sf: str) -> DataFrame:
    return files.table_count(fx.table(spark, sf, "lineitem"))


def limit_n(spark: SparkSession, sf: str) -> DataFrame:
    return files.table_count(files.first_rows(fx.table(spark, sf, "lineitem"), 10))


def project_cols(spark: SparkSession, sf: str) -> DataFrame:
    return files.project(fx.table(spark, sf, "customer"), ["c_name", "c_mktsegment", "c_acctbal"])


def clock_literal(spark: SparkSession, sf: str) -> DataFrame:
    now = files.clock(spark, "connected")
    return fx.table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.lit(now.select("message").scalar()).alias("message")
    )


# Status and sinks


def _timestamps(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.unix_micros(F.col(n)) for n in names})


def status_upsert(spark: SparkSession, sf: str) -> DataFrame:
    events = fx.status_log(spark, sf)
    before = F.unix_micros("ts") <= events.agg(F.avg(F.unix_micros("ts"))).scalar()
    table = status.upsert_status(status.status_of(events.where(before)), events.where(~before))
    return _timestamps(table, "start_time", "update_time")


def status_list(spark: SparkSession, sf: str) -> DataFrame:
    listed = status.list_status(status.status_of(fx.status_log(spark, sf)))
    return _timestamps(listed, "start_time", "update_time")


def stage_progress(spark: SparkSession, sf: str) -> DataFrame:
    stage = F.create_map(*[F.lit(v) for pair in STAGE_OF_EVENT.items() for v in pair])[F.col("status")]
    progress = F.create_map(*[F.lit(v) for pair in status.STAGES.items() for v in pair])
    log = fx.status_log(spark, sf).withColumn("status", stage)
    log = log.withColumn("progress", progress[F.col("status")])
    return log.select("event_id", "jobid", "status", "progress")


def with_dt(spark: SparkSession, sf: str) -> DataFrame:
    return fc.with_dt(fx.table(spark, sf, "events").select("event_id", "ts"), F.col("ts")).drop("ts")


def error_rows(spark: SparkSession, sf: str) -> DataFrame:
    jobs = guard_code(spark, sf).select(F.col("o_custkey").alias("job_id"), "code")
    return results.error_rows(jobs, AS_OF)


def sink_importance(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "importance")
    results.append_table(results.importance_rows(_fold_stats(spark, sf), "0", "job-1", AS_OF), path)
    back = spark.read.parquet(path).withColumn("dt", F.col("dt").cast("string"))
    return _r(back, "importance_mean")


def sink_coeff(spark: SparkSession, sf: str) -> DataFrame:
    slopes = moments.univariate_r2(fx.embeddings_long(spark, sf))
    model = slopes.select("variable", F.col("slope").alias("score"), F.abs("slope").alias("abs_score"))
    return _r(results.coeff_rows(model, "0", "job-1", AS_OF), "score", "abs_score")


def sink_result(spark: SparkSession, sf: str) -> DataFrame:
    best = association.suggestions(_scored(spark, sf))
    rows = results.result_rows(best, "job-1", AS_OF)
    return _r(rows, "abs_spearman_fs", "abs_spearman_ts", "mean_of_corr", "mic", "mean_of_corr_mic")


# Cleaning


def guard_code(spark: SparkSession, sf: str) -> DataFrame:
    return _r(cleaning.guard_code(fx.table(spark, sf, "orders"), "o_totalprice", ["o_custkey"]), "y_std")


def drop_null_target(spark: SparkSession, sf: str) -> DataFrame:
    rows = cleaning.drop_null_target(fx.orders_wide(spark, sf), "line.price")
    return rows.select("row_id", files.column("line.price").alias("y"))


def feature_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    wide = fx.orders_wide(spark, sf)
    features = cleaning.feature_columns(wide.columns, "y", cleaning.METADATA_COLUMNS | {"row_id"})
    return cleaning.to_long(wide, features, ["row_id"])


def drop_constant(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.drop_constant(fx.orders_long(spark, sf), len(fx.ORDER_FEATURES))


def drop_null_features(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.drop_null_features(fx.orders_long(spark, sf), len(fx.ORDER_FEATURES))


def mean_impute(spark: SparkSession, sf: str) -> DataFrame:
    return _r(cleaning.mean_impute(fx.orders_long(spark, sf), len(fx.ORDER_FEATURES)), "value")


def standardize(spark: SparkSession, sf: str) -> DataFrame:
    return _r(cleaning.standardize(fx.orders_filled(spark, sf), 7), "value")


def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _r(cleaning.l2_normalize(fx.orders_filled(spark, sf), 7), "value", places=9)


def event_time(spark: SparkSession, sf: str) -> DataFrame:
    timed = fc.event_time(fx.orders_wide(spark, sf), "END_TIME")
    return timed.select("row_id", "time_micros", F.date_format("time", "yyyy-MM-dd").alias("day"))


def attach_target(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.long_with_target(fx.orders_wide(spark, sf), ["line.qty", "cust.acctbal"], "y", "END_TIME")


def split_name(spark: SparkSession, sf: str) -> DataFrame:
    return fc.split_name(feature_unpivot(spark, sf)).groupBy("variable", "step", "param").agg(
        F.count(F.lit(1)).alias("n")
    )


def semi_selected(spark: SparkSession, sf: str) -> DataFrame:
    long = fx.embeddings_long(spark, sf)
    kept = ranking.top_n(moments.univariate_r2(long), "r2", 10)
    return cleaning.select_features(long.drop("y"), kept, len(fx.EMBEDDING_FEATURES))


# Statistics and ranking


def describe_features(spark: SparkSession, sf: str) -> DataFrame:
    stats = profile.describe_features(fx.orders_long(spark, sf))
    return _r(stats, "mean", "std", "min", "p25", "p50", "p75", "max")


def _fold_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Per fold and variable: R2 of the one-feature fit, used as an importance with folds as replicates."""
    ends = sampling.fold_ends(fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id")), FOLDS)
    long = fx.embeddings_long(spark, sf).withColumn("replicate", sampling.fold_of(ends))
    return moments.univariate_r2(long, ["replicate"]).select("replicate", "variable", F.col("r2").alias("importance"))


def _fold_stats(spark: SparkSession, sf: str) -> DataFrame:
    return forest.importance_stats(_fold_scores(spark, sf), sizes=(FOLDS, len(fx.EMBEDDING_FEATURES)))


def importance_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _r(_fold_stats(spark, sf), "mean", "std", "min", "p25", "p50", "p75", "max")


def scaled_importance(spark: SparkSession, sf: str) -> DataFrame:
    scores = _fold_scores(spark, sf)
    spread = scores.groupBy("variable").agg(F.stddev_pop("importance").alias("std"))
    sizes = (len(fx.EMBEDDING_FEATURES), FOLDS)
    ranked = forest.rank_importance(scores.join(F.broadcast(spread), "variable"), sizes)  # one row per feature
    return _r(ranked.select("replicate", "variable", "importance", "std", "s", "s_rank", "i_rank"),
              "importance", "std", "s")


def positive_importance(spark: SparkSession, sf: str) -> DataFrame:
    positive = forest.positive_importance(_fold_stats(spark, sf))
    return _r(positive.select("variable", "mean"), "mean")


def avg_rank_desc(spark: SparkSession, sf: str) -> DataFrame:
    filled = save_table(fx.orders_filled(spark, sf), "filled")  # several passes read it
    return ordering.average_rank(filled, "value", ["variable"], descending=True).drop("value")


def avg_rank_asc(spark: SparkSession, sf: str) -> DataFrame:
    ranked = ordering.average_rank(fx.table(spark, sf, "lineitem").select("l_quantity"), "l_quantity")
    return ranked.groupBy("l_quantity", "avg_rank").agg(F.count(F.lit(1)).alias("n"))


def top_n(spark: SparkSession, sf: str) -> DataFrame:
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ranking.top_n(orders, "o_totalprice", 100, tie="o_orderkey")


def top_n_abs(spark: SparkSession, sf: str) -> DataFrame:
    customers = fx.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return ranking.top_n_abs(customers, "c_acctbal", 50, tie="c_custkey")


def argmax_global(spark: SparkSession, sf: str) -> DataFrame:
    lines = fx.table(spark, sf, "lineitem")
    best = ranking.argmax(lines, "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return best.select("l_orderkey", "l_linenumber", "l_extendedprice")


def argmax_per_group(spark: SparkSession, sf: str) -> DataFrame:
    orders = fx.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ranking.argmax(orders, "o_totalprice", ["o_orderkey"], ["o_custkey"])


def distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.distinct_values(fx.table(spark, sf, "lineitem"), "l_partkey")


def adjusted_r2(spark: SparkSession, sf: str) -> DataFrame:
    fits = moments.univariate_r2(fx.embeddings_long(spark, sf))
    fits = fits.withColumn("adj_r2", fc.adjusted_r2(F.col("r2"), F.col("n"), F.lit(1)))
    return _r(fits.select("variable", "n", "r2", "adj_r2"), "r2", "adj_r2")


def above_median(spark: SparkSession, sf: str) -> DataFrame:
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ranking.above_median(orders, "o_totalprice")


def result_code(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.result_code(above_median(spark, sf))


# Splits


def _order_ids(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"))


def train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.train_test(_order_ids(spark, sf), 0.3, 42)


def bootstrap_samples(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.subsamples(_order_ids(spark, sf), 10, 0.3, 7)


def union_replicates(spark: SparkSession, sf: str) -> DataFrame:
    ids = _order_ids(spark, sf)
    cuts = sampling.exact_cuts(ids, 0.3, 11, 3)
    return ranking.union_all([ids.where(~c.contains()).withColumn("replicate", F.lit(c.replicate)) for c in cuts])


def kfold_assign(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.kfold(_order_ids(spark, sf), FOLDS)


def kfold_r2(spark: SparkSession, sf: str) -> DataFrame:
    return _r(_fold_scores(spark, sf), "importance")


# Models


def gram_matrix(spark: SparkSession, sf: str) -> DataFrame:
    gram = moments.gram_matrix(fx.embeddings_packed(spark, sf), fx.EMBEDDING_FEATURES)
    return _r(gram, "value", places=4)


def ols_univariate_r2(spark: SparkSession, sf: str) -> DataFrame:
    fits = moments.univariate_r2(fx.embeddings_long(spark, sf))
    return _r(fits, "slope", "r2")


def lasso_univariate(spark: SparkSession, sf: str) -> DataFrame:
    path = moments.soft_threshold_path(fx.embeddings_long(spark, sf), sampling.alpha_grid(spark))
    return _r(path, "coef")


def _embedding_moments(spark: SparkSession, sf: str, folds: bool = False) -> DataFrame:
    packed = fx.embeddings_packed(spark, sf)
    if not folds:
        return moments.moment_cells(packed)
    return moments.moment_cells(packed, sampling.fold_of(sampling.fold_ends(packed.select("row_id"), FOLDS)))


def forward_step1(spark: SparkSession, sf: str) -> DataFrame:
    candidates = stepwise.first_scores(save_table(_embedding_moments(spark, sf), "moments"), fx.EMBEDDING_FEATURES)
    best = ranking.argmax(candidates, "adj_r2", ["variable"]).select("variable").scalar()
    return _r(candidates.withColumn("is_best", F.col("variable") == best), "adj_r2")


def _trace(spark: SparkSession, sf: str, penalty: str) -> DataFrame:
    return stepwise.step_forward(_embedding_moments(spark, sf, True), fx.EMBEDDING_FEATURES, penalty=penalty)


def _trace_rows(trace: DataFrame) -> DataFrame:
    """The trace with the feature each step added."""
    added = F.element_at("var_included", -1).alias("added")
    return _r(trace.select("step", "n_var", added, "adj_r2", "kfold_adj_r2"), "adj_r2", "kfold_adj_r2")


def step_forward(spark: SparkSession, sf: str) -> DataFrame:
    return _trace_rows(_trace(spark, sf, "single"))


def step_forward_penalised(spark: SparkSession, sf: str) -> DataFrame:
    return _trace_rows(_trace(spark, sf, "n_vars"))


def best_model(spark: SparkSession, sf: str) -> DataFrame:
    return _r(stepwise.best_model(_trace(spark, sf, "n_vars")), "score", "abs_score")


def model_quality(spark: SparkSession, sf: str) -> DataFrame:
    weights = [fx.PLANTED.get(name, 0.0) for name in fx.EMBEDDING_FEATURES]
    found = stepwise.model_qualities(_embedding_moments(spark, sf), {"planted": moments.np.array(weights)})
    return _r(found.drop("model"), "r2", "adj_r2")


def _lasso_moments(spark: SparkSession, sf: str):
    packed = fx.embeddings_packed(spark, sf)
    cut = sampling.exact_cuts(packed.select("row_id"), 0.3, 42)[0]
    parts = moments.collect_moments(moments.moment_cells(packed, cut.contains().cast("int")))
    norms = moments.total(parts.values()).norms
    return parts[0].rescaled(norms), parts[1].rescaled(norms)


def _best_lasso(spark: SparkSession, sf: str, tol: float) -> DataFrame:
    train, test = _lasso_moments(spark, sf)
    path = lasso.lasso_path(spark, train, test, sampling.alpha_values(), tol)
    alpha = ranking.argmax(path, "test_score", ["alpha"]).first()["alpha"]
    return lasso.lasso_select(spark, train + test, fx.EMBEDDING_FEATURES, alpha, tol)


def _lasso_scores(spark: SparkSession, sf: str, tol: float) -> DataFrame:
    path = lasso.lasso_path(spark, *_lasso_moments(spark, sf), sampling.alpha_values(), tol)
    path = path.withColumn("log_alpha", F.log10("alpha"))
    return _r(path.select("log_alpha", "train_score", "test_score", "n_nonzero", "converged"),
              "log_alpha", "train_score", "test_score")


def lasso_path(spark: SparkSession, sf: str) -> DataFrame:
    return _lasso_scores(spark, sf, lasso.TOLERANCE)


def lasso_path_exact(spark: SparkSession, sf: str) -> DataFrame:
    return _lasso_scores(spark, sf, 1e-12)


def lasso_select(spark: SparkSession, sf: str) -> DataFrame:
    return _best_lasso(spark, sf, lasso.TOLERANCE)


def lasso_select_exact(spark: SparkSession, sf: str) -> DataFrame:
    return _r(_best_lasso(spark, sf, 1e-12), "score", "abs_score")


def rf_importance(spark: SparkSession, sf: str) -> DataFrame:
    packed = fx.orders_packed(spark, sf)
    rows = forest.rf_importance(packed, fx.ORDER_FEATURES[:7], FOREST)
    return spark.createDataFrame(rows, "replicate int, variable string, importance double, std double")


def rf_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    importances = forest.rf_bootstrap(fx.embeddings_packed(spark, sf), fx.EMBEDDING_FEATURES, FOREST)
    return forest.rank_importance(importances, (len(fx.EMBEDDING_FEATURES), FOREST.replicates))


# Association


def spearman_target(spark: SparkSession, sf: str) -> DataFrame:
    packed = save_table(fx.orders_packed(spark, sf), "orders-packed")
    return _r(association.spearman_target(packed, fx.ORDER_FEATURES[:7]), "rho")


def feature_pairs(spark: SparkSession, sf: str) -> DataFrame:
    names = fx.embeddings_long(spark, sf).select("variable").distinct()
    return association.feature_pairs(names, FINALS)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return association.spearman_pairs(fx.embeddings_packed(spark, sf), fx.EMBEDDING_FEATURES, FINALS)


def _grid_mic(spark: SparkSession, sf: str) -> DataFrame:
    return mic.mic(fx.embeddings_packed(spark, sf), fx.EMBEDDING_FEATURES, method="grid")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return association.pair_table(_pairs(spark, sf), _grid_mic(spark, sf))


def spearman_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _r(_pairs(spark, sf), "abs_spearman_fs", "abs_spearman_ts")


def spearman_pairs_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines, whose order key repeats."""
    x = F.array("l_quantity", "l_discount", "l_tax")
    lines = fx.table(spark, sf, "lineitem")
    packed = lines.select(F.col("l_orderkey").alias("row_id"), F.col("l_extendedprice").alias("y"), x.alias("x"))
    names = ["line.quantity", "line.discount", "line.tax"]
    pairs = association.spearman_pairs(packed, names, names[:2])
    return _r(pairs, "abs_spearman_fs", "abs_spearman_ts")


def spearman_p_values(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _pairs(spark, sf)
    tails = {f"p_{k}": spearman_pvalue(F.col(f"abs_spearman_{k}"), F.col("n")) for k in ("fs", "ts")}
    return _r(pairs.withColumns(tails).select("final", "suggestion", "p_fs", "p_ts"), "p_fs", "p_ts")


def mic_grid(spark: SparkSession, sf: str) -> DataFrame:
    scores = mic.mic(fx.lineitem_packed(spark, sf), fx.LINE_FEATURES, method="grid")
    return _r(scores, "mic")


def mic_optimized(spark: SparkSession, sf: str) -> DataFrame:
    """Few-valued columns of all order lines, so that SQL can try every partition."""
    return _r(mic.mic(fx.lineitem_marks(spark, sf), fx.MARK_FEATURES), "mic")


def mic_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return _r(
        association.mic_lookup(_pairs(spark, sf).select("final", "suggestion"), _grid_mic(spark, sf)), "mic"
    )


def pair_table(spark: SparkSession, sf: str) -> DataFrame:
    names = ["abs_spearman_fs", "abs_spearman_ts", "mic", "mean_of_corr", "mean_of_corr_mic"]
    return _r(_scored(spark, sf).select("final", "suggestion", *names), *names)


def blend_scores(spark: SparkSession, sf: str) -> DataFrame:
    blended = fc.blend_scores(association.mic_lookup(_pairs(spark, sf), _grid_mic(spark, sf)))
    return _r(
        blended.select("final", "suggestion", "mean_of_corr", "mean_of_corr_mic"), "mean_of_corr", "mean_of_corr_mic"
    )


def suggestions(spark: SparkSession, sf: str) -> DataFrame:
    best = association.suggestions(_scored(spark, sf))
    return _r(best.select("suggestion", "final", "mean_of_corr_mic"), "mean_of_corr_mic")


# Whole job


def selection_job(spark: SparkSession, sf: str):
    settings = Settings(forest=FOREST)
    return feature_selection(fx.embeddings_wide(spark, sf), "y", "row_id", as_of=AS_OF, settings=settings)


def feature_selection_job(spark: SparkSession, sf: str) -> DataFrame:
    return selection_job(spark, sf).result


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        csv_scan, table_count, limit_n, project_cols, clock_literal,
        status_upsert, status_list, stage_progress, with_dt, error_rows, sink_importance, sink_coeff, sink_result,
        guard_code, drop_null_target, feature_unpivot, drop_constant, drop_null_features, mean_impute, standardize,
        l2_normalize, event_time, attach_target, split_name, semi_selected,
        describe_features, importance_stats, scaled_importance, positive_importance, avg_rank_desc, avg_rank_asc,
        top_n, top_n_abs, argmax_global, argmax_per_group, distinct_values, adjusted_r2, above_median, result_code,
        train_test_split, bootstrap_samples, union_replicates, kfold_assign, kfold_r2,
        gram_matrix, ols_univariate_r2, lasso_univariate, forward_step1, step_forward, step_forward_penalised,
        best_model, model_quality, lasso_path, lasso_path_exact, lasso_select, lasso_select_exact, rf_importance, rf_bootstrap,
        spearman_target, feature_pairs, spearman_pairs, spearman_pairs_lines, mic_grid, mic_optimized, mic_lookup, pair_table, blend_scores,
        suggestions,
    )
}
QUERIES["spearman_pvalue"] = spearman_p_values
QUERIES["feature_selection"] = feature_selection_job

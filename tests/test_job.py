import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelab.operators import stepwise
from sievelab.operators.forest import ForestSpec
from sievelab.operators.status import StatusTable, stage_events
from sievelab.plans import fixtures as fx
from sievelab.plans.feature_selection import Settings, feature_selection, write_job

AS_OF = dt.datetime(2024, 3, 1)
SMALL = Settings(forest=ForestSpec(replicates=2, trees=6, depth=5))


@pytest.fixture(scope="module")
def job(spark, sf):
    return feature_selection(
        fx.embeddings_wide(spark, sf), "y", "row_id", "job-7", "lab", AS_OF, settings=SMALL
    )


def test_planted_features_are_found(job):
    assert job.code == "0"
    top = [r["param"] for r in job.importance.orderBy(F.desc("importance_mean")).limit(3).collect()]
    assert set(top) == {"08", "35", "46"}
    assert set(fx.PLANTED) <= {r["variable"] for r in job.coefficients.collect()}
    signs = {r["variable"]: np.sign(r["score"]) for r in job.coefficients.collect()}
    assert all(signs[k] == np.sign(v) for k, v in fx.PLANTED.items())


def test_result_tables(job):
    assert job.importance.count() == 64
    rows = job.result.collect()
    assert len({r["suggestion"] for r in rows}) == len(rows) > 0
    scores = [r["mean_of_corr_mic"] for r in rows]
    assert scores == sorted(scores, reverse=True)
    own = [r for r in rows if r["final"] == r["suggestion"]]
    assert own and all(r["abs_spearman_fs"] == pytest.approx(1.0) for r in own)
    assert {r["code"] for r in rows} == {"0"} and {r["dt"] for r in rows} == {"20240301"}
    stages = [(r["status"], r["progress"]) for r in job.status.orderBy("event_id").collect()]
    assert stages == [
        ("STARTED", 0),
        ("RF_COMPLETED", 30),
        ("LASSO_COMPLETED", 50),
        ("STEP_FORWARD_COMPLETED", 70),
        ("MIC_COMPLETED", 90),
    ]
    assert job.dropped == {"forest": 0, "lasso": 0}


def test_details_agree(job):
    alphas = job.details["alphas"].toPandas()
    assert len(alphas) == 100 and alphas["alpha"].is_unique
    trace = job.details["trace"].orderBy("step").collect()
    assert [r["n_var"] for r in trace] == list(range(1, len(trace) + 1))
    screened = job.importance.where("importance_mean > 0").count()
    assert job.details["pairs"].count() == screened * job.coefficients.count()
    quality = {r["model"]: r for r in job.details["quality"].collect()}
    assert 0.9 < quality["lasso"]["r2"] <= 1 and quality["step_forward"]["adj_r2"] <= quality["step_forward"]["r2"] <= 1
    own = job.details["pairs"].where("final = suggestion").first()
    assert own["p_fs"] == pytest.approx(0.0) and 0 <= own["p_ts"] <= 1


def test_row_order_and_partitions_do_not_matter(spark, sf, job):
    shuffled = fx.embeddings_wide(spark, sf).repartition(13, F.rand(3))
    again = feature_selection(shuffled, "y", "row_id", "job-7", "lab", AS_OF, settings=SMALL)
    for name, keys in (("importance", ["param"]), ("coefficients", ["variable"]), ("result", ["final", "suggestion"])):
        left, right = (getattr(j, name).toPandas().sort_values(keys).reset_index(drop=True) for j in (job, again))
        for column in left.columns:
            if left[column].dtype == float:
                assert np.allclose(left[column], right[column], rtol=1e-8, atol=1e-10)
            else:
                assert left[column].tolist() == right[column].tolist()


def test_repeated_and_null_keys(spark, sf, job):
    wide = fx.embeddings_wide(spark, sf)
    halved = wide.withColumn("row_id", F.floor(F.col("row_id") / 2).cast("long"))
    again = feature_selection(halved, "y", "row_id", as_of=AS_OF, settings=SMALL)
    pairs = [
        {r["suggestion"]: r["abs_spearman_ts"] for r in j.details["pairs"].collect()} for j in (job, again)
    ]
    assert all(pairs[1][k] == pytest.approx(v) for k, v in pairs[0].items() if k in pairs[1])
    assert set(fx.PLANTED) <= set(pairs[1])
    gaps = wide.withColumn("row_id", F.when(F.col("row_id") % 9 > 0, F.col("row_id")))
    with pytest.raises(ValueError, match="null keys"):
        feature_selection(gaps, "y", "row_id", settings=SMALL)


def test_top_n_is_the_callers_choice(spark, sf):
    settings = Settings(forest=SMALL.forest, forest_top=5, lasso_top=2)
    job = feature_selection(fx.embeddings_wide(spark, sf), "y", "row_id", as_of=AS_OF, settings=settings)
    assert job.dropped["forest"] > 0 and job.details["lasso"].count() == 2


def test_write_job(spark, job, tmp_path):
    write_job(job, str(tmp_path))
    status = write_job(job, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "importance")).count() == 128
    assert spark.read.parquet(str(tmp_path / "result")).count() == 2 * job.result.count()
    last = status.orderBy(F.desc("event_id")).first()
    assert (last["status"], last["progress"]) == ("COMPLETED", 100)


def test_status_is_kept_while_the_job_runs(spark, sf, tmp_path, monkeypatch):
    table = StatusTable(spark, str(tmp_path / "status"))
    table.upsert(stage_events(spark, "other", "lab", [("STARTED", AS_OF)]))

    def broken(*args, **kwargs):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as patch:
        patch.setattr(stepwise, "step_forward", broken)
        with pytest.raises(RuntimeError, match="executor lost"):
            feature_selection(
                fx.embeddings_wide(spark, sf), "y", "row_id", "job-8", "lab", AS_OF, settings=SMALL, on_stage=table.upsert
            )
    rows = {r["jobid"]: (r["status"], r["progress"]) for r in table.read().collect()}
    assert rows == {"job-8": ("LASSO_COMPLETED", 50), "other": ("STARTED", 0)}
    small = make(spark, 40, float, {"s.a": float, "s.b": lambda i: float(i % 7)})
    job = feature_selection(small, "y", "row_id", "job-8", "lab", AS_OF, settings=SMALL, on_stage=table.upsert)
    assert table.read().where("jobid = 'job-8'").first()["status"] == "MIC_COMPLETED"
    write_job(job, str(tmp_path / "out"), on_stage=table.upsert)
    row = table.read().where("jobid = 'job-8'").first()
    assert (row["status"], row["progress"], row["area"]) == ("COMPLETED", 100, "lab")


def make(spark, n, y, features, extra=""):
    rows = [(i, y(i), *[f(i) for f in features.values()]) for i in range(n)]
    names = ", ".join(f"`{name}` double" for name in features)
    return spark.createDataFrame(rows, f"row_id long, y double, {names}")


@pytest.mark.parametrize(
    ("n", "y", "feature", "code"),
    [
        (0, float, float, "-1"),
        (9, float, float, "-4"),
        (9, lambda i: 1.0, float, "-4"),
        (12, lambda i: 1.0, float, "-2"),
        (12, float, lambda i: 5.0, "-3"),
        (12, float, lambda i: None, "-3"),
    ],
)
def test_guards_stop_the_job(spark, n, y, feature, code):
    job = feature_selection(make(spark, n, y, {"a.b": feature}), "y", "row_id", as_of=AS_OF)
    assert job.code == code
    rows = job.importance.collect()
    assert [(r["code"], r["param"], r["step"]) for r in rows] == [(code, "error", "error")]
    assert job.coefficients.count() == job.result.count() == 0
    assert [r["status"] for r in job.status.collect()] == ["STARTED"]


def test_failed_event_is_optional(spark):
    df = make(spark, 3, float, {"a.b": float})
    job = feature_selection(df, "y", "row_id", as_of=AS_OF, settings=Settings(failed_event=True))
    assert [r["status"] for r in job.status.orderBy("event_id").collect()] == ["STARTED", "FAILED"]


def test_text_feature_is_refused(spark):
    df = spark.createDataFrame([(1, 1.0, "a")], "row_id long, y double, `s.t` string")
    with pytest.raises(ValueError, match="s.t"):
        feature_selection(df, "y", "row_id")


def test_small_job_with_gaps_and_no_row_key(spark):
    rng = np.random.default_rng(0)
    signal = rng.normal(size=28)
    df = make(
        spark,
        28,
        lambda i: None if i == 4 else float(2 * signal[i] + 0.1 * rng.normal()),
        {
            "s.a": lambda i: None if i % 9 == 2 else float(signal[i]),
            "s.b": lambda i: float(rng.normal()),
            "s.c": lambda i: float("nan") if i == 5 else float(rng.normal()),
            "s.const": lambda i: 1.0,
        },
    ).drop("row_id")
    job = feature_selection(df, "y", as_of=AS_OF, settings=SMALL)
    assert job.code == "0"
    assert job.importance.count() == 3
    assert job.coefficients.orderBy(F.desc("abs_score")).first()["variable"] == "s.a"


def test_lasso_that_keeps_nothing(spark):
    rng = np.random.default_rng(1)
    df = make(spark, 60, lambda i: float(rng.normal()), {"s.a": lambda i: float(rng.normal()), "s.b": float})
    settings = Settings(forest=SMALL.forest, alphas=(3.0, 4.0, 3))
    job = feature_selection(df, "y", "row_id", as_of=AS_OF, settings=settings)
    assert job.code == "1"
    assert {r["code"] for r in job.importance.collect()} == {"1"}
    assert job.coefficients.count() == job.result.count() == 0


def test_single_feature_has_no_pair_above_the_median(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=80)
    df = make(spark, 80, lambda i: float(x[i] + 0.1 * rng.normal()), {"s.a": lambda i: float(x[i])})
    job = feature_selection(df, "y", "row_id", as_of=AS_OF, settings=SMALL)
    assert job.code == "2" and job.result.count() == 0 and job.coefficients.count() == 1

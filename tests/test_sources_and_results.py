import datetime as dt
import random
from pathlib import Path
from types import SimpleNamespace
from urllib.parse import unquote, urlparse

import pytest

from sievelab.operators import cleaning, ranking, results
from sievelab.sources import files, jdbc, scratch

AS_OF = dt.datetime(2024, 3, 1, 23, 59)


def test_csv_with_dotted_header(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5, None), (2, None, "x")], "row_id long, `a.b` double, LOT_ID string")
    path = str(tmp_path / "job")
    df.write.option("header", True).csv(path)
    for schema in (None, df.schema):
        back = files.read_job_csv(spark, path, schema)
        assert back.columns == df.columns
        got = back.select(files.column("a.b")).collect()
        assert sorted(str(r[0]) for r in got) == ["1.5", "None"]


def test_csv_read_failure_is_raised(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_job_csv(spark, str(tmp_path / "absent"))


def test_jdbc_options():
    assert jdbc.jdbc_options("jdbc:x", query="SELECT 1") == {"url": "jdbc:x", "fetchsize": "10000", "query": "SELECT 1"}
    whole = jdbc.jdbc_options("jdbc:x", table="t", user="u", password="p", driver="d.D")
    assert whole["dbtable"] == "t" and whole["user"] == "u" and whole["driver"] == "d.D"
    split = jdbc.jdbc_options(
        "jdbc:x", query="SELECT * FROM t", partition_column="id", lower_bound=0, upper_bound=9, num_partitions=3
    )
    assert split["dbtable"] == "(SELECT * FROM t) src" and split["numPartitions"] == "3" and "query" not in split
    with pytest.raises(ValueError):
        jdbc.jdbc_options("jdbc:x")
    with pytest.raises(ValueError):
        jdbc.jdbc_options("jdbc:x", table="t", query="q")
    with pytest.raises(ValueError):
        jdbc.jdbc_options("jdbc:x", table="t", partition_column="id")


def test_clock_row(spark):
    row = files.clock(spark, "hello").first()
    assert row["message"] == "hello" and row["spark_date"] == row["spark_timestamp"].date()


def test_first_rows_and_projection(spark):
    df = spark.range(30).selectExpr("id", "id * 2 AS `a.b`", "'x' AS t")
    assert files.first_rows(df, 5).count() == 5
    assert files.project(df, ["a.b"]).columns == ["a.b"]
    assert files.table_count(df).first()["n_rows"] == 30


def session_stub(conf, checkpoint=None, master="yarn"):
    context = SimpleNamespace(getCheckpointDir=lambda: checkpoint, master=master)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: conf.get(key, default)), sparkContext=context)


def test_scratch_folder_comes_from_the_cluster():
    assert scratch.scratch_root(session_stub({"spark.checkpoint.dir": "hdfs:/shared/"})) == "hdfs:/shared"
    assert scratch.scratch_root(session_stub({}, "s3a://bucket/cp")) == "s3a://bucket/cp"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_root(session_stub({}))


def test_saved_table_is_read_back(spark):
    saved = scratch.save_table(spark.range(7).selectExpr("id AS `a.b`"), "numbers")
    assert saved.columns == ["a.b"] and saved.count() == 7
    assert "Range" not in saved._jdf.queryExecution().optimizedPlan().toString()


def test_saved_texts_take_less_than_by_default(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(f"word{rng.randrange(5_000)}" for _ in range(300)) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    rows.write.parquet(str(tmp_path / "plain"))
    saved = scratch.save_table(rows, "texts")
    assert sorted(r["text"] for r in saved.collect()) == sorted(texts)
    files = [Path(unquote(urlparse(f).path)) for f in saved.inputFiles()]
    assert sum(f.stat().st_size for f in files) < 0.8 * sum(f.stat().st_size for f in (tmp_path / "plain").glob("*.parquet"))


def test_sinks_append_by_day(spark, tmp_path):
    path = str(tmp_path / "importance")
    stats = spark.createDataFrame([("s.p", 0.25), ("s.q.r", 0.75), ("plain", 0.0)], "variable string, mean double")
    results.append_table(results.importance_rows(stats, cleaning.OK, "j1", AS_OF), path)
    results.append_table(results.error_row(spark, cleaning.EMPTY, "j2", AS_OF + dt.timedelta(days=1)), path)
    back = spark.read.parquet(path)
    assert sorted(back.columns) == sorted(results.IMPORTANCE_COLUMNS)
    rows = {(r["job_id"], r["code"], r["step"], r["param"], r["importance_mean"], str(r["dt"])) for r in back.collect()}
    assert rows == {
        ("j1", "0", "s", "p", 0.25, "20240301"),
        ("j1", "0", "s", "q", 0.75, "20240301"),
        ("j1", "0", "plain", None, 0.0, "20240301"),
        ("j2", "-1", "error", "error", None, "20240302"),
    }
    plan = spark.read.parquet(path).where("dt = 20240302")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan


def test_ranking_ties(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("c", 2.0), ("b", 2.0), ("d", None), ("e", -3.0)], "variable string, mean double"
    )
    assert [r["variable"] for r in ranking.top_n(df, "mean", 2).collect()] == ["b", "c"]
    assert [r["variable"] for r in ranking.top_n_abs(df, "mean", 2).collect()] == ["e", "b"]
    assert ranking.argmax(df, "mean", ["variable"]).first()["variable"] == "b"
    assert ranking.argmax(df.where("mean IS NULL"), "mean", ["variable"]).count() == 0
    assert {r["variable"] for r in ranking.above_median(df, "mean").collect()} == {"b", "c"}


def test_result_code(spark):
    rows = spark.range(2)
    assert ranking.result_code(rows).first()["code"] == "0"
    assert ranking.result_code(rows.where("id > 5")).first()["code"] == "2"

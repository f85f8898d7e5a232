import datetime as dt
import random

import pytest

from sievelab.operators import status
from sievelab.plans import fixtures as fx
from sievelab.streaming.status_feed import follow_status, read_status

T0 = dt.datetime(2024, 1, 1)


def event(i, job, stage, area="x"):
    return (job, area, stage, status.STAGES.get(stage), T0 + dt.timedelta(minutes=i), i)


def replay(rows):
    """Events applied one by one to a dictionary."""
    table = {}
    for job, area, stage, progress, ts, _ in rows:
        if job in table:
            table[job] = (table[job][0], stage, progress, table[job][3], ts)
        else:
            table[job] = (area, stage, progress, ts, None)
    return table


def as_dict(df):
    return {
        r["jobid"]: (r["area"], r["status"], r["progress"], r["start_time"], r["update_time"]) for r in df.collect()
    }


@pytest.mark.parametrize("seed", range(3))
def test_upsert_equals_fold_equals_replay(spark, seed):
    rng = random.Random(seed)
    stages = list(status.STAGES)
    rows = [event(i, f"j{rng.randrange(6)}", rng.choice(stages), f"area{i}") for i in range(40)]
    events = spark.createDataFrame(rows, status.EVENT_SCHEMA)
    assert as_dict(status.status_of(events)) == replay(rows)
    table = spark.createDataFrame([], status.STATUS_SCHEMA)
    for start in (0, 1, 9, 25):
        stop = {0: 1, 1: 9, 9: 25, 25: 40}[start]
        table = status.upsert_status(table, events.where(f"event_id >= {start} AND event_id < {stop}"))
    assert as_dict(table) == replay(rows)


def test_new_and_known_job(spark):
    first = spark.createDataFrame([event(0, "a", "STARTED", "north")], status.EVENT_SCHEMA)
    table = status.upsert_status(spark.createDataFrame([], status.STATUS_SCHEMA), first)
    assert as_dict(table) == {"a": ("north", "STARTED", 0, T0, None)}
    later = spark.createDataFrame([event(5, "a", "RF_COMPLETED", "south")], status.EVENT_SCHEMA)
    assert as_dict(status.upsert_status(table, later)) == {
        "a": ("north", "RF_COMPLETED", 30, T0, T0 + dt.timedelta(minutes=5))
    }


def test_listing_order(spark):
    rows = [event(0, "b", "STARTED"), event(1, "a", "STARTED"), event(2, "c", "STARTED")]
    rows += [event(3, "a", "COMPLETED"), event(4, "c", "COMPLETED"), event(5, "d", "STARTED")]
    table = status.status_of(spark.createDataFrame(rows, status.EVENT_SCHEMA))
    assert [r["jobid"] for r in status.list_status(table).collect()] == ["b", "d", "c", "a"]


def test_stage_events(spark):
    reached = [("STARTED", T0), ("RF_COMPLETED", T0 + dt.timedelta(minutes=1)), ("FAILED", T0)]
    got = status.stage_events(spark, "j", "x", reached).orderBy("event_id").collect()
    assert [(r["status"], r["progress"]) for r in got] == [("STARTED", 0), ("RF_COMPLETED", 30), ("FAILED", None)]


def test_stream_of_events_keeps_the_table(spark, sf, tmp_path):
    events = fx.status_log(spark, sf)
    for low, high in ((0, 400), (400, 401), (401, 10**9)):
        part = events.where(f"event_id >= {low} AND event_id < {high}")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = (
        spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    )
    query = follow_status(stream, str(tmp_path / "status"), str(tmp_path / "progress"))
    assert query.awaitTermination(120)
    got = read_status(spark, str(tmp_path / "status"))
    assert got.count() == events.select("jobid").distinct().count()
    # The log is cut by event id; replay its parts in that order, each by time.
    rows = [tuple(r) for r in events.collect()]
    part = {True: 0, False: 2}
    rows.sort(key=lambda r: (1 if r[5] == 400 else part[r[5] < 400], r[4], r[5]))
    assert as_dict(got) == replay(rows)

"""Event-time windows on tables and streams."""

import datetime

from skein.streaming import windows


def at(day, hour=0, minute=0):
    return datetime.datetime(2024, 1, day, hour, minute)


def events(spark):
    rows = [(1, at(1, 1), "a", 1.0), (1, at(1, 1, 30), "a", 2.0), (1, at(1, 3), "b", 4.0), (2, at(2), "a", 8.0), (2, at(2), "a", 8.0)]
    return spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_type string, value double")


def test_windows(spark, rows):
    e = events(spark)
    assert rows(windows.tumbling(e, "1 day").select("start", "event_type", "n", "s")) == [(at(1), "a", 2, 3.0), (at(1), "b", 1, 4.0), (at(2), "a", 2, 16.0)]
    assert windows.sliding(e, "2 days", "1 day").agg({"n": "sum"}).first()[0] == 10
    assert rows(windows.session(e, "1 hour").select("user_id", "start", "n")) == [(1, at(1, 1), 2), (1, at(1, 3), 1), (2, at(2), 2)]
    assert windows.deduplicate(e, ["user_id", "ts"]).count() == 4
    assert windows.tumbling(e.limit(0), "1 day").count() == 0


def test_stream_equals_batch(spark, rows, tmp_path):
    events(spark).repartition(2).write.parquet(str(tmp_path / "in"))
    build = lambda e: windows.tumbling(windows.deduplicate(e, ["user_id", "ts"]), "1 day")
    out = windows.run_stream(spark, str(tmp_path / "in"), "*.parquet", lambda e: windows.tumbling(e, "1 day"), "t")
    assert rows(out) == rows(windows.tumbling(events(spark), "1 day"))
    assert build(events(spark)).count() == 3

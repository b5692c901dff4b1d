from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestrata.streaming import facade


def test_windows_equal_batch(spark, tmp_path, rows):
    t0 = datetime(2026, 1, 1)
    df = spark.createDataFrame([(i, t0 + timedelta(minutes=13 * i), "ab"[i % 2]) for i in range(60)], "id int, ts timestamp_ntz, k string")
    df.repartition(3).write.parquet(str(tmp_path / "ev.parquet"))
    got = facade.run_to_table(spark, str(tmp_path), "ev", lambda s: facade.windowed_counts(s, "ts", "1 hour", ["k"], late="90 days"), "append_last")
    want = df.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz"), "k").agg(F.count("*"))
    assert rows(got, "window_start", "k", "n") == rows(want)


def test_distinct_and_repeats(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (2, "u", "a"), (3, "u", "a")], "id int, u string, c string").coalesce(1)
    df.write.parquet(str(tmp_path / "ev.parquet"))
    assert rows(facade.run_to_table(spark, str(tmp_path), "ev", lambda s: facade.distinct_events(s, ["id"]).select("id"))) == [(1,), (2,), (3,)]
    assert rows(facade.run_to_table(spark, str(tmp_path), "ev", lambda s: facade.repeated_calls(s, "u", "c", 3))) == [("u", "a", 3), ("u", "a", 4)]

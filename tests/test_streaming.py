from pyspark.sql import functions as F

from meshwright.streaming.refresh import event_windows, refresh


def test_refresh_takes_up_only_new_contents(spark, tmp_path):
    landing, cache, progress = (str(tmp_path / n) for n in ("landing", "cache", "progress"))
    put = lambda rows: spark.createDataFrame(rows, "rel_path string, text string").coalesce(1).write.mode("append").parquet(landing)
    put([("a.py", "def f():\n    pass\n"), ("b.txt", "x")])
    refresh(spark, landing, cache, progress).awaitTermination()
    put([("a.py", "def f():\n    pass\n"), ("a.py", "def g():\n    pass\n")])
    refresh(spark, landing, cache, progress).awaitTermination()
    rows = spark.read.parquet(cache).collect()
    assert sorted((r.rel_path, sorted(r.identities)) for r in rows) == [("a.py", ["a.py", "a.py:f"]), ("a.py", ["a.py", "a.py:g"]), ("b.txt", [])]


def test_windows_on_a_stream_leave_out_late_rows(spark, tmp_path):
    def land(n, rows):
        made = spark.createDataFrame(rows, "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
        made.coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))

    land(1, [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 09:00:00", "a", 2.0)])
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    run = lambda: event_windows(stream).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    run()
    land(2, [("2024-01-01 00:20:00", "a", 5.0), ("2024-01-01 20:00:00", "a", 2.0)])
    run()
    got = {r.start.hour: r.total for r in spark.read.parquet(out).collect()}
    assert got[0] == 1.0 and got[9] == 2.0

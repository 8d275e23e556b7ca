"""Streams against their batch results."""

from pyspark.sql import functions as F

from strandlake.streaming import coverage


def run(spark, make, rows, tmp_path, mode="append"):
    for part in rows:
        spark.createDataFrame(part, "k string, ts string, v double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k string, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = make(source).writeStream.format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "state")).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return spark.table("out")


def test_binned(spark, tmp_path):
    rows = [[("a", "2024-01-01 00:00:01", 2.0), ("a", "2024-01-01 00:00:09", 4.0), ("b", "2024-01-01 00:00:05", 1.0)], [("a", "2024-01-01 00:10:00", 9.0)], [("a", "2024-01-01 00:20:00", 9.0)]]
    got = run(spark, lambda s: coverage.binned_stream(s, "k", "ts", "v", "10 seconds", "1 minute"), rows, tmp_path)
    found = {(r.k, r.start.strftime("%H:%M:%S")): (r.mean_value, r.n) for r in got.collect()}
    assert found["a", "00:00:00"] == (3.0, 2) and found["b", "00:00:00"] == (1.0, 1) and ("a", "00:20:00") not in found


def test_sessions_and_first_seen(spark, tmp_path):
    rows = [[("a", "2024-01-01 00:00:01", 2.0), ("a", "2024-01-01 00:00:04", 4.0), ("a", "2024-01-01 00:01:00", 1.0)], [("z", "2024-01-01 01:00:00", 9.0)], [("z", "2024-01-01 02:00:00", 9.0)]]
    got = run(spark, lambda s: coverage.sessions_stream(s, "k", "ts", "10 seconds", "1 minute"), rows, tmp_path)
    assert sorted(r.n for r in got.where("k = 'a'").collect()) == [1, 2]
    seen = run(spark, lambda s: coverage.first_seen_stream(s, "k", "ts", "2 hours"), rows, tmp_path / "2")
    assert sorted(r.k for r in seen.collect()) == ["a", "z"]

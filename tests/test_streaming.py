from pyspark.sql import functions as F

from tessera.streaming.running import running_scan, session_sums, windowed_sums


def _run(stream, mode, name):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()


def _events(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", "ab"[i % 2], float(i)) for i in range(40)]
    spark.createDataFrame(rows, "id long, t string, k string, x double").withColumn("ts", F.to_timestamp("t")).write.parquet(f"{tmp_path}/e")
    batch = spark.read.parquet(f"{tmp_path}/e")
    return batch, spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e")


def test_windows(spark, tmp_path):
    batch, stream = _events(spark, tmp_path)
    _run(windowed_sums(stream, "ts", "x", ["k"], late="1 day"), "complete", "tumbling")
    want = batch.groupBy(F.window("ts", "10 minutes"), "k").agg(F.sum("x").alias("total"))
    key = lambda r: (r.window.start, r.k, r.total)
    assert sorted(map(key, spark.table("tumbling").collect())) == sorted(map(key, want.collect()))
    _run(session_sums(stream, "ts", "x", ["k"], late="1 day"), "complete", "sessions")
    assert sorted((r.k, r.n) for r in spark.table("sessions").collect()) == [("a", 20), ("b", 20)]


def test_running_scan(spark, tmp_path):
    batch, _ = _events(spark, tmp_path)
    batch.coalesce(1).write.parquet(f"{tmp_path}/one")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/one")
    _run(running_scan(stream, "k", "id", "x", 0.5), "append", "scan")
    h = {"a": 0.0, "b": 0.0}
    want = []
    for i in range(40):
        h["ab"[i % 2]] = 0.5 * h["ab"[i % 2]] + i
        want.append(("ab"[i % 2], i, h["ab"[i % 2]]))
    assert sorted((r.k, r.id, r.h) for r in spark.table("scan").collect()) == sorted(want)

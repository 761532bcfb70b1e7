from pyspark.sql import functions as F

from tessera.operators import window


def test_affine_scan_of_long_keys(spark):
    rows = [(k, i, [0.9, 0.5, 0.0, -1.0][k], float(i % 7) - (k == 3)) for k in range(4) for i in range(20_000)]
    frame = spark.createDataFrame(rows + [(4, 0, None, 1.0), (4, 1, None, None), (None, 0, 0.5, 2.0)], "k int, i int, a double, x double")
    got = {(r.k, r.i): r.y for r in window.affine_scan(frame, F.col("a"), F.col("x"), ["k"], ["i"]).collect()}
    h = {}
    for k, i, a, x in rows:
        h[k] = a * h.get(k, 0.0) + x
        assert abs(got[k, i] - h[k]) < 1e-9 * max(1.0, abs(h[k])), (k, i)
    assert got[4, 0] == got[4, 1] == 1.0 and got[None, 0] == 2.0
    assert window.affine_scan(frame.limit(0), F.col("a"), F.col("x"), ["k"], ["i"]).count() == 0


def test_cumprod_is_a_product(spark):
    frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate([2, -3, 5, 0, 7])], "i int, x double").withColumn("k", F.lit(1))
    got = frame.withColumn("y", window.running("cumprod", F.col("x"), window.ordered(["k"], ["i"]))).orderBy("i").collect()
    assert [r.y for r in got] == [2.0, -6.0, -30.0, 0.0, 0.0]

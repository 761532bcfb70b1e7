import json
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import raw


def test_plain_files_of_any_type(spark, tmp_path):
    for dtype in ("<i8", "<i4", ">i4", "<u2", "|i1", "<f4", "<f8", "|b1", "<c16"):
        values = (np.arange(1000) * 37 % 251).astype(dtype)
        path = tmp_path / f"{np.dtype(dtype).str[1:]}{dtype[0] == '>'}.bin"
        values.tofile(path)
        got = raw.fromfile(spark, f"file://{path}", dtype, range_bytes=512).orderBy("pos").collect()
        assert [r.pos for r in got] == list(range(1000))
        assert [complex(r.value.re, r.value.im) if dtype == "<c16" else r.value for r in got] == values.tolist()
    part = raw.fromfile(spark, f"file://{path}", "<c16", count=10, offset=32).orderBy("pos").collect()
    assert [r.value.re for r in part] == values[2:12].real.tolist()


def test_ranges_are_many_tasks_of_whole_elements(spark, tmp_path):
    np.arange(5000, dtype="<i4").tofile(tmp_path / "a.bin")
    frame = raw.fromfile(spark, f"file://{tmp_path}/a.bin", "<i4", range_bytes=1001)
    assert frame.rdd.getNumPartitions() == 20 and frame.agg(F.sum("value")).first()[0] == sum(range(5000))


def test_files_in_the_manifest_are_the_array(spark, tmp_path):
    path = tmp_path / "out"
    frame = spark.range(3000).select((2999 - F.col("id")).alias("at"), (F.col("id") * 3 + (1 << 60)).alias("v")).repartition(6)
    raw.tofile(frame, f"file://{path}", "<i8", "at", "v", (30, 100))
    (path / "part-orphan.bin").write_bytes(b"left by a failed task")
    manifest = json.loads((path / raw.MANIFEST).read_text())
    data = b"".join((path / f["name"]).read_bytes() for f in manifest["files"])
    want = (2999 - np.arange(3000)) * 3 + (1 << 60)
    np.testing.assert_array_equal(np.frombuffer(data, dtype="<i8"), want)
    assert raw.shape_of(f"file://{path}") == (30, 100)
    assert [r.value for r in raw.fromfile(spark, f"file://{path}").orderBy("pos").collect()] == want.tolist()


def test_what_does_not_fit(spark, tmp_path):
    frame = spark.range(10).withColumnRenamed("id", "pos")
    with pytest.raises(Exception, match="outside"):
        raw.tofile(frame.withColumn("value", F.col("pos") * 100), f"file://{tmp_path}/a", "|i1")
    with pytest.raises(Exception, match="NULL"):
        raw.tofile(frame.withColumn("value", F.lit(None).cast("double")), f"file://{tmp_path}/b")
    with pytest.raises(Exception, match="shape"):
        raw.tofile(frame.withColumn("value", F.col("pos")), f"file://{tmp_path}/c", "<i8", shape=(3, 3))
    assert not pathlib.Path(tmp_path / "c" / raw.MANIFEST).exists()
    with pytest.raises(ValueError):
        raw.spark_type("<u8")


def test_empty(spark, tmp_path):
    raw.tofile(spark.createDataFrame([], "pos long, value double"), f"file://{tmp_path}/e")
    assert raw.fromfile(spark, f"file://{tmp_path}/e").count() == 0 and raw.shape_of(f"file://{tmp_path}/e") == (0,)


def test_bytes_in_columns(spark):
    frame = spark.createDataFrame([(1, [1.5, -2.0]), (2, []), (3, None)], "i int, v array<double>")
    back = frame.select("i", "v", raw.tobytes(F.col("v")).alias("b")).withColumn("w", raw.frombuffer(F.col("b"))).orderBy("i").collect()
    assert [bytes(r.b) if r.b is not None else None for r in back] == [np.array([1.5, -2.0]).tobytes(), b"", None]
    assert [r.w for r in back] == [r.v for r in back]

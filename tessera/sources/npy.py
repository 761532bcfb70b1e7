"""Spark data source for .npy and .npz files: one partition for each array, rows of (file, name, pos, value).

Only the header is read to plan; a task streams its array in blocks of BLOCK elements. ``value`` is a double; integers
beyond 53 bits lose their last digits there, and complex arrays give their real part in ``value`` and the other in ``imag``.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

BLOCK = 1 << 16


class ArrayFile(InputPartition):
    def __init__(self, path: str, member: str | None):
        self.path, self.member = path, member


class NpyReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[ArrayFile]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        files = [info.path] if info.type == pafs.FileType.File else [i.path for i in fs.get_file_info(pafs.FileSelector(root, recursive=True))]
        out = []
        for path in sorted(files):
            if path.endswith(".npy"):
                out.append(ArrayFile(path, None))
            elif path.endswith(".npz"):
                with fs.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
                    out += [ArrayFile(path, m) for m in archive.namelist() if m.endswith(".npy")]
        return out

    def read(self, partition: ArrayFile) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(partition.path) as file:
            if partition.member is None:
                yield from _blocks(file, partition.path, "")
            else:
                with zipfile.ZipFile(file) as archive, archive.open(partition.member) as member:
                    yield from _blocks(member, partition.path, partition.member.removesuffix(".npy"))


def _blocks(stream, path: str, name: str) -> Iterator[pa.RecordBatch]:
    version = np.lib.format.read_magic(stream)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(stream)
    if dtype.hasobject:
        raise ValueError(f"{path}: arrays of Python objects are not read")
    total = int(np.prod(shape, dtype=np.int64))
    for at in range(0, total, BLOCK):
        count = min(BLOCK, total - at)
        block = np.frombuffer(stream.read(count * dtype.itemsize), dtype=dtype)
        pos = np.arange(at, at + count)
        if fortran and len(shape) > 1:
            pos = np.ravel_multi_index(np.unravel_index(pos, shape, order="F"), shape)
        values = block.real if block.dtype.kind == "c" else block
        imag = block.imag if block.dtype.kind == "c" else np.zeros(count)
        columns = [pa.array([path] * count), pa.array([name] * count), pa.array(pos.astype(np.int64)), pa.array(values.astype(np.float64)), pa.array(imag.astype(np.float64))]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "name", "pos", "value", "imag"])


class NpyWriter(DataSourceArrowWriter):
    """One .npy part for each task; the values of a task in the order of its rows."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import uuid

        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        parts = [batch.column("value").to_numpy(zero_copy_only=False) for batch in iterator]
        if parts:
            buffer = io.BytesIO()
            np.save(buffer, np.concatenate(parts))
            with fs.open_output_stream(f"{root}/part-{uuid.uuid4().hex}.npy") as out:
                out.write(buffer.getvalue())
        return WriterCommitMessage()


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "file string, name string, pos bigint, value double, imag double"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"])


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").load(path)


def write_npy(frame: DataFrame, path: str, value: str = "value") -> None:
    frame.sparkSession.dataSource.register(NpySource)
    frame.selectExpr(f"cast(`{value}` as double) as value").write.format("npy").mode("append").save(path)

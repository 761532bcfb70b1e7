"""Raw binary arrays: a source that cuts files of fixed-width elements by byte ranges, a sink with a manifest, and bytes in columns.

Files hold little-endian elements one after another. Reading plans ranges of whole elements, so a large file is many tasks.
Writing deals rows into ranges of their position; a task streams its range into a file of its own and reports it, and only
the manifest, written once all tasks are done, says which files count, in what order, of which type and shape. Files that
failed or repeated tasks leave behind are in no manifest and are never read. Types are kept: integers of 64 bits exactly,
complex numbers as (re, im), booleans as such. The files in the manifest's order, one after another, are the plain array.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a file in one task, about, and elements in one batch.
RANGE = 64 << 20
BATCH = 1 << 16
MANIFEST = "_manifest.json"
COMPLEX = "struct<re:double,im:double>"


def spark_type(dtype: str) -> str:
    kind = np.dtype(dtype)
    if kind.kind == "u" and kind.itemsize == 8:
        raise ValueError("unsigned integers of 64 bits have no Spark type")
    return {"b": "boolean", "i": "bigint", "u": "bigint", "f": "double", "c": COMPLEX}[kind.kind]


def to_arrow(values: np.ndarray) -> pa.Array:
    if values.dtype.kind == "c":
        return pa.StructArray.from_arrays([pa.array(values.real.astype(np.float64)), pa.array(values.imag.astype(np.float64))], names=["re", "im"])
    return pa.array(values.astype({"b": np.bool_, "i": np.int64, "u": np.int64, "f": np.float64}[values.dtype.kind]))


def to_numpy(column: pa.Array, dtype: str) -> np.ndarray:
    kind = np.dtype(dtype).newbyteorder("<")
    if column.null_count:
        raise ValueError("a raw array has no place for NULL")
    if kind.kind == "c":
        re, im = (column.field(n).to_numpy(zero_copy_only=False) for n in ("re", "im"))
        made = np.empty(len(column), dtype=np.complex128)
        made.real, made.imag = re, im  # arithmetic would turn infinities to NaN and drop signs of zeros
        return made.astype(kind)
    values = column.to_numpy(zero_copy_only=False)
    made = values.astype(kind)
    if kind.kind in "iu" and not (made.astype(np.int64) == values).all():
        raise ValueError(f"a value is outside {dtype}")
    return made


@dataclass
class Cut(InputPartition):
    path: str
    begin: int  # of the first element, in bytes
    count: int
    pos: int


class RawReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.range = options["path"], int(options.get("range", RANGE))
        self.dtype, self.offset, self.count = options.get("dtype", "<f8"), int(options.get("offset", 0)), int(options.get("count", -1))

    def partitions(self) -> list[Cut]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        width = np.dtype(self.dtype).itemsize
        manifest = _manifest(fs, root)
        files = [(f"{root}/{f['name']}", 0, f["count"]) for f in manifest["files"]] if manifest else [(root, self.offset, (fs.get_file_info(root).size - self.offset) // width)]
        left, out, pos = (self.count if self.count >= 0 else math.inf), [], 0
        step = max(1, self.range // width)
        for path, begin, total in files:
            total = int(min(total, left))
            left -= total
            out += [Cut(path, begin + at * width, min(step, total - at), pos + at) for at in range(0, total, step)]
            pos += total
        return out or [Cut("", 0, 0, 0)]

    def read(self, cut: Cut) -> Iterator[pa.RecordBatch]:
        if not cut.count:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        kind = np.dtype(self.dtype).newbyteorder("<") if np.dtype(self.dtype).byteorder in "=|" else np.dtype(self.dtype)
        with fs.open_input_file(cut.path) as file:
            file.seek(cut.begin)
            for at in range(0, cut.count, BATCH):
                count = min(BATCH, cut.count - at)
                data = file.read(count * kind.itemsize)
                if len(data) < count * kind.itemsize:
                    raise ValueError(f"{cut.path} ends early")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(cut.pos + at, cut.pos + at + count)), to_arrow(np.frombuffer(data, dtype=kind))], names=["pos", "value"])


@dataclass
class Written(WriterCommitMessage):
    name: str
    first: int
    count: int


class RawWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.dtype, self.shape = options["path"], options["dtype"], json.loads(options.get("shape", "null"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        name, first, count, out = f"part-{uuid.uuid4().hex}.bin", 0, 0, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    out, first = fs.open_output_stream(f"{root}/{name}"), batch.column("pos")[0].as_py()
                out.write(to_numpy(batch.column("value"), self.dtype).tobytes())
                count += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(name, first, count)

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted((m for m in messages if m and m.count), key=lambda m: m.first)
        total = sum(m.count for m in files)
        shape = self.shape if self.shape is not None else [total]
        if math.prod(shape) != total:
            raise ValueError(f"{total} elements don't fill shape {shape}")
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps({"dtype": self.dtype, "shape": shape, "files": [{"name": m.name, "count": m.count} for m in files]}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            if m and m.count:
                fs.delete_file(f"{root}/{m.name}")


class RawSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_array"

    def schema(self) -> str:
        return f"pos bigint, value {spark_type(self.options.get('dtype', '<f8'))}"

    def reader(self, schema) -> RawReader:
        return RawReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> RawWriter:
        return RawWriter(dict(self.options))


def _manifest(fs: pafs.FileSystem, root: str) -> dict | None:
    if fs.get_file_info(root).type != pafs.FileType.Directory:
        return None
    with fs.open_input_file(f"{root}/{MANIFEST}") as file:
        return json.loads(file.read())


def _options(**options) -> dict[str, str]:
    return {k: v if isinstance(v, str) else json.dumps(v) for k, v in options.items() if v is not None}


def fromfile(spark: SparkSession, path: str, dtype: str | None = None, count: int = -1, offset: int = 0, range_bytes: int = RANGE) -> DataFrame:
    """(pos, value) of a raw file, or of what ``tofile`` wrote (which knows its type)."""
    if dtype is None:
        manifest = _manifest(*pafs.FileSystem.from_uri(path))
        dtype = manifest["dtype"] if manifest else "<f8"
    spark.dataSource.register(RawSource)
    return spark.read.format("raw_array").options(**_options(path=path, dtype=dtype, count=count, offset=offset, range=range_bytes)).load()


def shape_of(path: str) -> tuple[int, ...]:
    return tuple(_manifest(*pafs.FileSystem.from_uri(path))["shape"])


def tofile(frame: DataFrame, path: str, dtype: str = "<f8", pos: str = "pos", value: str = "value", shape: Sequence[int] | None = None) -> None:
    """Write a vector frame in order of its positions; the frame's cells fill ``shape`` in C order if one is given."""
    frame.sparkSession.dataSource.register(RawSource)
    kind = spark_type(dtype)
    given = F.col(f"`{value}`").cast(kind) if kind != COMPLEX else F.col(f"`{value}`")
    dealt = frame.select(F.col(f"`{pos}`").cast("long").alias("pos"), given.alias("value")).repartitionByRange("pos").sortWithinPartitions("pos")
    dealt.write.format("raw_array").mode("append").options(**_options(path=path, dtype=dtype, shape=list(shape) if shape is not None else None)).save()


def frombuffer(data: Column, dtype: str = "<f8", count: int = -1, offset: int = 0) -> Column:
    """The elements that a column of bytes holds, as an array; NULL of NULL. Bytes that make no whole element raise."""
    kind = np.dtype(dtype)

    @F.arrow_udf(T.ArrayType(T._parse_datatype_string(spark_type(dtype))))
    def decode(column: pa.Array) -> pa.Array:
        arrays = []
        for value in column:
            raw = value.as_py()
            arrays.append(None if raw is None else to_arrow(np.frombuffer(raw, dtype=kind, count=count, offset=offset)).to_pylist())
        return pa.array(arrays, pa.list_(to_arrow(np.zeros(0, dtype=kind)).type))

    return decode(data)


def tobytes(array: Column, dtype: str = "<f8") -> Column:
    """The elements of an array as little-endian bytes; NULL of NULL."""

    @F.arrow_udf(T.BinaryType())
    def encode(column: pa.Array) -> pa.Array:
        return pa.array([None if not v.is_valid else to_numpy(v.values, dtype).tobytes() for v in column], pa.binary())

    return encode(array.cast(f"array<{spark_type(dtype)}>") if spark_type(dtype) != COMPLEX else array)

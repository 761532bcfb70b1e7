"""Media columns: payloads stored as images in archives, behind a Spark data source of their own.

Writing: each task streams its rows as members into ZIP archives of about ARCHIVE_BYTES, uncompressed members, names of
no meaning to others; a manifest written at commit lists the archives of successful tasks, so what lost tasks left is
never read. A payload becomes an 8-bit grey PNG of 64 pixels a row, losslessly.

Reading: the driver plans byte ranges over the archives that the manifests list, never opening them. A task reads an
archive's directory, takes the members that begin in its range, and streams them in Arrow batches of about BATCH_BYTES.
Every member is read by its offset, checked, and retried on its own with a freshly opened archive; one that stays
unreadable fails the task, or with option on_error = "null" becomes a row with its error.

Folders are reached through pyarrow's file systems (file, hdfs, s3, gs), the same on driver and executors.

Defined cases: a null payload is stored as an empty one; an empty one is padded to 64 bytes like any other; repeated rows
and ids are separate members; null ids stay null; an empty table makes no archive and reads as an empty table.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "tessera_media"
#: Bytes of a row of pixels; payloads are padded to a positive multiple.
ROW = 64
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
TRIES = 3
SCHEMA = "archive string, offset long, name string, media binary, error string"
PNG_START = b"\x89PNG\r\n\x1a\n"


def pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % ROW or (0 if raw else ROW))


def encode_png(payload: bytes) -> bytes:
    """The payload, whose length is a multiple of ROW, as a grey image."""
    pixels = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(pixels), ROW + 1), dtype=np.uint8)  # a filter byte of 0 before each row
    lines[:, 1:] = pixels
    packed = zlib.compress(lines.tobytes(), 1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    data = b"".join(chunk(b"IDAT", packed[at : at + (1 << 20)]) for at in range(0, len(packed), 1 << 20))
    return PNG_START + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(pixels), 8, 0, 0, 0, 0)) + data + chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The payload of an image that ``encode_png`` made; a damaged one is a ValueError."""
    if media[:8] != PNG_START:
        raise ValueError("not a PNG")
    at, data, height = 8, [], None
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError(f"damaged {kind!r} chunk")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack(">IIBB", body[:10])
            if (width, depth, colour) != (ROW, 8, 0):
                raise ValueError("not a grey image of this width")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(-1, ROW + 1)
    if len(lines) != height or lines[:, 0].any():
        raise ValueError("rows of another kind")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Size, brightness, contrast, entropy, and one bit for each column brighter than the mean."""
    pixels = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    share = np.bincount(pixels.ravel(), minlength=256) / pixels.size
    share = share[share > 0]
    columns = pixels.mean(axis=0)
    bits = int("".join("1" if c > columns.mean() else "0" for c in columns), 2)
    return f"{ROW}x{len(pixels)};mean={pixels.mean():.4f};std={pixels.std():.4f};entropy={-(share * np.log2(share)).sum():.4f};columns={bits:016x}"


class _Sink:
    """What zipfile needs to write to a stream that can't go back."""

    def __init__(self, stream):
        self.stream, self.size = stream, 0

    def write(self, data: bytes) -> int:
        self.stream.write(data)
        self.size += len(data)
        return len(data)

    def flush(self) -> None:
        self.stream.flush()


@dataclass
class _Written(WriterCommitMessage):
    archives: list[tuple[str, int]]


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


class MediaWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        done: list[tuple[str, int]] = []
        stream = sink = archive = name = None
        count = 0
        for batch in iterator:
            for member, payload in zip(batch.column("name"), batch.column("payload")):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    stream = fs.open_output_stream(f"{root}/{name}")
                    sink = _Sink(stream)
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                media = encode_png(pad(payload.as_py() or b""))
                archive.writestr(zipfile.ZipInfo(f"{count:09d};{member.as_py()}.png"), media)
                count += 1
                if sink.size >= ARCHIVE_BYTES:
                    archive.close()
                    stream.close()
                    done.append((name, sink.size))
                    archive = None
        if archive is not None:
            archive.close()
            stream.close()
            done.append((name, sink.size))
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{uuid.uuid4().hex}.manifest") as out:
            out.write(json.dumps([list(a) for m in messages if m for a in m.archives]).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for message in messages:
            for name, _ in message.archives if message else ():
                fs.delete_file(f"{root}/{name}")


class MediaReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, on_error: str):
        self.path, self.range_bytes, self.on_error = path, range_bytes, on_error

    def partitions(self) -> list[ByteRange]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        found = []
        for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if info.path.endswith(".manifest"):
                with fs.open_input_stream(info.path) as manifest:
                    found += json.loads(manifest.read())
        return [ByteRange(name, at, min(at + self.range_bytes, size)) for name, size in sorted(found) for at in range(0, size, self.range_bytes)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, ByteRange):
            return
        fs, root = pafs.FileSystem.from_uri(self.path)
        path = f"{root}/{partition.archive}"
        with fs.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
            members = [m for m in archive.infolist() if partition.start <= m.header_offset < partition.end]
        rows, held = [], 0
        for member in members:
            media, error = read_member(fs, path, member)
            if error and self.on_error != "null":
                raise OSError(f"{path} at {member.header_offset}: {error}")
            rows.append((partition.archive, member.header_offset, member.filename, media, error))
            held += len(media or b"")
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def read_member(fs: pafs.FileSystem, path: str, member: zipfile.ZipInfo, tries: int = TRIES) -> tuple[bytes | None, str | None]:
    """A member's bytes, read by its offset alone; each try opens the archive anew. Else what went wrong last."""
    error = None
    for attempt in range(tries):
        if attempt:
            time.sleep(0.1 * 2**attempt)
        try:
            with fs.open_input_file(path) as file:
                file.seek(member.header_offset)
                head = file.read(30)
                if head[:4] != b"PK\x03\x04":
                    raise ValueError("no member begins here")
                name, extra = struct.unpack("<HH", head[26:30])
                file.seek(member.header_offset + 30 + name + extra)
                media = file.read(member.compress_size)
            if len(media) != member.file_size or zlib.crc32(media) != member.CRC:
                raise ValueError("bytes differ from their checksum")
            return media, None
        except (OSError, ValueError, struct.error) as problem:
            error = str(problem)
    return None, error


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"archive": pa.string(), "offset": pa.int64(), "name": pa.string(), "media": pa.binary(), "error": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))


class MediaSource(DataSource):
    """Options: path, range_bytes (of a read partition), on_error ("fail" or "null")."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), self.options.get("on_error", "fail"))

    def writer(self, schema, overwrite: bool) -> MediaWriter:
        return MediaWriter(self.options["path"])


def write_media(frame: DataFrame, path: str, id_col: str = "doc_id", payload_col: str = "text") -> None:
    """Add archives with one member for each row to the folder ``path``; a text payload is its UTF-8 bytes."""
    frame.sparkSession.dataSource.register(MediaSource)
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    name = F.concat_ws(";", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), F.length(payload).cast("string"))
    frame.select(name.alias("name"), payload.alias("payload")).write.format(FORMAT).mode("append").save(path)


def read_media(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, on_error: str = "fail") -> DataFrame:
    """Members of all archives: archive, offset, name, media, error, and doc_id and n_bytes, which the name tells."""
    spark.dataSource.register(MediaSource)
    members = spark.read.format(FORMAT).option("range_bytes", range_bytes).option("on_error", on_error).load(path)
    told = F.split("name", "[;.]")
    return members.withColumn("doc_id", F.expr("try_cast(split(name, '[;.]')[1] as bigint)")).withColumn("n_bytes", F.get(told, F.lit(2)).cast("long"))


def media_features(members: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of read members.

    What can't be decoded has nulls for all that its payload would tell.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column("media"):
                media = value.as_py()
                try:
                    payload = decode_png(media or b"")
                except (ValueError, zlib.error, struct.error):
                    out.append((None,) * 3 + (len(media or b""), hashlib.sha256(media or b"").hexdigest(), None))
                    continue
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=names)

    return members.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)

"""Removal of exact substrings that repeat, by blockwise suffix sorting with a difference cover.

A byte goes if a string of ``length`` bytes that covers it starts at another place too, in any document.

1.  Windows of all texts are grouped to runs by content anchors (``suffixes.Windows``); equal windows stand in runs of one
    anchor class. A count by class leaves the classes that occur more than once; a bitmap of fixed size (it only saves
    shuffling) keeps most of the others out of what follows.
2.  Runs of equal segments become one row with a count: all windows of a segment that occurs twice repeat.
3.  What is left are segments that occur once, in a class with other segments. The bytes of such classes, one copy of each
    segment, are fetched from their texts and meet in tasks by class, where suffixes are sorted a bucket at a time, with
    long ties resolved by the ranks of a difference-cover sample (``suffixes.CoverSort``); equal neighbours repeat.
    A class of more than HOT segments would be one task's work: it is dealt out as blocks of WIDTHS[0] windows, classed by the
    bytes that all windows of a block share, to which steps 2 and 3 apply again, with narrower blocks for what is still hot;
    blocks of one window are settled by their count.
4.  Repeated windows go back to their texts, which are cut.

Texts are told apart by md5, so equal texts are worked out once and share their result. Segments are told apart by 128
bits (64 of the class, 64 of its own).

Defined cases: a null text counts as empty; a text shorter than ``length`` bytes has no window and loses nothing; the same
row twice is two documents (so a text of ``length`` bytes or more that occurs twice goes whole); null ids are ids like any
other; an empty table gives an empty result; columns besides id and text don't matter, whatever their names. What is left of
a text may begin or end inside a character, so it is bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import materialize
from tessera.llm.suffixes import Windows, repeated

#: Segments beyond which a class is dealt out by windows.
HOT = 512
#: Windows in a block of a hot class, from one dealing out to the next; each divides the one before.
WIDTHS = (32, 8, 1)
#: Bytes of segments that a task sorts at a time (it ends at a class).
LAID_OUT = 1 << 20
#: Bits of the bitmap of classes: 8 MB.
BITMAP = 1 << 26
BITMAP_BUCKET = 1 << 15


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _side_by_side(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, and where each begins and the last ends."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _class_counts(texts: DataFrame, spec: Windows) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, _, kind, _ in spec.runs(*_side_by_side(batch.column("text"))):
                values, counts = np.unique(kind, return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(values), pa.array(counts)], names=["h", "n"])

    return texts.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")


def _bitmap(classes: DataFrame) -> np.ndarray:
    """One bit for the low bits of each class; collected in pieces whose number is fixed."""
    place = F.col("h").bitwiseAND(F.lit(BITMAP - 1))
    pieces = (
        classes.select(F.shiftright(place, 15).alias("bucket"), place.bitwiseAND(F.lit(BITMAP_BUCKET - 1)).alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()
    )
    bits = np.zeros(BITMAP // 8, dtype=np.uint8)
    for piece in pieces:
        at = piece.bucket * (BITMAP_BUCKET // 8)
        bits[at : at + BITMAP_BUCKET // 8] = np.frombuffer(piece.bits, dtype=np.uint8)
    return bits


def _runs(texts: DataFrame, classes: DataFrame, spec: Windows) -> DataFrame:
    """(key, at, n, o, h, g): first window, windows, distance, class and print of each run whose class has its bit."""
    handle = texts.sparkSession.sparkContext.broadcast(_bitmap(classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = handle.value
        for batch in batches:
            keys = batch.column("key")
            for row, at, n, grid, kind, segment in spec.runs(*_side_by_side(batch.column("text"))):
                place = (kind & np.uint64(BITMAP - 1)).astype(np.int64)
                kept = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                columns = [keys.take(pa.array(row[kept])), pa.array(at[kept]), pa.array(n[kept]), pa.array(grid[kept]), _signed(kind[kept]), _signed(segment[kept])]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "at", "n", "o", "h", "g"])

    return texts.select("key", "text").mapInArrow(run, "key binary, at long, n long, o long, h long, g long")


def _mixed(segments: DataFrame) -> DataFrame:
    """(h, segments) of the classes that have several segments, one of them with a single place."""
    return segments.groupBy("h").agg(F.count("*").alias("segments"), F.min("c").alias("least")).filter("segments > 1 AND least = 1").drop("least")


def _segment_bytes(texts: DataFrame, wanted: DataFrame, spec: Windows) -> DataFrame:
    """(h, g, c, n, o, segments, bytes) of the wanted segments, from one text each."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("at", "n", "o", "h", "g", "c", "segments")).alias("wanted"))
    found = texts.groupBy("key").agg(F.first("text").alias("text")).join(lists, "key").select("text", "wanted")
    names = ["h", "g", "c", "n", "o", "segments"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, asked in zip(batch.column("text"), batch.column("wanted")):
                data, asked = text.as_py(), asked.values
                ends = [(at, at + n + spec.length - 1) for at, n in zip(asked.field("at").to_pylist(), asked.field("n").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(asked.field(n) for n in names), pa.array([data[a:b] for a, b in ends], pa.binary())], names=[*names, "bytes"])

    return found.mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", bytes binary")


def _blocks(hot: DataFrame, spec: Windows, width: int) -> DataFrame:
    """(h, g, c, at, n, o, h2, g2, bytes): hot classes' segments as blocks of ``width`` windows with classes of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, g, c, o, data in zip(*(batch.column(n).to_pylist() for n in ("h", "g", "c", "o", "bytes"))):
                for at, n, grid, h2, g2 in spec.blocks(np.frombuffer(data, dtype=np.uint8), o, width):
                    rows.append((h, g, c, at, n, grid, h2, g2, data[at : at + n + spec.length - 1]))
            columns = list(zip(*rows)) or [()] * 9
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:8]), pa.array(columns[8], pa.binary())], names=names)

    names = ["h", "g", "c", "at", "n", "o", "h2", "g2", "bytes"]
    return hot.select("h", "g", "c", "o", "bytes").mapInArrow(run, ", ".join(f"{n} long" for n in names[:8]) + ", bytes binary")


def _copies(segments: DataFrame) -> DataFrame:
    return segments.filter("c > 1").select("h", "g", F.array(F.lit(0).cast("long"), "n").alias("spans"))


def _repeats(segments: DataFrame, spec: Windows, widths: tuple[int, ...]) -> DataFrame:
    """(h, g, spans) of the segments (h, g, c, n, o, segments, bytes) of mixed classes: repeated windows of those with one place."""
    small = _sorted_classes(segments.filter(F.col("segments") <= HOT) if widths else segments, spec)
    hot = segments.filter(F.col("segments") > HOT)
    if not widths or hot.isEmpty():
        return small
    blocks = materialize(_blocks(hot, spec, widths[0]))
    one = [F.first(n).alias(n) for n in ("n", "o", "bytes")]
    own = blocks.groupBy("h2", "g2").agg(F.sum("c").alias("c"), *one).withColumnsRenamed({"h2": "h", "g2": "g"})
    own = materialize(own)
    deeper = _copies(own).union(_repeats(own.join(_mixed(own), "h"), spec, widths[1:])).withColumnsRenamed({"h": "h2", "g": "g2"})
    back = blocks.filter("c = 1").select("h", "g", "at", "h2", "g2").join(deeper, ["h2", "g2"]).select("h", "g", F.expr("transform(spans, s -> s + at)").alias("spans"))
    return small.union(back.groupBy("h", "g").agg(F.flatten(F.collect_list("spans")).alias("spans")))


def _sorted_classes(segments: DataFrame, spec: Windows) -> DataFrame:
    """(h, g, spans): repeated windows of segments that occur once, from suffix sorts of whole classes."""
    met = segments.select("h", "g", "c", "bytes").repartition("h").sortWithinPartitions("h", "g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, bytes]] = []
        held, last = 0, None

        def flush() -> pa.RecordBatch:
            twice = repeated([r[3] for r in rows], spec.length)
            found = [(r[0], r[1], spans_of(t)) for r, t in zip(rows, twice) if r[2] == 1 and t.any()]
            columns = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["h", "g", "spans"])

        for batch in batches:
            for h, g, c, data in zip(*(batch.column(n).to_pylist() for n in ("h", "g", "c", "bytes"))):
                if h != last and held >= LAID_OUT:
                    yield flush()
                    rows, held = [], 0
                last = h
                rows.append((h, g, c, data))
                held += len(data)
        if rows:
            yield flush()

    return met.mapInArrow(run, "h long, g long, spans array<long>")


def spans_of(mask: np.ndarray) -> list[int]:
    """Where the runs of true values begin and end, one after another."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edges.tolist()


def repeated_windows(texts: DataFrame, spec: Windows) -> DataFrame:
    """(key, spans) of the texts (key, text) with repeated windows: arrays of begin, end, begin, end ... of their first bytes."""
    classes = materialize(_class_counts(texts, spec))
    runs = materialize(_runs(texts, classes, spec))
    first = F.min(F.struct("key", "at")).alias("first")
    segments = materialize(runs.groupBy("h", "g").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("o").alias("o"), first).select("h", "g", "c", "n", "o", "first.*"))
    fetched = materialize(_segment_bytes(texts, segments.join(_mixed(segments), "h"), spec))
    widths = tuple(w for w in WIDTHS if 2 * w <= spec.length)  # windows of a block must share bytes
    found = materialize(_copies(segments).union(_repeats(fetched, spec, widths)))
    placed = runs.join(found, ["h", "g"]).select("key", F.expr("transform(spans, s -> s + at)").alias("spans"))
    return placed.groupBy("key").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def cut(data: bytes, spans: list[int], length: int) -> tuple[bytes, int, int]:
    """The text without the bytes that the windows of the spans cover, the bytes removed, the runs removed."""
    kept, at, removed, runs, low, high = [], 0, 0, 0, None, None
    for begin, end in [*sorted(zip(spans[::2], spans[1::2])), (None, None)]:
        if high is not None and begin is not None and begin <= high:
            high = max(high, end + length - 1)
            continue
        if high is not None:
            kept.append(data[at:low])
            at, removed, runs = high, removed + high - low, runs + 1
        low, high = begin, None if end is None else end + length - 1
    return b"".join([*kept, data[at:]]), removed, runs


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: Windows = Windows()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (removed runs of bytes), kept (the bytes that stay)."""
    name = lambda column: F.col("`" + column.replace("`", "``") + "`")
    text = F.coalesce(name(text_col), F.lit("")).cast("binary")
    rows = docs.select(name(id_col).alias("doc_id"), text.alias("text")).withColumn("key", _key(F.col("text")))
    spans = repeated_windows(rows.select("key", "text"), spec)
    joined = rows.join(spans, "key", "left").select("doc_id", "text", "spans")
    length = spec.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, kept = [], [], [], []
            for data, found in zip(batch.column("text"), batch.column("spans")):
                data = data.as_py()
                sizes.append(len(data))
                rest = cut(data, found.as_py() or [], length)
                kept.append(rest[0])
                removed.append(rest[1])
                runs.append(rest[2])
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (sizes, removed, runs)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")

"""Near-duplicate documents: MinHash with banding, signature verification, exact confirmation, components.

1.  One pass makes each document's set of word shingles (64-bit hashes), the 128-bit key of that set, and from minima
    of universal hashes (a * x + b modulo 2**64) one hash for each band. Documents of equal sets are one class, however
    many copies there are; all that follows is about classes.
2.  Classes that share a band hash are candidates. Stars about the smallest class of each bucket (never all pairs) are
    joined to candidate components by large-star and small-star.
3.  A second pass makes the sets of candidate classes anew (a bitmap of fixed size keeps the others out), and each
    candidate component is searched for links: pairs of like size whose signatures agree well enough are confirmed on
    full sets. Pairs already known to hang together are skipped, so a group of n copies needs about n comparisons. A
    component of more than BLOCK classes is dealt out as pairs of chunks, so that no task holds a large group; one of
    more than HUGE classes is dealt out by buckets first.
4.  Links become components; a document's component is named by the smallest id in it.

A band is missed by a pair at the threshold itself with probability MISS at most (bands are as many as that needs).

Defined cases: a document without words has an empty set, is linked with nothing and is kept; one with fewer words than
a shingle has one shingle, its whole sequence; equal ids are the same document; a null id can't name a component (its
component is that of its copies' smallest id, or null) and is not kept by ``kept``; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import star_components
from tessera.llm.shared import fresh, materialize, quoted

BLOCK = 128
LARGEST_BLOCK = 4096
HUGE = 200_000
MISS = 1e-6
#: Bits of the bitmap that keeps classes without candidates out of the second pass: 8 MB.
BITMAP = 1 << 26
BITMAP_BUCKET = 1 << 15


@dataclass(frozen=True)
class MinHash:
    """Shingles of ``width`` words; pairs with Jaccard similarity of ``percent`` / 100 or more are links."""

    width: int = 5
    percent: int = 80
    rows: int = 5
    seed: int = 1

    @cached_property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - (self.percent / 100) ** self.rows))

    @cached_property
    def constants(self) -> dict[str, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        odd = lambda n: rng.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1)
        return {"mix": odd(self.width), "a": odd(self.bands * self.rows), "b": odd(self.bands * self.rows), "band": odd(self.rows), "salt": odd(self.bands)}

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the text's shingles. Letters A-Z are lowered; only ASCII white space parts words."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(words) < self.width:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
        n = len(words) - self.width + 1
        total = np.zeros(n, dtype=np.uint64)
        for i, mix in enumerate(self.constants["mix"]):
            part = hashes[i : i + n] * mix
            total += part ^ (part >> np.uint64(29))
        return np.unique(total)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        a, b = self.constants["a"], self.constants["b"]
        best = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(shingles), 512):
            values = shingles[at : at + 512, None] * a
            values += b
            np.minimum(best, values.min(axis=0), out=best)
        return best

    def band_hashes(self, signature: np.ndarray) -> np.ndarray:
        joined = (signature.reshape(self.bands, self.rows) ^ (signature.reshape(self.bands, self.rows) >> np.uint64(31))) * self.constants["band"]
        total = joined.sum(axis=1, dtype=np.uint64) ^ self.constants["salt"]
        return (total ^ (total >> np.uint64(32))).view(np.int64)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether 100 * intersection >= percent * union, on full sets."""
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= self.percent * (len(a) + len(b) - both)


def key_of(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def bit_of(key: bytes) -> int:
    """The key's place in the bitmap: what xxhash64 gives in Spark, of which the low bits count."""
    return xxhash.xxh64_intdigest(key, seed=42) % BITMAP


def _first_pass(docs: DataFrame, spec: MinHash) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, bands = [], [], []
            for text in batch.column("text"):
                shingles = spec.shingles(text.as_py())
                sizes.append(len(shingles))
                keys.append(key_of(shingles))
                bands.append(spec.band_hashes(spec.signature(shingles)) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "key", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, key binary, bands array<long>")


def _bitmap(keys: DataFrame) -> np.ndarray:
    """One bit for each candidate key's hash; collected in pieces whose number is fixed."""
    position = F.pmod(F.xxhash64("key"), F.lit(BITMAP).cast("long"))
    pieces = (
        keys.select(position.alias("p"))
        .select(F.expr(f"p div {BITMAP_BUCKET}").alias("bucket"), F.expr(f"p % {BITMAP_BUCKET}").alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()
    )
    bits = np.zeros(BITMAP // 8, dtype=np.uint8)
    for piece in pieces:
        at = piece.bucket * (BITMAP_BUCKET // 8)
        bits[at : at + BITMAP_BUCKET // 8] = np.frombuffer(piece.bits, dtype=np.uint8)
    return bits


def _sets_of(docs: DataFrame, keys: DataFrame, spec: MinHash) -> DataFrame:
    """(key, shingles) of all keys in ``keys``, once each; a few others may be among them."""
    handle = docs.sparkSession.sparkContext.broadcast(_bitmap(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sent = handle.value, set()
        for batch in batches:
            found: dict[bytes, bytes] = {}
            for text in batch.column("text"):
                shingles = spec.shingles(text.as_py())
                key = key_of(shingles)
                if key is None or key in sent:
                    continue
                at = bit_of(key)
                if bits[at >> 3] >> (at & 7) & 1:
                    found[key] = shingles.tobytes()
                    if len(sent) < 1_000_000:
                        sent.add(key)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["key", "shingles"])

    return docs.select("text").mapInArrow(run, "key binary, shingles binary")


def links_within(keys: list[bytes], sets: list[np.ndarray], sides: list[int], spec: MinHash) -> Iterator[tuple[bytes, bytes]]:
    """Confirmed links that join up the members of one block; every link's ends hang together in what is yielded.

    With two sides present only pairs across are looked at (pairs of one side are another block's).
    """
    count = len(keys)
    signatures = np.array([spec.signature(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    side = np.array(sides)
    across = len(set(sides)) > 1
    root = np.arange(count)
    # Signatures of pairs at the threshold agree in this share of places or more, 7 standard deviations below it.
    p = spec.percent / 100
    least = p - 7 * math.sqrt(p * (1 - p) / signatures.shape[1]) if count else 0
    for i in range(count - 1):
        other = np.flatnonzero((root != root[i]) & (np.arange(count) > i) & (100 * np.minimum(sizes, sizes[i]) >= spec.percent * np.maximum(sizes, sizes[i])))
        if across:
            other = other[side[other] != side[i]]
        if not len(other):
            continue
        agree = (signatures[other] == signatures[i]).mean(axis=1)
        for j in other[agree >= least]:
            if root[j] != root[i] and spec.linked(sets[i], sets[j]):
                root[root == root[j]] = root[i]
                yield keys[i], keys[j]


def _links(members: DataFrame, sets: DataFrame, spec: MinHash) -> DataFrame:
    """Confirmed links of all groups in ``members`` (gid, key, size)."""
    chunk = F.greatest(F.lit(BLOCK), F.least(F.lit(LARGEST_BLOCK), (F.col("size") / 24).cast("long")))
    chunks = F.ceil(F.col("size") / chunk).cast("long")
    mine = F.pmod(F.xxhash64("key", "gid"), F.col("chunks"))
    dealt = (
        members.withColumn("chunks", chunks)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .select("key", F.xxhash64("gid", F.least("mine", "other"), F.greatest("mine", "other")).alias("block"), "gid", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine")
    )
    filled = dealt.join(sets, "key").repartition("block").sortWithinPartitions("block", "gid", "lo", "hi", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def flush() -> pa.RecordBatch:
            found = list(links_within([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], spec))
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("block", "gid", "lo", "hi", "key", "shingles", "mine")]
            for block, gid, lo, hi, key, shingles, side in zip(*columns):
                if now != (block, gid, lo, hi):
                    if len(rows) > 1:
                        yield flush()
                    now, rows = (block, gid, lo, hi), []
                if not rows or rows[-1][0] != key:
                    rows.append((key, np.frombuffer(shingles, dtype=np.uint64), side))
        if len(rows) > 1:
            yield flush()

    return filled.mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, spec: MinHash = MinHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, key (of its set), component_id, kept."""
    docs = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    passed = materialize(_first_pass(docs, spec))
    classes = passed.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"))
    banded = classes.select("key", F.explode("bands").alias("h"))
    buckets = banded.groupBy("h").agg(F.count("*").alias("size"), F.min("key").alias("least")).filter("size > 1")
    pairs = materialize(banded.join(buckets, "h").select("h", "size", "least", "key"))
    candidates = materialize(star_components(pairs.filter("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b"))))
    sizes = candidates.groupBy("component").agg(F.count("*").alias("size"))
    grouped = candidates.join(sizes, "component").select("node", "component", "size")
    members = grouped.filter(F.col("size") <= HUGE).select(F.col("component").alias("gid"), F.col("node").alias("key"), "size")
    huge = grouped.filter(F.col("size") > HUGE).select(F.col("node").alias("key"))
    by_bucket = pairs.join(huge, "key", "left_semi").select(F.col("h").cast("string").cast("binary").alias("gid"), "key", "size")
    sets = _sets_of(docs, candidates.select(F.col("node").alias("key")), spec)
    links = materialize(_links(members.union(by_bucket), sets, spec).distinct())
    joined = star_components(links)
    named = classes.select("key", "first_id").join(joined.withColumnRenamed("node", "key"), "key", "left").select("key", "first_id", F.coalesce("component", "key").alias("component"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labels = named.join(least, "component").select("key", "component_id")
    return (
        passed.select("doc_id", "n_shingles", "key")
        .join(labels, "key", "left")
        .select("doc_id", "n_shingles", "key", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def drop_near_duplicates(docs: DataFrame, spec: MinHash = MinHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id; rows without an id all stay."""
    found = near_duplicates(docs.filter(F.col(quoted(id_col)).isNotNull()), spec, id_col, text_col)
    (gone,) = fresh(docs, "__dropped")
    dropped = found.filter("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, F.col(quoted(id_col)) == F.col(gone), "left_anti")

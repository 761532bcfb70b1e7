import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import exactdup, suffixes
from tessera.llm.exactdup import cut, remove_repeats
from tessera.llm.exactdup_query import op12_exact_substrings
from tessera.llm.suffixes import COVER, PERIOD, CoverSort, Windows, repeated

SCHEMA = "doc_id long, text string, key string, spans int, h string"


def brute(texts, length):
    """For each text: bytes, bytes removed, runs removed, what is kept; by counting every window."""
    texts = [(t or "").encode() for t in texts]
    seen = Counter(hash(t[i : i + length]) for t in texts for i in range(len(t) - length + 1))
    found = []
    for t in texts:
        gone = np.zeros(len(t) + 1, dtype=np.int64)
        for i in range(len(t) - length + 1):
            if seen[hash(t[i : i + length])] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        runs = int(np.sum(np.diff(np.concatenate([[0], mask.astype(int)])) == 1))
        found.append((len(t), int(mask.sum()), runs, bytes(np.frombuffer(t, dtype=np.uint8)[~mask])))
    return found


def made(spark, texts, spec):
    frame = spark.createDataFrame([(i, t, "k", 1, None) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    return [tuple(r)[1:] for r in sorted(remove_repeats(frame, spec=spec).collect())]


def fragments(rng, count, length, words):
    """Texts patched together from shared pieces around and above the length, and from noise."""
    letters = "ab é" if words < 3 else "abcdefghij \n\U0001f600"
    noise = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [noise(rng.randrange(length // 2, 3 * length)) for _ in range(words)]
    return ["".join(rng.choice(shared)[rng.randrange(8) :] if rng.random() < 0.4 else noise(rng.randrange(length)) for _ in range(rng.randrange(6))) for _ in range(count)]


def test_cover_holds_every_distance():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


@pytest.mark.parametrize("length", [13, 21, 64])
@pytest.mark.parametrize("letters", [1, 2, 30])
def test_suffixes_are_sorted(monkeypatch, length, letters):
    monkeypatch.setattr(suffixes, "BUCKET", 200)
    rng = random.Random(length * letters)
    data = bytes(97 + rng.randrange(letters) for _ in range(1200)) * 2
    places = np.arange(len(data) - length + 1)
    order = np.concatenate(list(CoverSort(np.frombuffer(data, dtype=np.uint8), length).buckets(places)))
    assert sorted(order.tolist()) == places.tolist()
    strings = [data[i : i + length] for i in order]
    assert strings == sorted(strings)
    seen = Counter(strings)
    assert repeated([data], length)[0].tolist() == [seen[data[i : i + length]] > 1 for i in places]


@pytest.mark.parametrize("length", [13, 40])
def test_equal_windows_share_a_class(monkeypatch, length):
    monkeypatch.setattr(suffixes, "BLOCK", 300)
    rng = random.Random(length)
    texts = [t.encode() for t in fragments(rng, 60, length, 4)] + [b"a" * 900, b"", b"ab" * 400]
    spec = Windows(length)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    kinds, covered = {}, Counter()
    for run in spec.runs(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets):
        for row, at, n, _, kind, _ in zip(*(c.tolist() for c in run)):
            for i in range(at, at + n):
                covered[row, i] += 1
                assert kinds.setdefault(texts[row][i : i + length], kind) == kind
    assert covered == Counter((r, i) for r, t in enumerate(texts) for i in range(len(t) - length + 1))


@pytest.mark.parametrize("width", [1, 4, 16])
def test_equal_windows_share_a_block_class(width):
    rng = random.Random(width)
    spec = Windows(40)
    texts = [t.encode() for t in fragments(rng, 80, 40, 3)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    kinds = {}
    for run in spec.runs(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets):
        for row, at, n, grid, *_ in zip(*(c.tolist() for c in run)):
            segment = texts[row][at : at + n + 39]
            windows = 0
            for begin, count, _, shared, _ in spec.blocks(np.frombuffer(segment, dtype=np.uint8), grid, width):
                assert begin == windows and 0 < count <= width
                windows += count
                for i in range(begin, begin + count):
                    assert kinds.setdefault(segment[i : i + 40], shared) == shared
            assert windows == n


def test_cut():
    assert cut(b"0123456789", [2, 3, 3, 4], 3) == (b"016789", 4, 1)
    assert cut(b"0123456789", [0, 1, 3, 4, 7, 8], 3) == (b"6", 9, 2)
    assert cut(b"0123", [], 3) == (b"0123", 0, 0)


@pytest.mark.parametrize("hot, widths", [(512, (32, 8, 1)), (3, (32, 8, 1)), (1, (8, 2, 1)), (2, (1,))])
def test_fragments_against_counting(spark, monkeypatch, hot, widths):
    monkeypatch.setattr(exactdup, "HOT", hot)
    monkeypatch.setattr(exactdup, "WIDTHS", widths)
    spec = Windows(30)
    rng = random.Random(hot)
    texts = [*fragments(rng, 120, 30, 6), *fragments(rng, 40, 30, 2), None, "", "x" * 29, "y" * 30, "y" * 30, "z" * 31, "long " * 3000, "\U0001f600" * 40]
    texts += [texts[3]] * 4
    assert made(spark, texts, spec) == brute(texts, 30)


def test_boundaries(spark):
    piece = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(90))[:200]
    texts = [piece, "<" + piece, "q" + piece[:199], piece[1:], piece + "!" + piece]
    assert made(spark, texts, Windows(200)) == brute(texts, 200)


def test_empty_table_and_null_ids(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    frame = spark.createDataFrame([(None, "w" * 20, None, None, None)] * 2 + [(1, "other words here", None, None, None)], SCHEMA)
    got = [tuple(r) for r in remove_repeats(frame, spec=Windows(16)).orderBy("doc_id").collect()]
    assert got == [(None, 20, 20, 1, b"")] * 2 + [(1, 16, 0, 0, b"other words here")]


def test_whole_table_against_counting(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = [(r.doc_id, n, gone, runs, hashlib.sha256(kept).hexdigest()) for r, (n, gone, runs, kept) in zip(given, brute([r.text for r in given], 200))]
    assert [tuple(r) for r in op12_exact_substrings(spark, sf_dir).orderBy("doc_id").collect()] == want
    assert sum(w[2] for w in want) > 0

"""Toxicity by a convolutional text classifier.

A word's embedding is the sum of hashed rows: its own, and those of its first letters (PREFIXES), so that unseen forms
of a known stem score. Filters of several widths run over the whole text; of each filter the POOL largest values are
kept (max pooling that can tell one hit from several), and a logistic layer reads them. All of it is numpy.

Every labelled row is learned from. One in CALIBRATION of them, by a hash of the id, is held back. Of the others Spark
counts in how many texts of each label each row of the embedding is; those that tell nothing stay 0. Then texts are cut
down to the words that tell, without a change to what the network gives for them, and the network is trained with Adam in
groups of about GROUP rows, in ROUNDS rounds; after each the groups' weights are averaged by their rows, those of an
embedding row by the texts that have it. The rows held back set, for each language that the language profiles see in the
text, the threshold that separates best; scores are shifted so that this threshold becomes DECISION everywhere.

Scoring is one pass without a shuffle over whole texts.

Defined cases: null and empty texts get the score of a text without words; without both labels to learn from, every
score is 0; an id that is labelled several times has the largest of its labels; repeated rows teach as often as they are
there and give repeated results; other columns stay, and result columns take the place of columns of the same name.
"""

from __future__ import annotations

import copy
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.averaging import KIND, cut, summed
from tessera.llm.langid import UNKNOWN, Profiles
from tessera.llm.shared import materialize

#: Score from which a text counts as toxic.
DECISION = 0.7
#: Rows that a group is trained on, about, and how often the groups' weights are averaged.
GROUP = 6_000
ROUNDS = 3
PREFIXES = (4, 6)
BUCKETS = 1 << 18
#: Texts that must share a word or stem for it to have a row of its own.
SHARED_BY = 3
TELLING = 4.0
LEAST_PRECISION = 0.7
#: Share of the places that a training step blanks, so that no single word is leaned on.
BLANKED = 0.2
WIDTHS = (1, 2, 3)
FILTERS, DEPTH, POOL = 8, 12, 3
EPOCHS, BATCH, RATE = 6, 64, 0.01
#: Share of the labelled rows that sets thresholds, as one in so many.
CALIBRATION = 4
#: Thresholds are found among log-odds in steps of one in so many.
GRID = 256
WORDS = re.compile(r"[^\W\d_]+")
#: Characters of texts that are prepared and scored at a time, or one text: so few that they stay in a core's cache.
CHUNK = 400_000
#: Letters up to which a word's rows are found together with the other words'; longer ones are taken one at a time.
LONG = 64
#: Words in a row that tell nothing, of which more make no difference: for every width POOL windows hold nothing else.
BLANK = POOL + max(WIDTHS) - 1


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def _bucket(key: str) -> int:
    return zlib.crc32(key.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) + 1


def buckets_of(word: str) -> list[int]:
    """Rows of the embedding table that make up a word: the word, and its stems; row 0 is padding."""
    return [_bucket(word), *(_bucket(word[:n] + "-") for n in PREFIXES)]


@cache
def _letters() -> np.ndarray:
    """For each code point whether WORDS takes it."""
    table = np.zeros(sys.maxunicode + 1, dtype=bool)
    for run in WORDS.finditer("".join(map(chr, range(sys.maxunicode + 1)))):
        table[run.start() : run.end()] = True
    return table


@cache
def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


def _crc_of(crc: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """zlib.crc32, before its last complement, of what had ``crc`` and one code point more, as UTF-8."""
    table = _crc_table()
    out = table[(crc ^ codes) & 0xFF] ^ crc >> 8
    wide = np.flatnonzero(codes > 0x7F)
    for first, shift, least, most in ((0xC0, 6, 0x80, 0x7FF), (0xE0, 12, 0x800, 0xFFFF), (0xF0, 18, 0x10000, sys.maxunicode)) if len(wide) else ():
        at = wide[(codes[wide] >= least) & (codes[wide] <= most)]
        code, mine = codes[at], crc[at]
        mine = table[(mine ^ (first | code >> shift)) & 0xFF] ^ mine >> 8
        for left in range(shift - 6, -1, -6):
            mine = table[(mine ^ (0x80 | code >> left & 0x3F)) & 0xFF] ^ mine >> 8
        out[at] = mine
    return out


def word_rows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``buckets_of`` all words of the texts in order, one word a row, and where each text's begin, with the end of the last."""
    lowered = ["", *((t or "").lower() for t in texts), ""]
    codes = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = _letters()[codes]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    bounds = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in lowered[:-1]]))
    # Longest first, so that words with a letter at a place stand in front.
    size = np.minimum(lengths, LONG)
    order = np.argsort((LONG - size).astype(np.uint8), kind="stable")
    at, longer = starts[order], len(starts) - np.cumsum(np.bincount(size, minlength=LONG))
    crc, stems = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32), {}
    dash = np.array([ord("-")], dtype=np.uint32)
    for place in range(LONG + 1):
        if place in PREFIXES:
            stems[place] = _crc_of(crc, dash.repeat(len(crc)))
        if place < LONG and (n := longer[place]):
            crc[:n] = _crc_of(crc[:n], codes[at[:n] + place])
    rows = np.empty((len(starts), 1 + len(PREFIXES)), dtype=np.int32)
    rows[order] = np.stack([~crc, *(~stems[n] for n in PREFIXES)], axis=1) % (BUCKETS - 1) + 1
    for i in np.flatnonzero(lengths > LONG):
        word = codes[starts[i] : starts[i] + lengths[i]].tobytes().decode("utf-32-le", "surrogatepass")
        rows[i, 0] = _bucket(word)
    return rows, bounds


class Words(dict):
    """Word -> number, from 1 on; ``rows`` holds the embedding rows of each number. Words without a ``telling`` row are 0."""

    def __init__(self, telling: np.ndarray | None = None) -> None:
        super().__init__()
        self.telling = telling
        self.rows = [[0] * (len(PREFIXES) + 1)]

    def __missing__(self, word: str) -> int:
        rows = buckets_of(word)
        if self.telling is not None and not self.telling[rows].any():
            number = 0
        else:
            self.rows.append(rows)
            number = len(self.rows) - 1
        self[word] = number
        return number

    def numbers(self, text: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, text), dtype=np.int64, count=len(text))


def shortened(numbers: np.ndarray) -> np.ndarray:
    """A text with runs of words that tell nothing (0) cut to BLANK: the network gives the same for it."""
    told = np.flatnonzero(numbers)
    gaps = np.minimum(np.diff(told, prepend=-1, append=len(numbers)) - 1, BLANK)
    out = np.zeros(gaps.sum() + len(told), dtype=np.int64)
    out[np.cumsum(gaps[:-1] + 1) - 1] = numbers[told]
    return out


def shortened_texts(texts: list[str | None], telling: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Texts cut down to the words that tell, as numbers, and the embedding rows of each number."""
    rows, bounds = word_rows(texts)
    told = telling[rows].any(axis=1)
    numbers = np.where(told, np.cumsum(told), 0)
    table = np.concatenate([np.zeros((1, rows.shape[1]), dtype=np.int32), rows[told]])
    return [shortened(numbers[a:b]) for a, b in pairwise(bounds)], table


def chunks(batch: pa.RecordBatch, text_col: str = "text") -> Iterator[tuple[int, list[str | None]]]:
    """Texts of a batch, CHUNK characters at a time, and where in the batch they begin."""
    texts, held = [], 0
    for i, value in enumerate(batch.column(text_col)):
        texts.append(value.as_py())
        held += len(texts[-1] or "")
        if held > CHUNK:
            yield i + 1 - len(texts), texts
            texts, held = [], 0
    if texts:
        yield batch.num_rows - len(texts), texts


@dataclass
class Layout:
    """Texts in a row: embedding rows of their distinct words, the word at each place (0: padding), each text's begin.

    Between texts stand as many padding words as the widest filter reaches over; a text has one place at least.
    """

    rows: np.ndarray
    places: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, texts: list[np.ndarray], rows: np.ndarray) -> Layout:
        pad = max(WIDTHS) - 1
        sizes = np.array([max(len(t), 1) + pad for t in texts], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        numbers = np.zeros(starts[-1], dtype=np.int64)
        for text, start in zip(texts, starts):
            numbers[start : start + len(text)] = text
        there = np.zeros(len(rows), dtype=np.int64)
        there[0] = there[numbers] = 1
        return cls(rows[np.flatnonzero(there)], (np.cumsum(there) - 1)[numbers], starts)


def _pool(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (text, POOL, filter) of each filter's largest values in each text, largest first, -1: no such place; and the values, 0 there.

    ``values`` has a row for each filter; it is used up.
    """
    at = np.full((len(starts) - 1, POOL, len(values)), -1, dtype=np.int64)
    kept = np.zeros(at.shape, dtype=values.dtype)
    filters, ends = np.arange(len(values)), starts[1:] - max(WIDTHS) + 1
    for i, (start, end) in enumerate(zip(starts.tolist(), ends.tolist())):
        mine = values[:, start:end]
        for k in range(min(POOL, end - start)):
            best = mine.argmax(axis=1)
            kept[i, k] = mine[filters, best]
            at[i, k] = best + start
            mine[filters, best] = -np.inf
    return at, kept


def _sums(index: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """For each of ``count`` indices the sum of its rows."""
    width = values.shape[1]
    flat = (index[:, None] * width + np.arange(width)).ravel()
    return np.bincount(flat, values.ravel(), count * width).reshape(count, width)


@dataclass
class Network:
    """Parameters; ``filters[w]`` is (w, DEPTH, FILTERS). ``shifts`` are the languages' thresholds in log-odds."""

    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    weights: np.ndarray
    intercept: np.ndarray
    shifts: dict[str, float]
    default: float
    trained: bool = True

    @classmethod
    def fresh(cls, seed: int = 7, rows: int = BUCKETS) -> Network:
        rng = np.random.default_rng(seed)
        embedding = rng.normal(0, 0.1, (rows, DEPTH)).astype(np.float32)
        embedding[0] = 0
        filters = {w: rng.normal(0, 0.5 / np.sqrt(w), (w, DEPTH, FILTERS)).astype(np.float32) for w in WIDTHS}
        biases = {w: np.zeros(FILTERS, dtype=np.float32) for w in WIDTHS}
        weights = rng.normal(0, 0.1, (len(WIDTHS), POOL, FILTERS)).astype(np.float32)
        return cls(embedding, filters, biases, weights, np.zeros(1, dtype=np.float32), {}, 0.0)

    def convolve(self, vectors: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Values of all filters, width by width, one row each, at every place: distinct words are projected first, then these are added."""
        out = np.empty((len(WIDTHS) * FILTERS, len(places)), dtype=np.float32)
        for i, width in enumerate(WIDTHS):
            mine = out[i * FILTERS : (i + 1) * FILTERS]
            mine[:] = self.biases[width][:, None]
            for k in range(width):
                mine[:, : len(places) - k] += np.take(self.filters[width][k].T @ vectors.T, places[k:], axis=1)
        return np.maximum(out, 0, out=out)

    def forward(self, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Log-odds of the texts; the words' vectors, and what pooling kept: places and values (text, width, POOL, FILTERS)."""
        vectors = self.embedding[layout.rows].sum(axis=1)
        pooled = _pool(self.convolve(vectors, layout.places), layout.starts)
        top, kept = (x.reshape(-1, POOL, len(WIDTHS), FILTERS).swapaxes(1, 2) for x in pooled)
        z = self.intercept[0] + (kept * self.weights).sum(axis=(1, 2, 3), dtype=np.float64)
        return z, vectors, top, kept

    def logits(self, texts: list[np.ndarray], table: np.ndarray) -> np.ndarray:
        return self.forward(Layout.of(texts, table))[0]

    def params(self) -> dict[str, np.ndarray]:
        """The embedding first, then all that isn't by rows."""
        own = {"embedding": self.embedding, "weights": self.weights, "intercept": self.intercept}
        return own | {f"filter{w}": self.filters[w] for w in WIDTHS} | {f"bias{w}": self.biases[w] for w in WIDTHS}

    def scores(self, numbers: list[np.ndarray], table: np.ndarray, languages: list[str]) -> np.ndarray:
        """Scores of texts given by numbers, whose embedding rows ``table`` has; ``languages`` are those that the profiles see in them."""
        shift = np.array([self.shifts.get(lang, self.default) for lang in languages])
        z = np.clip(self.logits(numbers, table) - shift + np.log(DECISION / (1 - DECISION)), -40, 40)
        return 1 / (1 + np.exp(-z))


def _gradients(net: Network, texts: list[np.ndarray], table: np.ndarray, labels: np.ndarray) -> dict:
    """Gradients of the mean log loss; only the places that pooling kept carry any."""
    layout = Layout.of(texts, table)
    z, vectors, top, kept = net.forward(layout)
    error = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) / len(texts)).astype(np.float32)
    grads = {"weights": np.einsum("b,bwkf->wkf", error, kept), "intercept": np.array([error.sum()], dtype=np.float32)}
    up = error[:, None, None, None] * net.weights * (kept > 0)
    words, pulls = [], []
    for i, width in enumerate(WIDTHS):
        grads[f"bias{width}"] = up[:, i].sum(axis=(0, 1))
        grads[f"filter{width}"] = np.zeros_like(net.filters[width])
        b, k, f = np.nonzero(up[:, i])
        grad, at = up[b, i, k, f], top[b, i, k, f]
        by_filter = np.where(f == np.arange(FILTERS)[:, None], grad, np.float32(0))
        for offset in range(width):  # padding follows each text
            word = layout.places[at + offset]
            grads[f"filter{width}"][offset] = (by_filter @ vectors[word]).T
            words.append(word)
            pulls.append(grad[:, None] * net.filters[width][offset].T[f])
    words = np.concatenate(words)
    by_word = _sums(words, np.concatenate(pulls), len(vectors))
    met = np.flatnonzero(np.bincount(words, minlength=len(vectors)))
    mine, column = np.nonzero(layout.rows[met])  # row 0 stays as it is
    rows = layout.rows[met[mine], column]
    grads["rows"], place = np.unique(rows, return_inverse=True)
    grads["embedding"] = _sums(place, by_word[met[mine]], len(grads["rows"])).astype(np.float32)
    return grads


def descend(net: Network, texts: list[np.ndarray], table: np.ndarray, labels: np.ndarray, epochs: int, seed: int) -> None:
    """Adam on the mean log loss; row 0 of the embedding stays 0."""
    rng, params = np.random.default_rng(seed), net.params()
    first = {n: np.zeros_like(p) for n, p in params.items()}
    second = {n: np.zeros_like(p) for n, p in params.items()}
    steps = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            blanked = [np.where(rng.random(len(texts[i])) < BLANKED, 0, texts[i]) for i in chosen]
            grads = _gradients(net, blanked, table, labels[chosen])
            rows = grads.pop("rows")
            steps += 1
            for name, param in params.items():
                # Of the embedding, only rows that the step touched move.
                at_rows = rows if name == "embedding" else slice(None)
                grad, mean, square = grads[name], first[name][at_rows], second[name][at_rows]
                mean = mean + 0.1 * (grad - mean)
                square = square + 0.001 * (grad**2 - square)
                first[name][at_rows], second[name][at_rows] = mean, square
                step = RATE * mean / (1 - 0.9**steps) / (np.sqrt(square / (1 - 0.999**steps)) + 1e-7)
                param[at_rows] -= step.astype(param.dtype)


def telling_rows(texts: DataFrame, clean: int, toxic: int) -> np.ndarray:
    """The rows of the embedding that are words or stems of SHARED_BY of ``texts`` at least whose labels differ from the others'.

    The difference of the two labels' rates must be TELLING standard errors or more; words that say nothing share row 0.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            labels = batch.column("label").to_pylist()
            for begin, some in chunks(batch):
                found, bounds = word_rows(some)
                for i, (a, b) in enumerate(pairwise(bounds), begin):
                    seen[labels[i], found[a:b].ravel()] += 1  # a row that is there more than once counts once
        rows = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(seen[0, rows]), pa.array(seen[1, rows])], names=["row", "clean", "toxic"])

    counted = texts.select("text", "label").mapInArrow(count, "row int, clean long, toxic long").groupBy("row").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rate = (F.col("clean") + F.col("toxic")) / (clean + toxic)
    error = F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-9)) * (1 / clean + 1 / toxic))
    differ = F.abs(F.col("toxic") / toxic - F.col("clean") / clean) >= TELLING * error
    return np.array(sorted(r.row for r in counted.filter((F.col("clean") + F.col("toxic") >= SHARED_BY) & differ).select("row").collect()), dtype=np.int64)


def shorten_texts(marked: DataFrame, told: np.ndarray, profiles: Profiles) -> DataFrame:
    """Rows with their texts cut down: for each word left, the places of its embedding rows in ``told`` from 1 on; of those held back also the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.zeros(BUCKETS, dtype=np.int32)
        index[told] = np.arange(1, len(told) + 1)
        for batch in batches:
            places, languages, helds = [], [], batch.column("held").to_pylist()
            for begin, some in chunks(batch):
                numbers, table = shortened_texts(some, index > 0)
                table = index[table]
                places += [table[mine].tobytes() for mine in numbers]
                languages += [profiles.predict(text)[0] if held else UNKNOWN for text, held in zip(some, helds[begin:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("key", "held", "label")), pa.array(languages, pa.string()), pa.array(places, pa.binary())], names=["key", "held", "label", "language", "places"])

    return marked.select("text", "key", "held", "label").mapInArrow(run, "key long, held boolean, label int, language string, places binary")


def _numbered(places: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Texts as numbers of distinct words, and the embedding rows of each number."""
    width = len(PREFIXES) + 1
    rows = np.frombuffer(bytes(width * 4) + b"".join(places), dtype=np.int32).reshape(-1, width).astype(np.int64)
    # Rows are below BUCKETS, so three of them make one number.
    first, numbers = np.unique(rows @ (BUCKETS ** np.arange(width)[::-1]), return_index=True, return_inverse=True)[1:]
    return np.split(numbers[1:], np.cumsum([len(p) // (4 * width) for p in places])[:-1]), rows[first]


def packed(texts: DataFrame, parts: int) -> DataFrame:
    """``texts`` in groups, one row each: what ``descend`` needs, as bytes. Each round reads it without dealing texts out anew."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("key", "ascending"), ("label", "ascending"), ("places", "ascending")])
        # Texts without words are clean; a few among the others say so.
        empty = 4 + group.num_rows // 50
        numbers, table = _numbered(group.column("places").to_pylist() + [b""] * empty)
        labels = np.append(group.column("label").to_numpy(), np.zeros(empty))
        kinds = {"sizes": [len(text) for text in numbers], "numbers": np.concatenate(numbers), "embedded": table.ravel(), "labels": labels}
        return pa.table({"n": [group.num_rows]} | {name: pa.array([np.asarray(x, dtype=np.int32).tobytes()], pa.binary()) for name, x in kinds.items()})

    groups = texts.withColumn("part", F.pmod("key", F.lit(parts))).select("part", "key", "label", "places").groupBy("part")
    return materialize(groups.applyInArrow(pack, "n long, sizes binary, numbers binary, embedded binary, labels binary"))


def train(texts: DataFrame, rows: int, told: int, seed: int = 7) -> Network:
    """A network over ``told`` rows of an embedding, and row 0, trained on all ``texts``."""
    net = Network.fresh(seed, told + 1)
    parts = -(-rows // GROUP)
    # Small tables get more passes: the network needs some hundred steps.
    epochs = min(max(EPOCHS, 300 * BATCH * parts // rows), 60) // ROUNDS
    groups = packed(texts, parts)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, *kinds in (row for batch in batches for row in zip(*(batch.column(c) for c in ("n", "sizes", "numbers", "embedded", "labels")))):
            n, (sizes, places, table, labels) = n.as_py(), (np.frombuffer(x.as_py(), dtype=np.int32).astype(np.int64) for x in kinds)
            mine, table, numbers = copy.deepcopy(net), table.reshape(-1, len(PREFIXES) + 1), np.split(places, np.cumsum(sizes)[:-1])
            descend(mine, numbers, table, labels.astype(np.float32), epochs, seed + turn)
            having = np.zeros(told + 1)
            for text in numbers:
                having[table[text].ravel()] += 1  # a row that is there more than once counts once
            embedding, *others = mine.params().values()
            vector = [(embedding * having[:, None]).ravel(), *(p.ravel() * float(n) for p in others), having]
            yield cut(np.concatenate(vector), n)

    for turn in range(ROUNDS):
        total, n = summed(groups.mapInArrow(learn, KIND))
        having, at = total[-told - 1 :], 0
        for name, param in net.params().items():
            mean = total[at : at + param.size].reshape(param.shape) / (np.maximum(having, 1)[:, None] if name == "embedding" else n)
            moved = having > 0 if name == "embedding" else slice(None)
            param[moved] = mean[moved]
            at += param.size
        net.embedding[0] = 0
    return net


def best_threshold(z: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
    """The log-odds that maximise F1 with weighted rows; in the widest gap that does, nearer to its upper end.

    Where no cut marks mostly toxic rows (LEAST_PRECISION), the threshold is above all of them: nothing is marked.
    """
    order = np.argsort(-z)
    z, labels, weight = z[order], labels[order], weight[order]
    hits, marked = np.cumsum(labels * weight), np.cumsum(weight)
    f1 = 2 * hits / (marked + (labels * weight).sum())
    below = np.append(z[1:], z[-1] - 2)
    cuts = np.flatnonzero((z - below > 1e-6) & (hits >= LEAST_PRECISION * marked))
    if not len(cuts):
        return float(z[0] + 2)
    best = cuts[f1[cuts] >= f1[cuts].max() - 1e-9]
    widest = best[np.argmax((z - below)[best])]
    return float(0.7 * z[widest] + 0.3 * below[widest])


def fit_toxicity(docs: DataFrame, labels: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", least: int = 12) -> Network:
    """Train on all rows of ``docs`` that have a label of 0 or 1 in ``labels`` (rows without either teach nothing).

    ``least``: rows of each label that a language needs for a threshold of its own; else all languages' one holds.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1) and id is not null")
    marks = marks.groupBy("id").agg(F.max("label").alias("label"))
    held = F.crc32(F.concat(F.lit("calibrate "), F.col("id").cast("string")).cast("binary")) % CALIBRATION == 0
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(marks.hint("shuffle_hash"), "id")
    marked = materialize(marked.select("text", "label", F.xxhash64("id", "text").alias("key"), held.alias("held")))
    sizes = {(r.held, r.label): r["count"] for r in marked.groupBy("held", "label").count().collect()}
    if {label for _, label in sizes} != {0, 1}:
        return Network(*(None,) * 5, shifts={}, default=0.0, trained=False)
    if len(sizes) < 4:  # too few to part
        marked = marked.withColumn("held", F.lit(True))
        learning, back = "held", True
    else:
        learning, back = "not held", False
    clean, toxic = (sum(n for (h, label), n in sizes.items() if label == kind and (back or not h)) for kind in (0, 1))
    told = telling_rows(marked.filter(learning), clean, toxic)
    short = materialize(shorten_texts(marked, told, profiles))
    net = train(short.filter(learning), clean + toxic, len(told))
    _set_thresholds(net, short.filter("held"), least)
    whole = np.zeros((BUCKETS, DEPTH), dtype=np.float32)
    whole[told] = net.embedding[1:]
    net.embedding = whole
    return net


def _set_thresholds(net: Network, held: DataFrame, least: int) -> None:
    """Thresholds from the log-odds of all rows held back; how many rows share a step of GRID is counted by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, table = _numbered(batch.column("places").to_pylist())
            found = [net.logits(texts[i : i + BATCH], table) for i in range(0, len(texts), BATCH)]
            yield pa.RecordBatch.from_arrays([batch.column("language"), batch.column("label"), pa.array(np.concatenate(found or [np.zeros(0)]))], names=["language", "label", "z"])

    step = F.floor(F.least(F.greatest("z", F.lit(-40.0)), F.lit(40.0)) * GRID)
    scored = held.select("language", "label", "places").mapInArrow(run, "language string, label int, z double")
    counted = Counter({(r.language, r.label, r.step): r.n for r in scored.groupBy("language", "label", step.alias("step")).agg(F.count("*").alias("n")).collect()})
    empty = net.logits([np.zeros(0, dtype=np.int64)], np.zeros((1, len(PREFIXES) + 1), dtype=np.int64))[0]
    counted[UNKNOWN, 0, int(np.floor(np.clip(empty, -40, 40) * GRID))] += 1 + sum(counted.values()) // 50
    languages = np.array([language for language, _, _ in counted], dtype=object)
    labels, steps, n = (np.array(x, dtype=np.float64) for x in ([k[1] for k in counted], [k[2] for k in counted], list(counted.values())))
    net.default = best_threshold(steps / GRID, labels, n)
    for language in sorted(set(languages)):
        mine = languages == language
        if min(n[mine & (labels == 1)].sum(), n[mine & (labels == 0)].sum()) >= least:
            net.shifts[language] = best_threshold(steps[mine] / GRID, labels[mine], n[mine])


def score_toxicity(docs: DataFrame, net: Network, profiles: Profiles, text_col: str = "text", score_out: str = "score", predicted_out: str = "predicted") -> DataFrame:
    """``docs`` with the score and, from DECISION on, predicted 1."""
    handle = docs.sparkSession.sparkContext.broadcast((net, profiles))
    kept = [n for n in docs.columns if n not in (score_out, predicted_out)]
    schema = T.StructType([docs.schema[n] for n in kept] + [T.StructField(score_out, T.DoubleType()), T.StructField(predicted_out, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, speech = handle.value
        telling = mine.embedding.any(axis=1) if mine.trained else None
        for batch in batches:
            scores: list[np.ndarray] = []
            for _, some in chunks(batch, text_col) if mine.trained else ():
                scores.append(mine.scores(*shortened_texts(some, telling), [speech.predict(text)[0] for text in some]))
            if not mine.trained:
                scores.append(np.zeros(batch.num_rows))
            score = np.concatenate(scores) if scores else np.zeros(0)
            columns = [batch.column(n) for n in kept] + [pa.array(score), pa.array((score >= DECISION).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, score_out, predicted_out])

    return docs.mapInArrow(run, schema)

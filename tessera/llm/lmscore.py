"""Language-model scores by masked pseudo-likelihood.

A network sees REACH tokens on both sides of a place, never the token itself, and gives the probability of every token
of the vocabulary there; a document's score is the sum of the log-probabilities of its tokens, each given the others.

The vocabulary is the corpus's most frequent words, counted exactly over all documents, and OTHER buckets that share the
rest by hash; it grows with the fourth root of the corpus's distinct words on each side. Exact counts of all tokens are also
the network's starting point (the log-odds of each token without context), and a word's own exact count says how likely it
is within its bucket: (n + 1) of the sum of n + 1 over the bucket's words and one unseen word. Tokens are grouped in classes
of like count, so a probability is that of the class times that within it, and a place costs two small softmaxes instead of
one over the vocabulary.

Weights are trained in numpy with Adam: first on the driver on at most TRAIN_ROWS documents chosen by hash, so that all tasks
start from one place, then in tasks on every token of every document; the weights of the tasks are averaged by their
tokens, in slots that are summed in executors, so that the driver gets one model whatever the number of tasks.

Scoring is one pass over whole texts, PIECE places at a time, sorted by class and worked off in parts of PART. Words in
buckets have their own counts: those of the COMMON most frequent ones are with all tasks, all rarer words meet theirs in
a join by word.

Defined cases: null and empty texts have no tokens and a sum of 0; an empty corpus gives scores of 0; repeated rows give
repeated results; other columns stay, and result columns take the place of columns of the same name.
"""

from __future__ import annotations

import copy
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.averaging import KIND, cut, summed
from tessera.llm.shared import materialize

WORDS = r"[^\x20\x09-\x0D]+"
SPLIT = re.compile(WORDS)
VOCABULARY = 960
OTHER = 64
SIDE = 32  # classes, and tokens of a class, at least: SIDE * SIDE = VOCABULARY + OTHER
SIDE_WORDS = 500_000  # distinct words from which on there are more
REACH = 2
OFFSETS = (*range(-REACH, 0), *range(1, REACH + 1))
WIDTH = 24
TRAIN_ROWS = 1_500
TRAIN_TOKENS = 400_000
EPOCHS, BATCH, RATE = 2, 2048, 0.01
ALL_BATCH, ALL_RATE = 8192, 0.003  # of the pass over all documents
PIECE = 1 << 18  # tokens that a task holds at a time
#: Words whose own counts go to all tasks, at most; rarer ones meet theirs in a join.
COMMON = 100_000
PART = 1 << 11  # places whose probabilities are worked out at once, so that they stay in a core's cache
CHARS = 1 << 21  # characters of texts that are parted into words at once
COUNT_CHARS = 1 << 23  # and counted
LONG = 32  # bytes of a word up to which its hash is looked up byte by byte
#: What str.split() takes for white space beside the six characters that part words here.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def tokens_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    return SPLIT.findall(text) if OTHER_SPACE.search(text) else text.split()


def lowered(batches: Iterator[pa.RecordBatch], text_col: str, chars: int) -> Iterator[list[str]]:
    """Lower-case texts (null: empty) in order, about ``chars`` characters at a time."""
    held, size = [], 0
    for batch in batches:
        for text in batch.column(text_col):
            held.append((text.as_py() or "").lower())
            size += len(held[-1])
            if size >= chars:
                yield held
                held, size = [], 0
    if held:
        yield held


def words_in(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, which are in lower case, in one array, and how many each text has: those of ``tokens_of``."""
    split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    words, sizes = split.flatten(), pc.list_value_length(split).to_numpy().astype(np.int64)
    empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # beside white space at the ends of a text
    if empty.any():
        words = words.filter(pa.array(~empty))
        sizes -= np.bincount(np.repeat(np.arange(len(texts)), sizes)[empty], minlength=len(texts))
    return words, sizes


def _places_in(words: pa.Array, among: pa.Array, missing: int) -> np.ndarray:
    return pc.fill_null(pc.index_in(words, value_set=among), missing).to_numpy(zero_copy_only=False).astype(np.int64)


# A CRC is linear: that of a word is that of as many zero bytes, with each byte's share by its distance from the end.
_ZEROS = np.array([zlib.crc32(bytes(n)) for n in range(LONG + 1)], dtype=np.uint32)
_SHARES = np.array([[zlib.crc32(bytes([b]) + bytes(d)) ^ zlib.crc32(bytes(d + 1)) for b in range(256)] for d in range(LONG)], dtype=np.uint32)


def crc32s(words: pa.Array) -> np.ndarray:
    """zlib.crc32 of each word of a large_string array without nulls."""
    if not len(words):
        return np.zeros(0, dtype=np.uint32)
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    sizes = np.diff(ends)
    short = np.minimum(sizes, LONG)
    order = np.argsort(short.astype(np.uint8), kind="stable")[::-1]
    longer = len(words) - np.cumsum(np.bincount(short, minlength=LONG + 1))  # words of more than so many bytes stand first
    last, found = ends[1:][order] - 1, _ZEROS[short[order]]
    for d in range(LONG):
        found[: longer[d]] ^= _SHARES[d][data[last[: longer[d]] - d]]
    out = np.empty_like(found)
    out[order] = found
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = zlib.crc32(words[i].as_buffer())
    return out


@dataclass
class Model:
    """``number`` maps frequent words to 0 .. vocabulary - 1; number + 1 is a token's row in the context tables."""

    number: dict[str, int]
    inside: np.ndarray  # log-probability of a word within its token, by token: 0, or that of an unseen word in a bucket
    context: np.ndarray  # (2 * REACH, tokens + 1, WIDTH)
    hidden: np.ndarray
    classes: np.ndarray  # (WIDTH, side)
    class_bias: np.ndarray
    members: np.ndarray  # (side, WIDTH, side)
    member_bias: np.ndarray
    rest: DataFrame | None = None  # (word, n) of all words in buckets
    own: dict[str, float] | None = None  # logarithm of count + 1 of the COMMON most frequent words in buckets
    least: int = 1  # their smallest count
    names: pa.Array | None = None  # the words of ``number``

    @property
    def side(self) -> int:
        return len(self.class_bias)

    @property
    def vocabulary(self) -> int:
        return self.side**2 - OTHER

    def numbers(self, words: list[str] | pa.Array) -> np.ndarray:
        if self.names is None:
            self.names = pa.array(list(self.number), pa.large_string())
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.large_string())
        found = _places_in(words, self.names, -1)
        found[found < 0] = self.vocabulary + crc32s(words.filter(pa.array(found < 0))) % OTHER
        return found

    def __getstate__(self) -> dict:
        return self.__dict__ | {"names": None}

    def state(self, around: list[np.ndarray]) -> np.ndarray:
        """Hidden state from the rows (0: none) of the tokens around each place, and a 1 for the bias."""
        z = np.take(self.context[0], around[0], axis=0)
        z += self.hidden
        for k in range(1, len(OFFSETS)):
            z += np.take(self.context[k], around[k], axis=0)
        out = np.empty((len(z), WIDTH + 1), dtype=z.dtype)
        np.tanh(z, out=out[:, :WIDTH])
        out[:, WIDTH] = 1
        return out

    def heads(self) -> tuple[np.ndarray, bool]:
        """For each class the weights of all classes and of its members, biases last; whether logits can be too large for exp."""
        side = self.side
        heads = np.empty((side, 2 * side, WIDTH + 1), dtype=np.float32)
        heads[:, :side, :WIDTH], heads[:, :side, WIDTH] = self.classes.T, self.class_bias
        heads[:, side:, :WIDTH], heads[:, side:, WIDTH] = self.members.transpose(0, 2, 1), self.member_bias
        return heads, not np.abs(heads).sum(axis=2).max() < 80  # states lie within -1 and 1

    def log_probabilities(self, numbers: np.ndarray) -> np.ndarray:
        """Log-probability of each token given those around it."""
        padded = np.zeros(len(numbers) + 2 * REACH, dtype=np.int64)
        padded[REACH:-REACH] = numbers + 1
        return self.at_places(padded, np.arange(len(numbers)) + REACH)

    def at_places(self, row: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The same at places of a row of padded texts."""
        out = np.empty(len(places), dtype=np.float64)
        side, (heads, far) = self.side, self.heads()
        space, steps = np.empty(2 * side * PART, dtype=np.float32), np.arange(PART)
        for first in range(0, len(places), PIECE):
            piece = places[first : first + PIECE]
            order, group, member = _by_class(row[piece] - 1, side)
            for start in range(0, len(piece), PART):
                chosen = order[start : start + PART]
                state, mine = self.state(_around(row, piece[chosen])), member[start : start + PART]
                found = np.empty(len(chosen), dtype=np.float32)
                for c, part in _parts(group[start : start + PART], side):
                    z = _logits(state[part], heads[c], far, space)
                    picked = z[c] + z.reshape(-1)[(mine[part] + side) * z.shape[1] + steps[: z.shape[1]]]
                    np.exp(z, out=z)
                    found[part] = picked - np.log(z.reshape(2, side, -1).sum(axis=1)).sum(axis=0)
                out[first + chosen] = found
        return out + self.inside[row[places] - 1]


def _order(values: np.ndarray, count: int) -> np.ndarray:
    """Stable order of values below ``count``; short integers are sorted by radix."""
    return np.argsort(values.astype(np.uint16) if count <= 1 << 16 else values, kind="stable")


def _by_class(tokens: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order of tokens by class, and in it each one's class and place within the class."""
    group = tokens // side
    order = _order(group, side)
    group = group[order]
    return order, group, tokens[order] - group * side


def _around(row: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [row[at + offset] for offset in OFFSETS]


def _parts(group: np.ndarray, side: int) -> Iterator[tuple[int, slice]]:
    """Classes that are there, with where each stands in the sorted ``group``, PART places at a time."""
    bounds = np.searchsorted(group, np.arange(side + 1)).tolist()
    for c, (first, end) in enumerate(zip(bounds, bounds[1:])):
        for start in range(first, end, PART):
            yield c, slice(start, min(start + PART, end))


def _row_of(texts: list[np.ndarray]) -> np.ndarray:
    """Texts with REACH places between them and around."""
    gap = np.zeros(REACH, dtype=np.int64)
    return np.concatenate([gap, *(part for t in texts for part in (t + 1, gap))]) if texts else gap


def _logits(state: np.ndarray, head: np.ndarray, far: bool, space: np.ndarray) -> np.ndarray:
    """One row for each class, then for each member, in ``space``; small enough for exp as they are."""
    z = np.matmul(head, state.T, out=space[: len(head) * len(state)].reshape(len(head), len(state)))
    return np.clip(z, -80, 80, out=z) if far else z


def fresh(words: list[str], counts: np.ndarray, inside: np.ndarray, seed: int = 5) -> Model:
    """A model that knows the corpus's counts and nothing of contexts."""
    rng = np.random.default_rng(seed)
    side = math.isqrt(len(counts))
    table = (counts + 1.0).reshape(side, side)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    context = small(2 * REACH, side * side + 1, WIDTH)
    context[:, 0] = 0
    bias = np.log(table.sum(axis=1) / table.sum()).astype(np.float32)
    within = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)
    return Model({w: i for i, w in enumerate(words)}, inside, context, np.zeros(WIDTH, dtype=np.float32), small(WIDTH, side), bias, small(side, WIDTH, side), within)


PARAMS = ("context", "hidden", "classes", "class_bias", "members", "member_bias")


BLOCK = 1 << 14  # numbers that Adam changes at a time


class Adam:
    def __init__(self, model: Model, rate: float = RATE):
        self.model, self.rate, self.steps = model, rate, 0
        self.first, self.second = ({n: np.zeros_like(getattr(model, n)) for n in PARAMS} for _ in range(2))

    def step(self, row: np.ndarray, at: np.ndarray) -> None:
        grads = gradients(self.model, row, at)
        self.steps += 1
        for name in PARAMS:
            whole = [x.reshape(-1) for x in (getattr(self.model, name), grads[name], self.first[name], self.second[name])]
            for start in range(0, len(whole[0]), BLOCK):
                param, grad, first, second = (x[start : start + BLOCK] for x in whole)
                first *= 0.9
                step = grad * 0.1
                first += step
                second *= 0.999
                np.multiply(grad, grad, out=step)
                step *= 0.001
                second += step
                np.divide(second, 1 - 0.999**self.steps, out=step)
                np.sqrt(step, out=step)
                step += 1e-7
                np.divide(first, step, out=step)
                step *= self.rate / (1 - 0.9**self.steps)
                param -= step


def train(model: Model, texts: list[np.ndarray], epochs: int = EPOCHS, seed: int = 5) -> None:
    """Adam on the mean negative log-probability of TRAIN_TOKENS places, chosen anew in each epoch."""
    rng = np.random.default_rng(seed)
    row = _row_of(texts)
    places = np.flatnonzero(row)
    adam = Adam(model)
    for _ in range(epochs):
        chosen = rng.permutation(places)[:TRAIN_TOKENS]
        for start in range(0, len(chosen), BATCH):
            adam.step(row, chosen[start : start + BATCH])


def train_on_all(model: Model, texts: DataFrame) -> int:
    """One pass over every token of all texts, in tasks, each from ``model``; their mean by tokens takes its place. Gives the tokens."""
    handle = texts.sparkSession.sparkContext.broadcast(model)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, rng = copy.deepcopy(handle.value), np.random.default_rng(5)
        adam, held, size, seen = Adam(mine, ALL_RATE), [], 0, 0

        def descend() -> None:
            row = _row_of(held)
            places = rng.permutation(np.flatnonzero(row))
            for at in np.array_split(places, -(-len(places) // ALL_BATCH)):
                adam.step(row, at)
            held.clear()

        for texts in lowered(batches, "text", CHARS):
            words, sizes = words_in(texts)
            for numbers in np.split(mine.numbers(words), np.cumsum(sizes)[:-1]):
                held.append(numbers)
                size += len(numbers)
                if size >= PIECE:
                    descend()
                    seen, size = seen + size, 0
        if size:
            descend()
        seen += size
        if seen:
            yield cut(np.concatenate([getattr(mine, n).ravel() for n in PARAMS]).astype(np.float64) * seen, seen)

    total, tokens = summed(texts.select("text").mapInArrow(learn, KIND))
    handle.unpersist()
    if not tokens:
        return 0
    flat, at = total / tokens, 0
    for name in PARAMS:
        old = getattr(model, name)
        setattr(model, name, flat[at : at + old.size].reshape(old.shape).astype(old.dtype))
        at += old.size
    return tokens


def gradients(model: Model, row: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean negative log-probability at places of a row of padded texts."""
    n, side = len(at), model.side
    order, group, member = _by_class(row[at] - 1, side)
    around = _around(row, at[order])
    state = model.state(around)
    heads, far = model.heads()
    by_head = np.zeros_like(heads)
    back = np.empty((n, WIDTH), dtype=np.float32)
    space, steps = np.empty(2 * side * PART, dtype=np.float32), np.arange(PART)
    for c, part in _parts(group, side):
        z = _logits(state[part], heads[c], far, space)
        np.exp(z, out=z)
        both = z.reshape(2, side, -1)  # among the classes, and within the one
        share = both.sum(axis=1, keepdims=True)
        both *= np.divide(1 / n, share, out=share)
        z[c] -= 1 / n
        z.reshape(-1)[(member[part] + side) * z.shape[1] + steps[: z.shape[1]]] -= 1 / n
        by_head[c] += z @ state[part]
        np.matmul(z.T, heads[c, :, :WIDTH], out=back[part])
    to_class, to_member = by_head[:, :side].sum(axis=0), by_head[:, side:]
    grads = {"classes": to_class[:, :WIDTH].T, "class_bias": to_class[:, WIDTH], "members": to_member[:, :, :WIDTH].transpose(0, 2, 1), "member_bias": to_member[:, :, WIDTH]}
    state *= state
    back *= np.subtract(1, state, out=state)[:, :WIDTH]
    grads["hidden"] = back.sum(axis=0)
    grads["context"] = np.empty_like(model.context)
    # Two neighbouring numbers of a row are one complex number, so that one addition serves both.
    pairs = np.ascontiguousarray(back.view(np.complex64).T)
    for k, near in enumerate(around):
        sums = np.zeros((WIDTH // 2, model.context.shape[1]), dtype=np.complex64)
        for total, numbers in zip(sums, pairs):
            np.add.at(total, near, numbers)
        grads["context"][k] = np.ascontiguousarray(sums.T).view(np.float32)
    grads["context"][:, 0] = 0
    return grads


def fit_model(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> Model | None:
    """Counts over all documents, training from ``rows`` of them, then on all; None for a corpus without words."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in lowered(batches, "text", COUNT_CHARS):
            counts = words_in(some)[0].value_counts()
            yield pa.RecordBatch.from_arrays([counts.field("values").cast(pa.string()), counts.field("counts")], names=["word", "n"])

    counted = texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = materialize(counted)
    side = max(SIDE, int(SIDE * (counted.count() / SIDE_WORDS) ** 0.25))
    vocabulary = side * side - OTHER
    top = counted.orderBy(F.desc("n"), "word").limit(vocabulary).collect()
    if not top:
        return None
    known = counted.sparkSession.createDataFrame([(r.word,) for r in top], "word string")
    bucket = F.crc32(F.col("word").cast("binary")) % OTHER
    others = counted.join(F.broadcast(known), "word", "left_anti")
    rest = others.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
    counts, inside = np.zeros(side * side), np.zeros(side * side)
    counts[: len(top)] = [r.n for r in top]
    for r in rest:
        counts[vocabulary + r.bucket] = r.n
        inside[vocabulary + r.bucket] = -np.log(r.n + r.words + 1)
    model = fresh([r.word for r in top], counts, inside)
    total, span = texts.count(), 1 << 20
    share = min(span, -(-rows * span // max(total, 1)))
    # Rows that are alike count once, so copies of a row or rows without an id can't outgrow the bound.
    sample = texts.filter(F.pmod(F.xxhash64("id", "text"), F.lit(span)) < share).dropDuplicates().collect()
    train(model, [model.numbers(tokens_of(r.text)) for r in sorted(sample, key=lambda r: (r.id is None, r.id or 0, r.text))])
    train_on_all(model, texts)
    if rest:
        model.rest = others
        model.least, model.own = _common(others)
    return model


def _common(counts: DataFrame) -> tuple[int, dict[str, float]]:
    """The least count of which there are no more than COMMON words with it or more, by steps of an eighth of a power of two, and their logarithms."""
    step = F.floor(F.log2("n") * 8)
    steps = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect(), reverse=True)
    words, least = 0, None
    for r in steps:
        words += r.words
        if words > COMMON:
            break
        least = r.least
    if least is None:
        return 1 << 62, {}
    return least, {r.word: math.log(r.n + 1.0) for r in counts.filter(F.col("n") >= least).collect()}


def score_documents(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with n_tokens, log_likelihood (the sum over the document) and per_token (its mean, null without tokens)."""
    counts = model.rest if model else None
    handle = docs.sparkSession.sparkContext.broadcast(replace(model, rest=None) if model else None)
    added = {"n_tokens": T.LongType(), "log_likelihood": T.DoubleType()}
    kept = [n for n in (docs.columns if keep is None else keep) if n not in (*added, "per_token")]
    extra = [T.StructField("__row", T.LongType()), T.StructField("__rest", T.ArrayType(T.StringType()))] if counts is not None else []
    schema = T.StructType([docs.schema[n] for n in kept] + [T.StructField(n, kind) for n, kind in added.items()] + extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, row_id = handle.value, TaskContext.get().partitionId() << 40
        own = pa.array(list(mine.own), pa.large_string()) if extra else None
        logs = np.array([*mine.own.values(), 0.0]) if extra else None
        for batch in batches:
            sizes, sums, rest = [np.zeros(0, dtype=np.int64)], [np.zeros(0)], [pa.array([], pa.list_(pa.string()))]
            for texts in lowered(iter([batch]), text_col, CHARS):
                words, each = words_in(texts)
                sizes.append(each)
                if not mine:
                    sums.append(np.zeros(len(texts)))
                    continue
                numbers, of = mine.numbers(words), np.repeat(np.arange(len(texts)), each)
                row = _row_of(np.split(numbers, np.cumsum(each)[:-1]))
                sums.append(np.bincount(of, mine.at_places(row, np.flatnonzero(row)), len(texts)))
                if extra:
                    rare = numbers >= mine.vocabulary
                    words, of = words.filter(pa.array(rare)), of[rare]
                    found = _places_in(words, own, len(own))
                    sums[-1] += np.bincount(of, logs[found], len(texts))
                    left = found == len(own)
                    ends = np.cumsum(np.bincount(of[left], minlength=len(texts)))
                    rest.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), words.filter(pa.array(left)).cast(pa.string())))
            sizes, sums = np.concatenate(sizes), np.concatenate(sums)
            columns = [batch.column(n) for n in kept] + [pa.array(sizes, pa.int64()), pa.array(sums, pa.float64())]
            if extra:
                columns += [pa.array(range(row_id, row_id + len(sizes)), pa.int64()), pa.concat_arrays(rest)]
                row_id += len(sizes)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    scored = docs.mapInArrow(run, schema)
    if extra:
        scored = materialize(scored)
        words = scored.select("__row", F.explode("__rest").alias("word"))
        own = words.join(counts.filter(F.col("n") < model.least), "word").groupBy("__row").agg(F.sum(F.log(F.col("n") + 1.0)).alias("__own"))
        scored = scored.drop("__rest").join(own, "__row", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("__own", F.lit(0.0))).drop("__row", "__own")
    return scored.withColumn("per_token", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))

"""Language identification by rank-order n-gram profiles.

A language's profile is the list of the n-grams (1 to 3 letters, words padded with a space on both sides) that are most
frequent in texts known to be of it, by rank. A text's own profile is made the same way, and its distance to a language
is the sum over its n-grams of how far out of place each is there (an n-gram that the language's profile lacks counts
as if it were one place behind the last). The nearest language wins; equal distances go to the smaller name.

Fitting reads all labelled rows. N-grams are counted in tasks and summed by Spark; of each language only its most frequent
ones reach the driver. Prediction is one pass without a shuffle.

Defined cases: a text that is null or has no letter is ``und`` with score 0; with nothing to learn from, every text is
``und``; repeated rows give repeated results; other columns stay, and result columns take the place of columns of the
same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Places in a profile.
PLACES = 300
#: N-grams that a task counts at a time, and distinct ones that it holds counts of, about.
GRAMS, HELD = 1_000_000, 2_000_000
#: Steps of a score that the known texts' scores are counted by.
STEPS = 1 << 16
UNKNOWN = "und"
#: Texts with fewer letters than this are too short to be told from noise by their score.
LETTERS = 20
#: Bits of a letter in an n-gram's code; code points have 21, so three letters fit into 63.
BITS = 21
#: N-grams are counted in a table where letters are below the first, or the text's length, and it has up to the second times as many places as letters.
NEAR_LETTERS, SPARSE = 0x800, 48

_FOLD: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """Code point -> lower-case code point of a letter; a space for all else."""
    global _FOLD
    if _FOLD is None:
        table = np.full(0x110000, 32, dtype=np.int64)
        for code in range(0x110000):
            letter = chr(code)
            if letter.isalpha():
                low = letter.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _FOLD = table
    return _FOLD


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters of the text, runs of anything else as one space, with a space at both ends."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    folded = np.empty(len(codes) + 2, dtype=np.int64)
    folded[0] = folded[-1] = 32
    np.take(fold_table(), codes, out=folded[1:-1], mode="clip")
    letter = folded != 32
    letter[1:] |= letter[:-1]
    letter[0] = True
    return np.compress(letter, folded)


def ngrams(letters: np.ndarray) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams but the lone space and those with a space inside."""
    one = letters[letters != 32]
    two = letters[:-1] | letters[1:] << BITS
    inside = letters[1:-1] != 32
    three = (two[:-1] | letters[2:] << (2 * BITS))[inside]
    return np.concatenate([one, two, three])


def counted_ngrams(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the distinct ``ngrams`` in order of their codes, how often each is there, and letters to give to ``codes_of``.

    Several texts' letters may stand in a row. Where texts have few letters beside their length, n-grams are counted in a
    table of their numbers: letters are numbered in order, and an n-gram is written with them as digits.
    """
    top = int(letters.max())
    if top < max(NEAR_LETTERS, len(letters)):
        present = np.flatnonzero(np.bincount(letters))  # the space first: it is at both ends, and letters are behind it
        base = len(present) + 1
        if base**3 <= SPARSE * len(letters):
            small = np.zeros(top + 1, dtype=np.int64)
            small[present] = np.arange(1, base)
            c = small[letters]
            two = c[1:] * base
            two += c[:-1]
            three = c[2:] * base**2
            three += two[:-1]
            counts = np.bincount(three, minlength=base**3).reshape(base, base, base)
            counts[:, 1] = 0
            counts[0] = np.bincount(two, minlength=base**2).reshape(base, base)
            counts[0, 1, 1] = 0  # between two texts
            counts[0, 0, 2:] = counts[0, 2:].sum(axis=1)
            counts = counts.reshape(-1)
            found = np.flatnonzero(counts > 0)
            return found, counts[found], np.append(0, present)
    grams = ngrams(letters)
    if len(letters) > 1:
        grams = grams[grams != 32 | 32 << BITS]
    return *np.unique(grams, return_counts=True), np.zeros(0, dtype=np.int64)


def codes_of(numbers: np.ndarray, present: np.ndarray) -> np.ndarray:
    """Codes of n-grams that ``counted_ngrams`` gave: numbers with the letters in ``present`` as digits, or codes if there are none."""
    if not len(present):
        return numbers
    third, rest = np.divmod(numbers, len(present) ** 2)
    second, first = np.divmod(rest, len(present))
    return present[first] | present[second] << BITS | present[third] << (2 * BITS)


def ranked(codes: np.ndarray, counts: np.ndarray, places: int) -> np.ndarray:
    """The most frequent of codes in order; equal counts in order of code. ``codes`` are in order."""
    if len(counts) > places:
        least = np.partition(counts, len(counts) - places)[len(counts) - places]
        among = np.flatnonzero(counts >= least)
        codes, counts = codes[among], counts[among]
    # Codes stand in order as they are found.
    return codes[np.argsort(-counts, kind="stable")][:places]


@dataclass(frozen=True)
class Profiles:
    """Ranks of n-grams in each language: ``ranks[i, j]`` is that of ``codes[j]`` in ``languages[i]``."""

    languages: tuple[str, ...]
    codes: np.ndarray
    ranks: np.ndarray
    places: int

    @classmethod
    def of(cls, lists: dict[str, list[int]], places: int) -> Profiles:
        languages = tuple(sorted(lists))
        codes = np.array(sorted({c for codes in lists.values() for c in codes}), dtype=np.int64)
        ranks = np.full((len(languages), len(codes)), places, dtype=np.int32)
        for i, language in enumerate(languages):
            ranks[i, np.searchsorted(codes, np.array(lists[language], dtype=np.int64))] = np.arange(len(lists[language]))
        return cls(languages, codes, ranks, places)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and how much nearer than the farthest possible profile it is, 0 to 1."""
        letters = letters_of(text or "")
        if len(letters) < 2 or not len(self.languages):
            return UNKNOWN, 0.0
        numbers, counts, present = counted_ngrams(letters)
        mine = codes_of(ranked(numbers, counts, self.places), present)
        at = np.searchsorted(self.codes, mine)
        at[at == len(self.codes)] = 0
        known = self.codes[at] == mine
        place = np.arange(len(mine))
        # What a language lacks has the rank behind its last.
        distances = np.abs(np.where(known, self.ranks[:, at], self.places) - place).sum(axis=1)
        best = int(np.argmin(distances))
        worst = (self.places - place).sum()
        return self.languages[best], float(1 - distances[best] / worst) if worst else 0.0


def bounded_sample(labelled: DataFrame, label: str, key: list[str], rows: int) -> DataFrame:
    """About ``rows`` rows of each label at most, chosen by a hash of ``key``; labels with fewer are whole.

    Rows that are alike in all columns count once in the sample, so copies of one row can't outgrow the bound.
    """
    counts = {r[0]: r[1] for r in labelled.groupBy(label).count().collect()}
    span = 1 << 20
    drawn = F.xxhash64(*[F.col(c) for c in key])
    chosen = F.lit(False)
    for value, count in sorted(counts.items(), key=lambda item: str(item[0])):
        share = min(span, -(-rows * span // count))
        chosen = chosen | ((F.col(label) == value) & (F.pmod(drawn, F.lit(span)) < share))
    return labelled.filter(chosen).dropDuplicates()


def fit_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", places: int = PLACES) -> Profiles:
    """Profiles of the languages that ``lang_col`` names, from all rows; those with a null text or language teach nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        held: dict[str, list[np.ndarray]] = {}

        def add() -> None:
            for lang, texts in held.items():
                numbers, counts, present = counted_ngrams(np.concatenate(texts))
                codes = codes_of(numbers, present)
                if lang in sums:
                    known, n = sums[lang]
                    codes, at = np.unique(np.concatenate([known, codes]), return_inverse=True)
                    counts, more = np.zeros(len(codes), dtype=np.int64), counts
                    counts[at[: len(n)]] += n
                    counts[at[len(n) :]] += more
                sums[lang] = codes, counts
            held.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (codes, counts) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "gram", "n"])
            sums.clear()

        size = 0
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                mine = letters_of(text.as_py())
                held.setdefault(lang, []).append(mine)
                size += len(mine)
                if 3 * size > GRAMS:
                    add()
                    size = 0
                    if sum(len(codes) for codes, _ in sums.values()) > HELD:
                        yield from flush()
        add()
        yield from flush()

    known = _known(labelled, text_col, lang_col)
    counted = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = counted.cache()
    try:
        best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
        tops: dict[str, list[int]] = {}
        for r in counted.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= places).orderBy("lang", "place").collect():
            tops.setdefault(r.lang, []).append(r.gram)
    finally:
        counted.unpersist()
    return Profiles.of(tops, places)


def _known(labelled: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")


def lowest_score(labelled: DataFrame, profiles: Profiles, text_col: str = "text", lang_col: str = "lang") -> float:
    """Half of the score that all but one in a thousand of the known texts with enough letters reach, to one in STEPS; 0 if there are none."""
    scored = predict_languages(_known(labelled, text_col, lang_col).filter(letters(F.col("text")) >= LETTERS), profiles, score_out="score")
    counted = scored.groupBy(F.floor(F.col("score") * STEPS).alias("step")).agg(F.count("*").alias("n")).collect()
    total, below = sum(r.n for r in counted), 0
    for r in sorted(counted):
        below += r.n
        if 1000 * below >= total:
            return r.step / STEPS / 2
    return 0.0


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}+", ""))


def predict_languages(docs: DataFrame, profiles: Profiles, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score."""
    handle = docs.sparkSession.sparkContext.broadcast(profiles)
    kept = [n for n in docs.columns if n not in (lang_out, score_out)]
    schema = T.StructType([docs.schema[n] for n in kept] + [T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = handle.value
        for batch in batches:
            found = [mine.predict(text.as_py()) for text in batch.column(text_col)]
            columns = [batch.column(n) for n in kept] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, lang_out, score_out])

    return docs.mapInArrow(run, schema)


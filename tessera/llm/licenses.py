"""Licence detection by ordered signature rules.

A text becomes lower-case words with one space between them. One regex finds which keywords it holds; only rules of a
keyword that is there are run, and mark their hits. Every place of a rule is an interval of words. Intervals in order of start (longest,
then strongest first) are swept once with the farthest end seen at each priority: an interval inside one of the same or
a stronger priority is suppressed. The sweep's state is one number per priority and the kept intervals.

Everything is DataFrame functions in one pass over the rows: no shuffle, whole texts, no row leaves its task.

Defined cases: null and empty texts have no words, no places, empty labels and score 0; repeated rows give repeated
results; other columns of the input stay as they are, and result columns take the place of columns of the same name.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.license_rules import BASE_PHRASES, KEYWORDS, RULES, Rule

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PRIORITIES = 4
SPAN = "array<struct<start:int,neg_end:int,priority:int,label:string,confidence:double,base:boolean>>"


def words_of(text: Column) -> Column:
    """Lower-case words of the text with one space between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS, " "))


def count_words(words: Column) -> Column:
    return F.when(words == "", 0).otherwise(_spaces(words) + 1).cast("long")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def keyword_pattern(keywords: tuple[str, ...] = KEYWORDS) -> str:
    """One group with the keyword; alternatives are split by first letter so that most words fail at once."""
    branches = (first + "(?:" + "|".join(word[1:] for word in words) + ")" for first, words in itertools.groupby(sorted(keywords), lambda w: w[0]))
    return " (" + "|".join(branches) + ")(?= )"


#: Marks that are put before and after a hit; words hold neither.
BEGIN, END = "\x01", "\x02"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# These two are long, so they are written as SQL text: one expression instead of thousands of calls.
def _rule_table(rules: tuple[Rule, ...]) -> Column:
    rows = (f"named_struct('label', {_text(r.label)}, 'priority', {r.priority}, 'confidence', {r.confidence}D, 'base', {str(i < len(BASE_PHRASES)).lower()})" for i, r in enumerate(rules))
    return F.expr(f"array({', '.join(rows)})")


def _marked(rules: tuple[Rule, ...], found: str, padded: str) -> Column:
    """(rule, text with marks around its hits) of each rule whose keyword is there; patterns are literals, compiled once a task."""
    by_keyword: dict[str, list[str]] = {}
    for i, rule in enumerate(rules):
        run = f"named_struct('rule', {i}, 'text', regexp_replace({padded}, {_text(rule.regex)}, {_text(BEGIN + '$0' + END)}))"
        by_keyword.setdefault(rule.keyword, []).append(run)
    none = "cast(array() AS array<struct<rule:int,text:string>>)"
    cases = (f"CASE WHEN array_contains({found}, {_text(keyword)}) THEN array({', '.join(runs)}) ELSE {none} END" for keyword, runs in by_keyword.items())
    return F.expr(f"flatten(array({', '.join(cases)}))")


def _places(run: Column, table: Column) -> Column:
    """Word intervals of a rule's hits: the numbers of the words that carry its marks, in one pass over the words."""
    words = F.split(run["text"], " ")
    at = lambda test: F.filter(F.transform(words, lambda w, i: F.when(test(w), i)), lambda i: i.isNotNull())
    rule = F.get(table, run["rule"])
    pairs = F.arrays_zip(at(lambda w: F.endswith(w, F.lit(BEGIN))).alias("start"), at(lambda w: F.contains(w, F.lit(END))).alias("end"))
    return F.transform(
        pairs,
        lambda pair: F.struct(
            pair["start"].alias("start"), (-pair["end"]).alias("neg_end"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["confidence"].alias("confidence"), rule["base"].alias("base")
        ),
    )


def _sweep(places: Column) -> Column:
    """Kept intervals of ``places``, which are in order of start, longest first, strongest first."""
    names = [f"end{p}" for p in range(PRIORITIES)]

    def step(acc: Column, place: Column) -> Column:
        end = -place["neg_end"]
        farthest = F.greatest(*[F.when(place["priority"] >= p, acc[name]).otherwise(-1) for p, name in enumerate(names)])
        ends = [F.when((place["priority"] == p) & (end > acc[name]), end).otherwise(acc[name]).alias(name) for p, name in enumerate(names)]
        return F.struct(*ends, F.when(farthest >= end, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(place))).alias("kept"))

    zero = F.struct(*[F.lit(-1).alias(name) for name in names], F.array().cast(SPAN).alias("kept"))
    return F.aggregate(places, zero, step, lambda acc: acc["kept"])


def scan_licenses(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with n_words, places (all, of every rule) and spans (what suppression keeps).

    Both are arrays of (start, neg_end, priority, label, confidence, base); words count from 0 and -neg_end is the
    word after the last.
    """
    padded = F.concat(F.lit(" "), F.col("__words"), F.lit(" "))
    keywords = tuple(sorted({rule.keyword for rule in rules}))
    found = F.array_distinct(F.regexp_extract_all(F.col("__padded"), F.lit(keyword_pattern(keywords)), 1))
    runs = F.filter(_marked(rules, "__found", "__padded"), lambda run: F.contains(run["text"], F.lit(BEGIN)))
    places = F.array_sort(F.flatten(F.transform(F.col("__runs"), lambda run: _places(run, _rule_table(rules)))))
    nothing = F.array().cast(SPAN)
    return (
        docs.withColumn("__words", words_of(F.col(f"`{text_col}`")))
        .withColumn("n_words", count_words(F.col("__words")))
        .withColumn("__padded", padded)
        .withColumn("__found", found)
        .withColumn("__runs", F.when(F.size("__found") > 0, runs))
        .withColumn("places", F.when(F.col("__runs").isNotNull(), places).otherwise(nothing))
        .withColumn("spans", F.when(F.size("places") > 0, _sweep(F.col("places"))).otherwise(nothing))
        .drop("__words", "__padded", "__found", "__runs")
    )


def license_columns(scanned: DataFrame) -> DataFrame:
    """Add n_base, first_word, last_word, base_labels, labels and score to what ``scan_licenses`` returned."""
    base = F.filter("places", lambda place: place["base"])
    starts = F.transform(F.col("__base"), lambda place: place["start"].cast("long"))
    named = lambda spans: F.transform(spans, lambda span: span["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    strongest = F.array_max(F.transform(F.col("spans"), lambda span: span["confidence"]))
    return (
        scanned.withColumn("__base", base)
        .withColumn("n_base", F.size("__base").cast("long"))
        .withColumn("first_word", F.array_min(starts))
        .withColumn("last_word", F.array_max(starts))
        .withColumn("base_labels", joined(named(F.col("__base"))))
        .withColumn("labels", joined(F.concat(named(F.col("__base")), named(F.col("spans")))))
        .withColumn("score", F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(strongest, F.lit(0.0))))
        .drop("__base")
    )

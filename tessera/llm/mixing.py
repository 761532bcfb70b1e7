"""Mixing sources to target weights by hash-random order, range sort and distributed prefix sums.

Every document gets a hash-random key. Within a source, documents stand in the order of their keys; the key space is
cut into fixed ranges, so that the running token count of a document is the count of the ranges before its own (a sum
over one row per range) plus a running sum inside the range, and no task sees more than one range of a source. A
source's budget is met by whole epochs, and by the documents before the cut in one epoch more; at the cut itself a
document gives the words that are missing.

Everything is DataFrame functions. Only ids, sources, sizes and keys are shuffled, never texts.

Defined cases: a null text has size 0 and takes 0; a null source is a source of its own, last in order; a null id is
an id like any other; identical rows are counted one after another; an empty table gives an empty result; columns
besides the named ones don't matter here, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.shared import fresh, materialize, quoted

#: Hex digits of a key that name its range: 16 ** 3 ranges in a source.
RANGE_DIGITS = 3
SEED = "mix-1"
#: Up to so many sources (one small row each) the cuts go to every task; beyond, Spark joins them by source.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def random_key(doc_id: Column, source: Column, text: Column, seed: str = SEED) -> Column:
    """128 hash bits as hex text, the same in every run; identical rows get the same key."""
    parts = [F.coalesce(part.cast("string"), F.lit("\u0000")) for part in (doc_id, source, text)]
    return F.md5(F.concat_ws("|", F.lit(seed), *parts).cast("binary"))


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Add ``target`` to a table of (source, source_size), one row per source.

    Sources in code point order (null last) weigh ``weights`` in turn and share the sum of all sizes; a target above
    ``max_epochs`` times its source's size stops there and the excess is shared again by weight. With sources in order
    of cap over weight, the first k are capped for the smallest k whose level (what is left over the weight that is
    left) reaches no further cap: that level is the largest over all k, so one running sum finds it.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("weight", F.element_at(turn, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    capped = ranked.withColumn("cap", (F.col("source_size") * max_epochs).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    level = (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))
    )
    return (
        capped.withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))
    )


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    seed: str = SEED,
) -> DataFrame:
    """One row per row of ``docs``: id, source, key, size, source_size, target, epochs (whole ones), taken (words).

    The words taken of a source sum to its target rounded to a whole number.
    """
    slim = materialize(
        docs.select(
            F.col(quoted(id_col)).alias("doc_id"),
            F.col(quoted(source_col)).alias("source"),
            word_count(F.col(quoted(text_col))).alias("size"),
            random_key(F.col(quoted(id_col)), F.col(quoted(source_col)), F.col(quoted(text_col)), seed).alias("key"),
        )
    )
    # Identical rows share a key: they travel as one row with a count, so that no range is hot because of them.
    keyed = slim.groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("rows")).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    ranges = keyed.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("rows")).alias("range_size"))
    targets = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranges.withColumn("offset", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
        .join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .select(F.col("source").alias("in_source"), F.col("range").alias("in_range"), "offset", "source_size", "target")
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(offsets, F.col("source").eqNullSafe(F.col("in_source")) & (F.col("range") == F.col("in_range"))).withColumn(
        "before", F.col("offset") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(inside), F.lit(0))
    )
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - F.col("epochs") * F.col("source_size")
    return (
        placed.withColumn("epochs", epochs.cast("long"))
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
        .withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before") - F.col("copy") * F.col("size"))))
        .select("doc_id", "source", "key", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + F.col("extra")).cast("long").alias("taken"))
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, all columns kept.

    Documents stay whole: the one at a source's cut comes once more if at least half of its words are within the
    budget. The cut of each source (one row per source) goes to the documents, so no text is sorted; documents without
    words come as often as their source has whole epochs. Identical rows at a cut share its decision.
    """
    planned = mix_plan(docs, id_col, text_col, source_col, seed=seed, **options)
    extra = F.col("taken") - F.col("epochs") * F.col("size")
    epochs, cut, of, key, times, copy = fresh(docs, "__epochs", "__cut", "__source", "__key", "__times", "__copy")
    cuts = planned.groupBy("source").agg(
        F.max("epochs").alias(epochs),
        F.coalesce(F.max(F.when((extra * 2 >= F.col("size")) & (extra > 0), F.col("key"))), F.lit("")).alias(cut),
    )
    keyed = random_key(F.col(quoted(id_col)), F.col(quoted(source_col)), F.col(quoted(text_col)), seed)
    names = docs.columns
    cuts = materialize(cuts.withColumnRenamed("source", of))
    if cuts.count() <= BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    matched = docs.withColumn(key, keyed).join(cuts, F.col(quoted(source_col)).eqNullSafe(F.col(of)), "inner")
    number = F.col(epochs) + F.when(F.col(key) <= F.col(cut), 1).otherwise(0)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))
    return matched.withColumn(times, number).filter(F.col(times) > 0).withColumn(copy, copies).select(*[F.col(quoted(n)) for n in names])

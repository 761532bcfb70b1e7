"""Fill-in-middle transformation by lookaround splitting.

A text is a sequence of units of one grammar. Each grammar is stated as a zero-width regex that holds at the boundaries
between its units, told from the classes of the two neighbouring characters: Spark's ``split`` at such a regex keeps
every character, so the pieces joined again are the text. An empty text has no units and is handled by itself, as
``split`` would give one empty piece.

Two cuts from a hash of seed and id part the units into prefix, middle and suffix, written in PSM order
(``<P>prefix<S>suffix<M>middle``) or SPM order (``<S>suffix<P>prefix<M>middle``). Everything is expressions of one row: no
shuffle, and the scan reads two columns.

Defined cases: a null text counts as empty and gives form ``plain`` with an empty output; so does every text that holds
one of the marks (it stays as it is); a null id hashes as an empty one; equal ids get equal cuts where their texts have
as many units; identical rows stay apart; an empty table gives an empty result; columns besides id and text don't
matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: The boundary regex of each unit grammar; beside it the grammar, matched from left to right.
BOUNDARIES = {
    "lines": r"(?<=\n)(?=[\s\S])",  # [^\n]*\n|[^\n]+
    "words": r"(?<=[ \t\n\x0B\f\r])(?=[^ \t\n\x0B\f\r])|(?<=[^ \t\n\x0B\f\r])(?=[ \t\n\x0B\f\r])",  # runs of white space, and of other characters
    "paragraphs": r"(?<=\n\n)(?=[^\n])",  # each with the blank lines after it
    "characters": r"(?<=[\s\S])(?=[\s\S])(?!\p{Cs})",  # code points: never between the halves of one
}


def units(text: Column, unit: str = "lines") -> Column:
    """The text's units in order; none for an empty or null text."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(text, BOUNDARIES[unit], -1))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made from."""
    p, s, m = (F.locate(mark, output) for mark in (PREFIX, SUFFIX, MIDDLE))
    between = lambda start, end: F.substring(output, start + 3, end - start - 3)
    middle = F.substring(output, m + 3, F.length(output))
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "lines", seed: str = "7", percent: int = 100, percent_spm: int = 50
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (units), form, prefix_chars and middle_chars (null if plain), output.

    ``percent`` of the texts are transformed, ``percent_spm`` of those in SPM order.
    """
    name = lambda column: F.col("`" + column.replace("`", "``") + "`")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(name(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    text = F.coalesce(name(text_col), F.lit(""))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    part = lambda start, count: F.array_join(F.slice("units", start + 1, count), "")
    n = F.col("n")
    return (
        docs.select(name(id_col).alias("doc_id"), text.alias("text"), digest.alias("digest"))
        .select("doc_id", "text", F.array(*draws).alias("draws"), units(F.col("text"), unit).alias("units"))
        .withColumn("n", F.size("units").cast("long"))
        .withColumn("cuts", F.array_sort(F.array(F.col("draws")[0] % (n + 1), F.col("draws")[1] % (n + 1))))
        .withColumn("lo", F.col("cuts")[0].cast("int"))
        .withColumn("hi", F.col("cuts")[1].cast("int"))
        .withColumn("plain", (n == 0) | marked | (F.col("draws")[2] % 100 >= percent))
        .withColumn("form", F.when(F.col("plain"), "plain").when(F.col("draws")[3] % 100 < percent_spm, "spm").otherwise("psm"))
        .withColumn("prefix", part(F.lit(0), F.col("lo")))
        .withColumn("middle", part(F.col("lo"), F.col("hi") - F.col("lo")))
        .withColumn("suffix", part(F.col("hi"), F.size("units")))
        .select(
            "doc_id",
            "n",
            "form",
            F.when(~F.col("plain"), F.length("prefix").cast("long")).alias("prefix_chars"),
            F.when(~F.col("plain"), F.length("middle").cast("long")).alias("middle_chars"),
            F.when(F.col("plain"), F.col("text"))
            .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
            .otherwise(F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
            .alias("output"),
        )
    )

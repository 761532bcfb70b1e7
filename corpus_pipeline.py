"""The corpus pipeline: language, toxicity, near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a table; all but the last
return the columns of documents. Models are fitted on what a stage gets, and on the table ``labels``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import encode_documents
from tessera.llm.langid import LETTERS, UNKNOWN, fit_profiles, letters, lowest_score, predict_languages
from tessera.llm.mixing import mix_documents
from tessera.llm.neardup import MinHash, drop_near_duplicates
from tessera.llm.shared import id_remainder, materialize
from tessera.llm.toxicity import fit_toxicity, score_toxicity

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Five words a shingle, similarity 0.8 or more.
NEAR = MinHash(width=5, percent=80)


def _learning(frame: DataFrame) -> DataFrame:
    return frame.filter(id_remainder(F.col("doc_id")) != 1)


def _settle(spark: SparkSession) -> None:
    """Documents are long: small Arrow batches keep what tasks hold at a time low."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the profiles know.

    Those without text or without a letter go, and so do those with enough letters to tell whose score is far below
    what known texts reach. Where there was nothing to learn from, every document with a letter stays.
    """
    _settle(spark)
    learning = _learning(docs)
    profiles = fit_profiles(learning)
    if not profiles.languages:
        return docs.filter(letters(F.col("text")) > 0)
    found = predict_languages(docs, profiles, lang_out="__lang", score_out="__score")
    near = (F.col("__score") >= lowest_score(learning, profiles)) | (letters(F.col("text")) < LETTERS)
    return found.filter((F.col("__lang") != UNKNOWN) & near).select(docs.columns)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict as toxic."""
    _settle(spark)
    learning = _learning(docs)
    profiles = fit_profiles(learning)
    labels = _learning(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, fit_toxicity(learning, labels, profiles), profiles, score_out="__score", predicted_out="__toxic")
    return scored.filter("__toxic = 0").select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id."""
    _settle(spark)
    return drop_near_duplicates(docs, NEAR)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for."""
    return mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, for every row that the mix gave."""
    _settle(spark)
    encoded = encode_documents(docs.select("doc_id", "source", "text"), TOKENIZER, with_ids=False)
    return encoded.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language id", keep_known_languages),
    ("toxicity", keep_clean),
    ("near duplicates", drop_copies),
    ("mix sources", mix),
    ("bpe encode", encode),
]

#: SQL can't state these stages; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result but the last's is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs

"""The registered query of BPE encoding; SQL can't state it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.bpe import encode_documents
from tessera.llm.shared import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op3_bpe_encode(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, tokenizer, with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")

import hashlib
from array import array

from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tests.llm.test_neardup import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for i, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        after = pipeline.materialize(stage(spark, before, sf_dir))
        assert after.columns == docs.columns
        rows, kept = before.collect(), after.collect()
        assert 0 < len(kept)
        assert {r.doc_id for r in kept} <= {r.doc_id for r in rows}
        if i == 0:
            assert len(kept) == sum(any(c.isalpha() for c in r.text or "") for r in rows)
        if i == 1:
            toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 0").collect()}
            clean = [r for r in rows if r.doc_id in toxic]
            assert sum(r.doc_id in {k.doc_id for k in kept} for r in clean) >= 0.95 * len(clean)
        if i == 2:
            want = {i for i, _, c in brute([(r.doc_id, r.text) for r in rows], 5, 80) if i == c}
            assert {r.doc_id for r in kept} == want
        before = after
    texts = [r.text for r in before.collect()]
    reference = Tokenizer.from_file(pipeline.TOKENIZER)
    want = sorted(hashlib.sha256(array("I", reference.encode(t, add_special_tokens=False).ids).tobytes()).hexdigest() for t in texts)
    assert sorted(r.ids_sha256 for r in pipeline.encode(spark, before, sf_dir).collect()) == want


def test_stages_without_rows_or_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.limit(0).union(spark.createDataFrame([(None, "some words of a text", None, None, None), (None, None, None, "a", 1)], docs.schema))
    for frame, stays in ((docs.limit(0), 0), (odd, 1)):
        for name, stage in pipeline.STAGES[:-1]:
            frame = pipeline.materialize(stage(spark, frame, sf_dir))
            assert frame.count() == stays and frame.columns == docs.columns, name
        assert pipeline.encode(spark, frame, sf_dir).count() == stays

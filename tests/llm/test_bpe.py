import hashlib
import random
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.bpe import TextCodec, Vocabulary, encode_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def mine():
    return TextCodec(Vocabulary.load(PATH))


def same(mine, reference, texts):
    want = [reference.encode(t or "", add_special_tokens=False).ids for t in texts]
    got = list(mine.encode_all(texts))
    assert got == [array("I", ids).tobytes() for ids in want]
    assert [mine.decode(ids) for ids in got] == [reference.decode(ids, skip_special_tokens=False) for ids in want]


def test_odd_texts(mine, reference):
    letters = "abcxyz ABC'sstΣσİḰé\n\t.!12٣中文ﬁ🙂​́가\x1c\x85\xa0|<>ñ"
    rng = random.Random(1)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    same(mine, reference, [None, "", " ", "a<|endoftext|>b <|startoftext|>", "x" * 3000, "don't we'll I'M", *texts])


def test_joined_tokens(mine, reference):
    tokens = [t.removesuffix("</w>") for t in Vocabulary.load(PATH).ids]
    rng = random.Random(2)
    words = ["".join(rng.choice(tokens) for _ in range(rng.randint(1, 4))) for _ in range(20_000)]
    same(mine, reference, [" ".join(words[i : i + 40]) for i in range(0, len(words), 40)])


def test_kept_pieces_are_bounded(reference):
    small = TextCodec(Vocabulary.load(PATH), kept=50)
    same(small, reference, [f"word{i} thing{i * 7}" for i in range(300)])
    assert len(small.pieces) <= 700


def test_table(spark, sf_dir, reference):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for row in encode_documents(docs, PATH, with_text=True).collect():
        ids = reference.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        text = reference.decode(ids, skip_special_tokens=False)
        assert row.decoded == text and row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_nulls_clashes_and_empty(spark):
    docs = spark.createDataFrame([(None, None, "x"), (1, "", "y"), (1, "one two", "z"), (1, "one two", "z")], "doc_id long, text string, n_tokens string")
    got = encode_documents(docs, PATH).collect()
    assert [r.n_tokens for r in got] == [0, 0, 2, 2]
    assert encode_documents(docs.limit(0), PATH).count() == 0


def test_memory_stays_bounded(reference, monkeypatch):
    import tessera.llm.bpe as bpe

    monkeypatch.setattr(bpe, "CHUNK", 2000)
    small = TextCodec(Vocabulary.load(PATH), kept=100)
    texts = [f"word{i} thing{i * 7} " + "x" * (i % 90) for i in range(3000)]
    most = 0
    for i, ids in enumerate(small.encode_all(texts)):
        most = max(most, len(small.pieces) + len(small.known))
        assert list(array("I", ids)) == reference.encode(texts[i], add_special_tokens=False).ids
    assert most < 1500 and not any(len(p) > bpe.LONGEST for p in {**small.pieces.young, **small.pieces.old, **small.known.young})
    small.forget()
    assert not len(small.pieces) and not len(small.known) and not small.seams_known

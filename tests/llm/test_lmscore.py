import math
import sys
import zlib

import numpy as np
import pyarrow as pa

from tessera.llm import lmscore as lm
from tessera.llm.lmscore import fit_model, score_documents, tokens_of
from tessera.llm.lmscore_query import op5_lm_score


def brute(model, text):
    numbers = [int(n) for n in model.numbers(tokens_of(text))]
    total = 0.0
    for i, token in enumerate(numbers):
        z = model.hidden.astype(float)
        for k, j in enumerate([i - 2, i - 1, i + 1, i + 2]):
            z = z + model.context[k][numbers[j] + 1 if 0 <= j < len(numbers) else 0]
        h = np.tanh(z)
        group = h @ model.classes + model.class_bias
        member = h @ model.members[token // lm.SIDE] + model.member_bias[token // lm.SIDE]
        pick = lambda s, j: s[j] - math.log(sum(math.exp(x) for x in s))
        total += pick(group, token // lm.SIDE) + pick(member, token % lm.SIDE) + model.inside[token]
    return len(numbers), total


def corpus(spark):
    rows = [(i, f"the cat number{i % 7} sat on the mat and the dog ran") for i in range(80)] + [(90, None), (91, ""), (None, "dog the cat"), (1, "the cat")]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")


def test_against_brute_force(spark):
    docs = corpus(spark)
    model = fit_model(docs)
    probes = spark.createDataFrame([("the cat sat on the mat",), ("mat the on sat cat the",), ("quite unknown words",), (None,), ("one",)], "text string")
    got = score_documents(probes, model).collect()
    for r in got:
        n, total = brute(model, r.text)
        assert r.n_tokens == n and abs(r.log_likelihood - total) < 1e-3 * max(1, n)
    assert got[0].log_likelihood > got[1].log_likelihood > got[2].log_likelihood - 50


def test_probabilities_sum_to_one(spark):
    model = fit_model(corpus(spark))
    around = model.numbers(["the", "cat", "sat", "on", "the"])
    total = 0.0
    for token in range(lm.SIDE * lm.SIDE):
        around[2] = token
        total += math.exp(model.log_probabilities(around)[2] - model.inside[token])
    assert abs(total - 1) < 1e-4


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    model = lm.fresh(["a", "b"], rng.integers(0, 9, lm.SIDE**2), np.zeros(lm.SIDE**2))
    row = np.concatenate([[0, 0], rng.integers(1, 1025, 12), [0, 0]])
    at = np.flatnonzero(row)

    def loss():
        return -model.log_probabilities(row[at] - 1).mean()

    grads = lm.gradients(model, row, at)
    for name in ("hidden", "classes", "members", "context", "member_bias"):
        param = getattr(model, name)
        where = np.unravel_index(np.argmax(np.abs(grads[name])), param.shape)
        old = param[where].copy()
        param[where] = old + 1e-2
        up = loss()
        param[where] = old - 1e-2
        down = loss()
        param[where] = old
        assert abs((up - down) / 2e-2 - grads[name][where]) < 0.05 * abs(grads[name][where]) + 1e-4, name


def test_counts_cover_all_documents(spark):
    docs = corpus(spark)
    model = fit_model(docs, rows=1)
    assert set(model.number) >= {"the", "cat", "number6", "dog"}
    fresh = lm.fresh(["a"], np.arange(lm.SIDE**2), np.zeros(lm.SIDE**2))
    assert np.allclose(np.exp(fresh.class_bias).sum(), 1, atol=1e-5) and np.allclose(np.exp(fresh.member_bias).sum(axis=1), 1, atol=1e-4)


def test_empty_and_table(spark, sf_dir):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fit_model(empty) is None and score_documents(empty, None).count() == 0
    rows = op5_lm_score(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.log_likelihood < 0 for r in rows if r.n_tokens)


def test_every_token_trains_and_rare_words_have_their_counts(spark, monkeypatch):
    common = " ".join(f"w{i}" for i in range(lm.VOCABULARY))
    rows = [(i, common) for i in range(30)] + [(100 + i, "seldom " * (1 + 19 * (i < 1)) + f"once{i} pairleft pairright") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = []
    monkeypatch.setattr(lm, "train_on_all", lambda model, texts, f=lm.train_on_all: seen.append(f(model, texts)))
    model = fit_model(docs, rows=1)
    assert seen == [sum(len(tokens_of(t)) for _, t in rows)]
    counts = {r.word: r.n for r in model.rest.collect()}
    assert counts["seldom"] == 22 and counts["once0"] == 1 and not set(counts) & set(model.number)
    got = {r.doc_id: r for r in score_documents(docs, model).collect()}
    for i, text in rows[-3:]:
        n, total = brute(model, text)
        exact = total + sum(math.log(counts[w] + 1) for w in tokens_of(text) if w in counts)
        assert got[i].n_tokens == n and abs(got[i].log_likelihood - exact) < 1e-3 * n
    shares = [0.0] * lm.OTHER
    for word, n in counts.items():
        shares[model.numbers([word])[0] - lm.VOCABULARY] += n + 1
    for bucket, share in enumerate(shares):
        assert abs((share + 1) * math.exp(model.inside[lm.VOCABULARY + bucket]) - 1) < 1e-9


def test_counts_by_join_and_in_tasks_agree(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_model(docs, rows=20)
    assert model.own and model.least == 1
    inside = {r.doc_id: r.log_likelihood for r in score_documents(docs, model, keep=["doc_id"]).collect()}
    monkeypatch.setattr(lm, "COMMON", 1000)
    model.least, model.own = lm._common(model.rest)
    assert 0 < len(model.own) <= 1000 and model.least > 1
    joined = {r.doc_id: r.log_likelihood for r in score_documents(docs, model, keep=["doc_id"]).collect()}
    assert all(abs(inside[i] - joined[i]) < 1e-6 * max(1, abs(inside[i])) for i in inside) and inside.keys() == joined.keys()


def test_context_gradients_of_repeated_neighbours():
    """Each token's row gets the sum over all places that it stands beside, however often."""
    rng = np.random.default_rng(4)
    model = lm.fresh([str(i) for i in range(960)], rng.integers(1, 99, 1024).astype(float), np.zeros(1024))
    row = lm._row_of([np.array([3, 3, 3, 900, 3, 1023]), np.zeros(0, dtype=np.int64), np.array([3])])
    at = np.flatnonzero(row)
    whole = lm.gradients(model, row, at)["context"]
    parts = sum(lm.gradients(model, row, at[i : i + 1])["context"] for i in range(len(at))) / len(at)
    assert whole.dtype == np.float32 and np.allclose(whole, parts, atol=1e-6) and not whole[:, 0].any()


def test_words_of_many_texts_at_once():
    odd = [" a  b\t\n", "", " ", "x\x1cy\x85z\xa0\u2003w", "\x0b\x0cA\rB\x00", "İSTANBUL ΣΑΣ", "one", "\u3000", "e\u0301 " * 3 + "z" * 500]
    batches = [pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["t"]) for some in ([None, *odd], [], odd)]
    for chars in (1, 10, 1 << 20):
        texts = [t for some in lm.lowered(iter(batches), "t", chars) for t in some]
        words, sizes = lm.words_in(texts)
        ends = np.cumsum(sizes)
        assert [words[int(e - n) : int(e)].to_pylist() for e, n in zip(ends, sizes)] == [tokens_of(t) for t in [None, *odd, *odd]]


def test_rare_words_find_their_buckets_without_a_call_for_each():
    words = [f"{'w' * (i % 40)}é{i}" for i in range(20_000)] + ["", "\x00", "a", "z" * 31, "z" * 32, "z" * 33, "日本語" * 30]
    model = lm.fresh(["a", "b"], np.ones(lm.SIDE**2), np.zeros(lm.SIDE**2))
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event == "call" else None)
    try:
        got = model.numbers(words)
    finally:
        sys.setprofile(None)
    assert got.tolist() == [0 if w == "a" else model.vocabulary + zlib.crc32(w.encode()) % lm.OTHER for w in words]
    assert len(calls) < 1000
    some = pa.array(["skipped", *words], pa.large_string())[1:]
    assert lm.crc32s(some).tolist() == [zlib.crc32(w.encode()) for w in words] and lm.crc32s(some[:0]).tolist() == []


def test_parts_and_pieces_change_nothing(monkeypatch):
    rng = np.random.default_rng(8)
    model = lm.fresh([str(i) for i in range(960)], rng.integers(1, 99, 1024).astype(float), rng.normal(size=1024))
    row = lm._row_of([rng.integers(0, 1024, n) for n in (300, 0, 1, 400)] + [np.full(200, 1000)])
    at = rng.permutation(np.flatnonzero(row))
    scores, grads = model.at_places(row, at), lm.gradients(model, row, at)
    monkeypatch.setattr(lm, "PART", 7)
    monkeypatch.setattr(lm, "PIECE", 50)
    assert np.allclose(model.at_places(row, at), scores, atol=1e-5)
    again = lm.gradients(model, row, at)
    assert all(np.allclose(again[n], grads[n], atol=1e-6) and again[n].shape == getattr(model, n).shape for n in lm.PARAMS)
    model.members *= 1e4  # logits too large for exp
    assert np.isfinite(model.at_places(row, at)).all() and all(np.isfinite(g).all() for g in lm.gradients(model, row, at).values())

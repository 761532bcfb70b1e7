import numpy as np

from tessera.llm import toxicity as tox
from tessera.llm.langid import Profiles
from tessera.llm.toxicity import Network, Words, fit_toxicity, score_toxicity, shortened, words_of
from tessera.llm.toxicity_query import op8_toxicity

NOBODY = Profiles.of({}, 5)


def brute(net, text):
    words = words_of(text) or [None]
    vectors = [net.embedding[tox.buckets_of(w)].sum(axis=0) if w else np.zeros(tox.DEPTH) for w in words] + [np.zeros(tox.DEPTH)] * 2
    z = float(net.intercept[0])
    for i, width in enumerate(tox.WIDTHS):
        for f in range(tox.FILTERS):
            values = [max(0.0, net.biases[width][f] + sum(vectors[p + k] @ net.filters[width][k][:, f] for k in range(width))) for p in range(len(words))]
            z += sum(v * net.weights[i][k][f] for k, v in enumerate(sorted(values, reverse=True)[: tox.POOL]))
    return z


def test_forward_against_brute_force():
    net = Network.fresh(3)
    texts = ["one", "", None, "one two three four five six seven", "a b", "x " * 50 + "yes"]
    words = Words()
    numbers = [words.numbers(words_of(t)) for t in texts]
    got = net.logits(numbers, np.array(words.rows))
    assert np.allclose(got, [brute(net, t) for t in texts], atol=1e-4)


def test_gradients_against_differences():
    net = Network.fresh(3)
    words = Words()
    numbers = [words.numbers(words_of(t)) for t in ("you scum here", "a fine day it was", "x")]
    table, y = np.array(words.rows), np.array([1, 0, 0], dtype=np.float32)

    def loss():
        z = net.logits(numbers, table)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    grads = tox._gradients(net, numbers, table, y)
    whole = np.zeros_like(net.embedding)
    whole[grads["rows"]] = grads["embedding"]
    grads["embedding"] = whole
    for name, param in {"filter2": net.filters[2], "weights": net.weights, "embedding": net.embedding, "bias1": net.biases[1]}.items():
        at = np.unravel_index(np.argmax(np.abs(grads[name])), param.shape)
        old = param[at].copy()
        param[at] = old + 1e-2
        up = loss()
        param[at] = old - 1e-2
        down = loss()
        param[at] = old
        assert abs((up - down) / 2e-2 - grads[name][at]) < 0.05 * abs(grads[name][at]) + 1e-3, name


def test_learns_and_scores(spark):
    rows = [(i, f"word{i % 17} that is {'scum' if i % 4 == 0 else 'fine'} here", int(i % 4 == 0)) for i in range(160)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(901, None), (None, 1)], "doc_id long, toxic int")
    net = fit_toxicity(docs, labels, NOBODY)
    got = {r.text: r for r in score_toxicity(docs.withColumnRenamed("doc_id", "predicted"), net, NOBODY).collect()}
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    assert all(r.predicted == ("scum" in (t or "")) for t, r in got.items())


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    net = fit_toxicity(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), NOBODY)
    assert [r.score for r in score_toxicity(docs, net, NOBODY).collect()] == [0.0, 0.0]
    assert score_toxicity(docs.limit(0), net, NOBODY).count() == 0


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in op8_toxicity(spark, sf).collect() if r.held_out and toxic.get(r.doc_id) is not None]
    clean = [r for r in held if not toxic[r.doc_id]]
    assert sum(r.predicted for r in clean) <= 0.1 * len(clean)
    assert sum(r.predicted == toxic[r.doc_id] for r in held) >= 0.9 * len(held)


def test_shortened_texts_give_the_same():
    net, rng = Network.fresh(3), np.random.default_rng(1)
    kept = rng.random(tox.BUCKETS) < 0.02
    net.embedding[~kept] = 0
    for size, every in ((0, 9), (1, 9), (7, 30), (60, 25), (400, 60), (400, 10_000)):
        text = " ".join(f"{'n' if i % every else 'y'}{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(size))
        words, telling = Words(), Words(kept)
        whole, short = words.numbers(words_of(text)), shortened(telling.numbers(words_of(text)))
        assert np.allclose(net.logits([whole], np.array(words.rows)), net.logits([short], np.array(telling.rows)), atol=1e-5)
        assert len(short) <= len(whole)


def test_every_labelled_row_teaches(spark, monkeypatch):
    """Words that stand in few of very many rows are learned, by several groups as well."""
    monkeypatch.setattr(tox, "GROUP", 3_000)
    rows = [(i, f"plain word{i % 50} here " + (f"scum{i % 3}" if i % 3 == 0 else "well"), int(i % 3 == 0)) for i in range(12_000)]
    rows += [(20_000 + i, f"plain word{i} here seldom", 1) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(20_000, 0)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(tox, "train", lambda texts, n, told, f=tox.train: seen.append((texts.count(), n, told)) or f(texts, n, told))
    monkeypatch.setattr(tox, "_set_thresholds", lambda net, held, least, f=tox._set_thresholds: seen.append(held.count()) or f(net, held, least))
    net = fit_toxicity(docs, labels, NOBODY)
    assert seen[0][0] == seen[0][1] and seen[0][0] + seen[1] == len(rows) and seen[1] > len(rows) / 5
    assert net.embedding[tox.buckets_of("seldom")[0]].any() and not net.embedding[tox.buckets_of("plain")[0]].any()
    probes = spark.createDataFrame([("a scum1 here", 1), ("plain word3 here well", 0), ("plain seldom here", 1), ("", 0)], "text string, want int")
    assert all(r.predicted == r.want for r in score_toxicity(probes, net, NOBODY).collect())


def test_rows_of_words_found_together():
    """Rows of all words at once are those that each word has by itself."""
    long = "a" * 63 + " " + "b" * 64 + " " + "c" * 65 + " " + "é" * 200
    texts = ["one, two; THREE fourteen", "", None, "ÄÖÜ_x1y ß ﬀ", "İstanbul ΟΔΟΣ", "日本語 テキスト 𝔘𝔫𝔦 x²½", long, "end"]
    rows, bounds = tox.word_rows(texts)
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert rows[a:b].tolist() == [tox.buckets_of(w) for w in words_of(text)], text
    assert len(rows) == bounds[-1] and tox.word_rows([])[0].shape == (0, 3)


def test_texts_are_dealt_out_once(spark, monkeypatch):
    """Rounds read groups that are laid out once: training rounds shuffle no texts."""
    plans = []
    monkeypatch.setattr(tox, "summed", lambda parts, f=tox.summed: plans.append(parts._jdf.queryExecution().executedPlan().toString()) or f(parts))
    rows = [(i, f"word{i % 17} that is {'scum' if i % 4 == 0 else 'fine'} here", int(i % 4 == 0)) for i in range(160)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    fit_toxicity(docs, labels, NOBODY)
    assert len(plans) == tox.ROUNDS and not any("Exchange" in p for p in plans)

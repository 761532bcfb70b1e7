from collections import Counter

from tessera.llm.langid import PLACES, UNKNOWN, Profiles, bounded_sample, fit_profiles, lowest_score, predict_languages
from tessera.llm.langid_query import op6_language_id


def grams(text):
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "").split()
    padded = " " + " ".join(words) + " " if words else " "
    out = Counter(c for c in padded if c != " ")
    out.update(padded[i : i + 2] for i in range(len(padded) - 1))
    out.update(padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " ")
    return out if words else Counter()


def code(gram):
    return sum(ord(c) << (21 * i) for i, c in enumerate(gram))


def profile(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda item: (-item[1], code(item[0])))][:PLACES]


def brute(text, lists):
    mine = profile(grams(text))
    if not mine:
        return UNKNOWN, 0.0
    best = min((sum(abs(places.index(g) - i) if g in places else PLACES - i for i, g in enumerate(mine)), lang) for lang, places in lists.items())
    return best[1], 1 - best[0] / sum(PLACES - i for i in range(len(mine)))


TEXTS = [(1, "The cat and the dog are in the house", "en"), (2, "Der Hund und die Katze sind im Haus", "de"), (3, "le chat et le chien sont dans la maison", "fr"), (4, None, "en"), (5, "x", None)]


def test_against_brute_force(spark):
    docs = spark.createDataFrame(TEXTS * 3, "doc_id long, text string, lang string")
    profiles = fit_profiles(docs)
    lists = {lang: profile(sum((grams(t) for _, t, g in TEXTS * 3 if g == lang), Counter())) for lang in ("en", "de", "fr")}
    probes = ["the house", "die Katze", "chien!", "", None, "123 ...", "Ünïcode ÇA", "the the the " * 500, "İ 中文"]
    got = predict_languages(spark.createDataFrame([(t, 1) for t in probes], "text string, score int"), profiles).collect()
    for row, text in zip(got, probes):
        lang, score = brute(text, lists)
        assert row.lang_pred == lang and abs(row.score - score) < 1e-9, text


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    profiles = fit_profiles(empty)
    assert profiles.languages == () and predict_languages(empty, profiles).count() == 0
    assert Profiles.of({}, 5).predict("abc") == (UNKNOWN, 0.0)


def test_held_out_accuracy(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = [r for r in op6_language_id(spark, sf_dir).collect()]
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.9


def test_rows_without_id_do_not_outgrow_the_sample(spark):
    rows = [(None, f"plain words number {i} stand here", "en") for i in range(10_000)] + [(None, "the same row", "en")] * 5_000
    frame = spark.createDataFrame(rows, "id long, text string, lang string")
    assert 20 <= bounded_sample(frame, "lang", ["id", "text"], 100).count() <= 200
    assert bounded_sample(frame.limit(0), "lang", ["id", "text"], 100).count() == 0


def test_lowest_score(spark):
    rows = [(i, "the cat sat on the mat with a dog and the rat", "en") for i in range(50)] + [(99, "short", "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = fit_profiles(frame)
    assert 0 < lowest_score(frame, profiles) < 0.5 < profiles.predict(rows[0][1])[1]
    assert lowest_score(frame.limit(0), profiles) == 0


def test_every_known_row_counts(spark, monkeypatch):
    """More rows than any sample of 2,000 a language: profiles and the lowest score are those of all of them."""
    monkeypatch.setattr("tessera.llm.langid.GRAMS", 5_000)
    monkeypatch.setattr("tessera.llm.langid.HELD", 500)
    rows = [(i, f"{'abcdefghij'[i % 10]}{'klmnopq'[i % 7]} the {'rstuvwxyz'[i % 9]}{'aeiou'[i % 5]}{'bcdfg'[i // 7 % 5]} of it", "en") for i in range(9_000)]
    rows += [(20_000 + i, "zzqzz" * 8, "en") for i in range(12)] + [(30_000, "le chat", "fr")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    lists = {lang: profile(sum((grams(t) for _, t, g in rows if g == lang), Counter())) for lang in ("en", "fr")}
    profiles = fit_profiles(frame)
    found = {lang: [int(profiles.codes[j]) for j in sorted(range(len(profiles.codes)), key=lambda j: profiles.ranks[i, j]) if profiles.ranks[i, j] < PLACES] for i, lang in enumerate(profiles.languages)}
    assert found == {lang: [code(g) for g in places] for lang, places in lists.items()}
    scores = sorted(profiles.predict(t)[1] for _, t, _ in rows if sum(c.isalpha() for c in t) >= 20)
    assert abs(lowest_score(frame, profiles) - scores[-(-len(scores) // 1000) - 1] / 2) < 1e-4


def test_ngrams_counted_in_a_table():
    """A table of n-grams holds those of each text, by itself or in a row with others."""
    import numpy as np

    from tessera.llm.langid import codes_of, counted_ngrams, letters_of, ngrams

    for texts in (["the cat, the hat. " * 40], ["ab cd " * 300, "", "x", "ÄÖ " * 90], ["日本語 テキスト"], ["a"], ["", ""]):
        letters = [letters_of(t) for t in texts]
        numbers, counts, present = counted_ngrams(np.concatenate(letters))
        codes, want = np.unique(np.concatenate([ngrams(x) for x in letters]), return_counts=True)
        assert codes_of(numbers, present).tolist() == codes.tolist() and counts.tolist() == want.tolist(), texts

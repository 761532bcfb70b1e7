import random
import re

import pytest

from tessera.llm import neardup
from tessera.llm.components import star_components
from tessera.llm.neardup import MinHash, drop_near_duplicates, near_duplicates
from tessera.llm.neardup_query import SPEC, op2_near_duplicates


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    root = list(range(len(sets)))
    where = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    find = lambda k: k if root[k] == k else find(root[k])
    for k, (_, s) in enumerate(sets):
        for j in {j for x in s for j in where[x] if j < k}:
            both = len(s & sets[j][1])
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both):
                root[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), i if not s else least.get(find(k))) for k, (i, s) in enumerate(sets)]


def same(spark, rows, spec):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, spec).collect()]
    want = [(i, n, c, i is not None and i == c) for i, n, c in brute(rows, spec.width, spec.percent)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=order) == sorted(want, key=order)


def copies(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    rows, base = [], [word() for _ in range(120)]
    for i in range(300):  # one large group whose copies drift apart
        base = list(base)
        base[rng.randrange(len(base))] = word()
        rows.append((i, " ".join(base)))
    passage = [word() for _ in range(40)]
    rows += [(1000 + i, " ".join(passage + [word() for _ in range(30)])) for i in range(60)]
    rows += [(2000 + i, "Same text\tin  all of THESE rows".lower() if i % 2 else "same text in all of these ROWS") for i in range(30)]
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "one"), (3004, "One"), (3005, "one two"), (None, "one two"), (None, None), (3006, "éÉ x y z"), (2000, "other words under an id that is taken")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("spec", [SPEC, MinHash()])
def test_against_brute_force(spark, spec):
    same(spark, copies(), spec)


def test_blocks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "HUGE", 100)
    same(spark, copies(6), SPEC)


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op2_near_duplicates(spark, sf_dir).collect())
    assert got == sorted(brute(rows, 3, 85))


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 102), (50, 60), (60, 55), (None, 3)]
    got = {r.node: r.component for r in star_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 50: 50, 60: 50, 55: 50}


def test_drop_and_empty(spark):
    docs = spark.createDataFrame([(2, "a b c d e f g"), (1, "A b c d e f g"), (3, "other"), (None, "a b c d e f g"), (4, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in drop_near_duplicates(docs).collect()) == [0, 1, 3, 4]
    assert near_duplicates(docs.limit(0)).count() == 0

import re

from tessera.llm.license_rules import BASE_PHRASES, RULES
from tessera.llm.licenses import license_columns, scan_licenses
from tessera.llm.licenses_query import COLUMNS, op10_license_scan


def brute(text):
    lowered = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    padded = " " + " ".join(words) + " "
    spans = []
    for i, rule in enumerate(RULES):
        for m in re.finditer(rule.regex, padded):
            start = padded[: m.start()].count(" ")
            spans.append((start, start + m[0].count(" "), rule.priority, rule.label, rule.confidence, i < len(BASE_PHRASES)))
    kept = []
    for a in spans:
        rank = lambda s: (s[0], -s[1], s[2], s[3], s[4], s[5])
        inside = any(b != a and b[0] <= a[0] and a[1] <= b[1] and b[2] <= a[2] and rank(b) < rank(a) for b in spans)
        if not inside and a not in kept:
            kept.append(a)
    base = []
    for label, _, phrase in BASE_PHRASES:
        want = phrase.split()
        base += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    starts = [i for i, _ in base]
    labels = {label for _, label in base}
    score = 1.0 if base else max((s[4] for s in kept), default=0.0)
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {s[3] for s in kept})), score)


TEXTS = [
    None, "", "   ", "No terms here at all.", "Used under the MIT License.", "under the mit license under the MIT-license!",
    "Licensed under the Apache License, Version 2.0. All rights reserved.", "CC BY-NC 4.0 and cc by nc", "éunder the mit license", "under the mit license",
    "licensed under the GNU General Public License, version 3. GNU General Public License, version 2 or (at your option) any later version",
    "SPDX-License-Identifier: GPL-2.0-or-later", "cc by nc sa 4.0 cc by nc", "the K mit license", "This is free and unencumbered software released into the public domain.",
    "x " * 3000 + "Licensed under CC BY-NC 4.0. " * 200, "mit license mit license", "Apache 2.0 license, BSD 3-clause license, the ISC license",
]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS + TEXTS[4:6])], "doc_id long, text string, labels string")
    got = {r.doc_id: tuple(r)[1:] for r in license_columns(scan_licenses(docs)).select(*COLUMNS).collect()}
    for i, text in enumerate(TEXTS + TEXTS[4:6]):
        assert got[i] == brute(text), text and text[:80]


def test_whole_table(spark, sf_dir):
    got = {r.doc_id: tuple(r)[1:] for r in op10_license_scan(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        assert got[r.doc_id] == brute(r.text)
    assert any(v[1] for v in got.values())


def test_no_shuffle_and_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    scanned = license_columns(scan_licenses(empty))
    assert scanned.count() == 0
    assert "Exchange" not in scanned._jdf.queryExecution().executedPlan().toString()


def spelled(pattern):
    """All texts that a rule's regex can match."""
    out = [""]
    for op, arg in pattern:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "BRANCH":
            more = [t for p in arg[1] for t in spelled(p)]
        elif name == "SUBPATTERN":
            more = spelled(arg[3])
        elif name == "MAX_REPEAT":
            more = ["", *spelled(arg[2])] if arg[0] == 0 else spelled(arg[2])
        elif name == "IN":
            more = [chr(arg[0][1])] if str(arg[0][0]) == "LITERAL" else ["x"]
        else:
            more = [""]
        out = [a + b for a in out for b in more]
    return out


def test_keywords_are_words_of_what_their_rules_match():
    for rule in RULES:
        for text in spelled(re._parser.parse(rule.regex)):
            assert rule.keyword in text.split(), (rule.label, text)

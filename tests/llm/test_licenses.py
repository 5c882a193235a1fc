import math
import random
import re

from rangeloom.llm import licenses
from rangeloom.llm.licenses import PHRASES, TEMPLATES, LicenseSpec

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def brute(text, spec=LicenseSpec()):
    """Every block of each template's width at every place of the text."""
    words = fold(text)
    places = [(i, label) for p, label in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    labels, best = {x for _, x in places}, 1.0 if places else 0.0
    for label, t in spec.templates:
        t = fold(t)
        width, want = math.ceil(len(t) * spec.stretch - 1e-9), set(t)
        for at in range(max(1, len(words))):
            block = words[at : at + width]
            if len(want.intersection(block)) >= spec.threshold * len(want) - 1e-9:
                share = lcs([w for w in block if w in want], t) / len(t)
                if share >= spec.threshold - 1e-9:
                    labels.add(label)
                    best = max(best, share)
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), round(best, 9)


def columns(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)


def test_query_equals_brute_force(spark, sf, corpus):
    rows = licenses.op4_containment_join(spark, sf).collect()
    assert len(rows) == len(corpus)
    assert all(columns(r) == brute(corpus[r.doc_id]) for r in rows)


def test_notices(spark):
    filler = " ".join(f"word{i}" for i in range(45))
    texts = [
        f"{filler} Permission is hereby granted, free of charge, to any person obtaining a\ncopy of this software and associated documentation files {filler}",
        f"{filler} {filler} licensed UNDER the apache license; version 2.0",
        "Licensed under CC BY-SA 4.0. cc by cc by",
        "All rights reserved. General Public License",
        "a license under the sun",
        "Licensed under the Apache Version 2.0",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for spec in (LicenseSpec(), LicenseSpec(threshold=0.75), LicenseSpec(stretch=2.0), LicenseSpec(stretch=1.0)):
        got = {r.doc_id: columns(r) for r in licenses.find_licenses(df, spec=spec).collect()}
        assert got == {i: brute(t, spec) for i, t in enumerate(texts)}
    default = {r.doc_id: r for r in licenses.find_licenses(df).collect()}
    assert default[0].labels == "mit" and default[1].labels == "apache-2.0" and default[2].n_base == 3
    assert default[2].labels == "cc-by,cc-by-sa" and default[3].labels == "gpl,reserved" and default[4].labels == ""


def test_rarest_word_leads(spark):
    df = spark.createDataFrame([(1, "the the the mit released"), (2, "under under the license the")], "doc_id long, text string")
    spec = LicenseSpec(templates=(TEMPLATES[1],))
    vocabulary = frozenset(x.encode() for x in fold(TEMPLATES[1][1]))
    got = licenses.template_tokens(spark, licenses.token_counts(df, vocabulary), spec).orderBy("rank").collect()
    assert [r.token for r in got] == ["license", "mit", "released", "under", "the"] and got[0].need == 5


def test_odd_rows(odd, odd_rows, empty):
    texts = {r[0]: r[1] for r in odd_rows}
    rows = licenses.find_licenses(odd).collect()
    assert len(rows) == len(odd_rows) and all(columns(r) == brute(texts[r.doc_id]) for r in rows)
    assert licenses.find_licenses(empty).collect() == []


def test_whole_notices_at_any_place(spark):
    """Notices of hundreds of words stand at any place, with changed words in them; half of one does not match."""
    r = random.Random(3)
    filler = lambda n: " ".join(f"word{r.randrange(99)}" for _ in range(n))
    texts, want = [], []
    for label, t in TEMPLATES:
        words = t.split()
        for k in range(3):
            changed = [x if i % 25 or i == 0 else "CHANGED" for i, x in enumerate(words)] if k == 2 and len(words) > 30 else words
            texts.append(f"{filler(r.randrange(90))} {' '.join(changed)} {filler(r.randrange(90))}")
            want.append(label)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.find_licenses(df).collect()}
    assert all(want[i] in got[i].labels.split(",") and got[i].score >= 0.9 for i in got) and len(got) == len(texts)
    assert all(columns(got[i]) == brute(texts[i]) for i in range(0, len(texts), 4))


def test_ninety_distinct_words(spark):
    """A template longer than any fixed block is found whole, and not by half of it."""
    t = " ".join(f"term{i}" for i in range(90))
    spec = LicenseSpec(templates=(("long", t),))
    texts = [f"a b {t} c d", " ".join(t.split()[:60]), " ".join(t.split()[:82]), " ".join(reversed(t.split()))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: columns(r) for r in licenses.find_licenses(df, spec=spec).collect()}
    assert got == {i: brute(x, spec) for i, x in enumerate(texts)}
    assert [got[i][5] for i in range(4)] == ["long", "", "long", ""]


def test_scattered_words_are_no_notice(spark):
    texts = ["Alice released a book under the counter; later the city granted MIT a license", "license MIT the under released", "released, under the MIT license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.find_licenses(df).collect()}
    assert got == {0: ("", 0.0), 1: ("", 0.0), 2: ("mit", 1.0)}

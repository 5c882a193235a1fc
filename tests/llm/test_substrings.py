import hashlib
import random

import pytest

from rangeloom.llm import substrings
from rangeloom.llm.substrings import RepeatSpec


def brute(rows, window=20):
    first, texts = {}, {}
    for doc_id, text in sorted((i, t or "") for i, t in rows if i is not None):
        texts[doc_id] = words = text.encode().split()
        for i in range(len(words) - window + 1):
            first.setdefault(tuple(words[i : i + window]), (doc_id, i))
    out = {}
    for doc_id, words in texts.items():
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < (doc_id, i):
                gone.update(range(i, i + window))
        out[doc_id] = (len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone))
    return out


def test_query_equals_brute_force(spark, sf, corpus):
    want = brute(list(corpus.items()))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.op9_de_bruijn(spark, sf).collect()}
    assert got == {i: (n, k, hashlib.sha256(t).hexdigest()) for i, (n, k, t) in want.items()}
    assert sum(k for _, k, _ in got.values()) > 0


ALL_HOT = RepeatSpec(hot_share=1e12, hot_least=0)


@pytest.mark.parametrize("spec", [RepeatSpec(), ALL_HOT, RepeatSpec(hash_bits=4), RepeatSpec(hot_share=1e12, hot_least=0, hash_bits=4)], ids=["cold", "hot", "collisions", "hot-collisions"])
def test_shared_passages(spark, spec):
    """Passages at the start, in the midst and at the end, copies, and repeats inside a text.

    Also with every anchor hot, and with word hashes of 4 bits, where most equal hashes are of different words.
    """
    r = random.Random(5)
    word = lambda n: [f"w{r.randrange(500)}" for _ in range(n)]
    passage, other = word(60), word(25)
    rows = []
    for i in range(60):
        t = word(r.randint(0, 50)) + r.choice([passage, other, passage[10:40], passage[:19], []]) + word(r.randint(0, 30))
        rows.append((i * 3 % 101, " ".join(t)))
    rows += [(200 + i, rows[7][1]) for i in range(5)]
    rows.append((300, " ".join(["again"] * 100)))
    rows.append((301, " ".join(other + other + other)))
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text.encode()) for r in substrings.remove_repeats(df, spec=spec).collect()}
    assert got == want


def test_odd_rows(spark, odd, odd_rows, empty):
    want = brute([r[:2] for r in odd_rows])
    got = substrings.remove_repeats(odd).collect()
    assert len(got) == len(odd_rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.text.encode()) for r in got} == want
    assert substrings.remove_repeats(empty).collect() == []


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed) for r in substrings.remove_repeats(df).collect()), key=repr)
    assert got == [(1, 0), (1, 0), (2, 40), (None, 0)]


@pytest.mark.parametrize("spec", [RepeatSpec(), ALL_HOT], ids=["cold", "hot"])
def test_texts_of_one_id(spark, spec):
    """Different texts under one doc_id are documents of their own, in the order of their keys."""
    w = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(w[:100])), (1, " ".join(w[60:90])), (1, " ".join(w[150:])), (2, " ".join(w[20:170])), (2, " ".join(w[20:170])), (3, " ".join(w[:30] + w[150:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {r.text: r.key for r in df.selectExpr("text", "shiftrightunsigned(xxhash64(text), 33) AS key").collect()}
    want = brute([((i, keys[t]), t) for i, t in rows])
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.text.encode()) for r in substrings.remove_repeats(df.repartition(4), spec=spec).collect())
    assert got == sorted((i, *want[i, keys[t]]) for i, t in rows)


def test_plan_compacts_by_joins(spark):
    """A copied passage of many runs is one span; its links, degrees and pointers are joins of written tables."""
    w = " ".join(f"w{i}" for i in range(400))
    df = spark.createDataFrame([(1, w), (2, "x " + w), (3, w + " y")], "doc_id long, text string").selectExpr("doc_id", "0L AS key", "text")
    runs = substrings.stored(substrings.late_runs(df), "test-runs")
    assert runs.count() > 20
    spans, stretches = substrings.paths(runs)
    assert sorted(tuple(r) for r in spans.select("doc_id", "place").collect()) == [(2, 1), (3, 0)]
    assert [tuple(r) for r in stretches.select("offset", "stretch_doc", "stretch_place", "stretch_n").collect()] == [(0, 1, 0, 381)]
    plan = substrings.nonbranching(runs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 3 and plan.count("Aggregate") == 1

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from rangeloom.llm import neardup
from rangeloom.llm.components import components
from rangeloom.llm.neardup import NearSpec, Signer, Sketches, possible, shingle_set


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, size):
    """Size and component of every id: all pairs that share a shingle are compared."""
    sets = defaultdict(list)
    for i, t in rows:
        sets[i].append(shingles(t, size))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = defaultdict(set)
    for i, own in sets.items():
        for s in own:
            for x in s:
                by[x].add(i)
    pairs = {p for ids in by.values() for p in itertools.combinations(sorted(ids), 2)}
    for a, b in pairs:
        for x, y in itertools.product(sets[a], sets[b]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a_, b_ = root(a), root(b)
                parent[max(a_, b_)] = min(a_, b_)
    return Counter((i, len(s), root(i), i == root(i)) for i, own in sets.items() for s in own)


def result(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def test_query_equals_brute_force(spark, sf, corpus):
    got = neardup.op2_odd_sketches(spark, sf)
    assert result(got) == brute(list(corpus.items()), 2)


def test_families(spark):
    """Copies with growing edits around several bases, so that links chain and many pairs stay just below the threshold."""
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for base in range(4):
        words = r.choices(vocab, k=150)
        for _ in range(45):
            own = list(words)
            for _ in range(r.randint(0, 18)):
                own[r.randrange(len(own))] = r.choice(vocab)
            rows.append((len(rows), " ".join(own)))
    rows += [(1000 + i, rows[i][1].upper()) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(neardup.near_duplicates(df, spec=NearSpec(shingle=2, group=4, block=8))) == brute(rows, 2)


def test_odd_rows(odd, odd_rows, empty):
    want = brute([r[:2] for r in odd_rows], 5)
    assert result(neardup.near_duplicates(odd)) == want
    assert neardup.near_duplicates(empty).collect() == []


def test_null_id_is_alone(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(df).collect()} == {(None, None), (2, 2)}


def test_keep_one(odd):
    kept = neardup.keep_one(odd)
    ids = sorted(r.doc_id for r in kept.collect())
    assert kept.columns == odd.columns and 6 not in ids and 5 in ids and 10 not in ids and ids[:3] == [1, 2, 3]


def test_a_single_word_is_a_set():
    assert len(shingle_set("word", 2)) == 1 and len(shingle_set("Word word", 2)) == 1 and not len(shingle_set(" ", 2))
    assert shingle_set("WORD", 2) == shingle_set("word", 2) and shingle_set("ÄB", 2) != shingle_set("äb", 2)


@pytest.mark.parametrize("n", [40, 500, 5000])
def test_sketches_never_lose_similar_sets(n):
    rng = np.random.default_rng(n)
    spec = NearSpec()
    signer = Signer(spec)
    sketch = lambda s: Sketches.of([len(s)], [signer.sketch(signer.samples(s))], [signer.fine(s)[0]], [signer.fine(s)[1]])
    lost = kept = 0
    for _ in range(30):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        cut = int(len(a) * 0.1)
        b = np.unique(np.r_[a[cut:], rng.integers(0, 2**63, cut, dtype=np.uint64)])  # 0.9 / 1.1 = 0.82
        far = np.unique(np.r_[a[len(a) // 3 :], rng.integers(0, 2**63, len(a) // 3, dtype=np.uint64)])  # 0.5
        lost += not possible(sketch(a), sketch(b), spec)[0]
        kept += possible(sketch(a), sketch(far), spec)[0]
    assert not lost and kept <= 3


def test_estimate_is_precise():
    spec = NearSpec()
    signer = Signer(spec)
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(40):
        a = np.unique(rng.integers(0, 2**63, 1000, dtype=np.uint64))
        b = np.unique(np.r_[a[50:], rng.integers(0, 2**63, 50, dtype=np.uint64)])
        x, y = (np.frombuffer(signer.sketch(signer.samples(s)), np.uint8) for s in (a, b))
        errors.append(neardup.estimate(np.bitwise_count(x ^ y).sum(), spec.samples, spec.bits) - 0.95 / 1.05)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 150), (300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[150] == got[200] == got[100] == 100
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_the_bitmap_loses_nothing(spark):
    from pyspark.sql import functions as F

    from rangeloom.llm.bitmap import likely

    docs = spark.range(-500, 5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    ids = spark.range(-500, 5000, 97).select(F.col("id").alias("doc_id"))
    few = likely(docs, ids, ["doc_id"])
    assert few.join(ids, "doc_id").count() == ids.count() and few.count() < ids.count() + 600
    assert likely(docs, ids, ["doc_id"], 64).join(ids, "doc_id").count() == ids.count()
    assert likely(docs, ids.limit(0), ["doc_id"]).count() == 0


def test_several_texts_of_one_id(spark):
    """An id with two or three texts is one document: what each text links to is reachable from it."""
    r = random.Random(11)
    text = lambda: [f"w{r.randrange(3000)}" for _ in range(120)]
    near = lambda t: t[:-2] + ["x", "y"]
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a), (1, b), (5, near(a)), (6, near(b)), (7, c), (8, c), (8, d), (2, near(d)), (9, text()), (9, a), (None, a), (3, [])]
    rows = [(i, " ".join(t)) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    group = {1: 1, 5: 1, 6: 1, 9: 1, 7: 2, 8: 2, 2: 2, 3: 3}
    want = {(i, len(neardup.shingle_set(t, 5)), group.get(i), i == group.get(i, 0) if i is not None else True) for i, t in rows}
    assert {x[:3] for x in got} == {x[:3] for x in want} and {x for x in got if x[0] is not None} == {x for x in want if x[0] is not None}
    assert df.count() == len(neardup.near_duplicates(df).collect())


def test_only_ids_with_several_texts_get_numbers(spark):
    """Ids at both ends of the numbers, an id with an empty and a full text, and a set that stands under many ids."""
    r = random.Random(12)
    text = lambda: [f"w{r.randrange(3000)}" for _ in range(80)]
    a, b, c = text(), text(), text()
    top = 2**63 - 1
    rows = [(top, a), (top, []), (4, a), (top - 1, b), (top - 1, a), (9, b), (7, c), (7, c), (3, c), (8, text()), (8, [])]
    rows = [(i, " ".join(t)) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert result(neardup.near_duplicates(df)) == brute(rows, 5)
    named = neardup._named(neardup.signatures(df, NearSpec()))
    assert sorted({x.doc_id for x in named.collect()}) == [8, top - 1, top] and all(x.node < 3 for x in named.collect())


def below_the_threshold(n, seed=5):
    """Texts of 1,000 words that differ from one another in about 30 places each, at a similarity of about 0.79."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(1000)]
    rows = []
    for i in range(n):
        own = list(words)
        for at in r.sample(range(1000), 30):
            own[at] = f"x{i}-{at}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("n", [100, 200])
def test_a_family_below_the_threshold(spark, n, monkeypatch):
    """A text is sent once for a block pair and band, not once for a partner: as often however many texts there are in a block."""
    rows = below_the_threshold(n)
    sent = []
    close = neardup._close
    monkeypatch.setattr(neardup, "_close", lambda *a: sent.append(close(*a)) or sent[-1])
    got = result(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), spec=NearSpec(shingle=2)))
    assert got == brute(rows, 2)
    assert sent[0].count() <= 40 * n

import zlib

import numpy as np
import pytest

from rangeloom.llm import language
from rangeloom.llm.language import LanguageSpec, fit, marginals


def enumerate_marginals(emit, moves):
    """All label sequences of one short text."""
    import itertools

    n, k = emit.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        first = np.exp(moves[:, path[0]]).sum() / k
        p = first * np.exp(sum(emit[i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        for i, y in enumerate(path):
            out[i, y] += p
    return out / out.sum(1, keepdims=True)


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    moves = rng.normal(size=(3, 3))
    lengths = np.array([1, 5, 7])
    emit = rng.normal(size=(13, 3)).astype(np.float32)
    for segment in (2, 3, 64):
        got = marginals(emit, lengths, moves, segment)
        at = 0
        for n in lengths:
            assert np.allclose(got[at : at + n], enumerate_marginals(emit[at : at + n], moves), atol=1e-4)
            at += n


def test_gradient():
    rng = np.random.default_rng(2)
    emit, moves, labels = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.integers(0, 3, (2, 4))

    def loss(e, t):
        import itertools

        total = 0.0
        for b in range(2):
            score = lambda p: np.log(np.exp(t[:, p[0]]).sum() / 3) + sum(e[b, i, y] for i, y in enumerate(p)) + sum(t[x, y] for x, y in zip(p, p[1:]))  # noqa: E731, B023
            total += np.log(sum(np.exp(score(p)) for p in itertools.product(range(3), repeat=4))) - score(tuple(labels[b]))
        return total

    d_emit, _ = language._gradient(emit, moves, labels)
    for place in ((0, 0, 0), (1, 3, 2), (0, 2, 1)):
        step = np.zeros_like(emit)
        step[place] = 1e-5
        assert d_emit[place] == pytest.approx((loss(emit + step, moves) - loss(emit - step, moves)) / 2e-5, abs=1e-4)


def test_held_out_accuracy(spark, sf):
    base = sf.replace("sf0.001", "sf0.01")
    langs = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    rows = language.op1_word_crf(spark, base).collect()
    assert len(rows) == len(langs)
    hits = [r.lang_pred == langs[r.doc_id][0] for r in rows if r.held_out and len((langs[r.doc_id][1] or "").split()) >= 5]
    assert np.mean(hits) > 0.95 and len(hits) > 100
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1


@pytest.fixture(scope="module")
def model():
    english = "the cat sat on the mat with another that thing where they have been there then".split()
    german = "der hund und die katze sind nicht auf einem schiff aber doch zwischen den stühlen".split()
    rng = np.random.default_rng(0)
    rows = [(" ".join(rng.choice(english, 60)), "en") for _ in range(60)] + [(" ".join(rng.choice(german, 60)), "de") for _ in range(60)]
    return fit(rows, LanguageSpec(epochs=4))


def test_code_switched_words(spark, model):
    text = "the cat sat on the mat und die katze sind nicht auf einem schiff there they have been"
    df = spark.createDataFrame([(1, text), (2, None), (3, "123 !!")], "doc_id long, text string")
    got = {r.doc_id: r.words for r in language.label_words(df, model).collect()}
    assert [w.lang for w in got[1]] == ["en"] * 6 + ["de"] * 8 + ["en"] * 4 and not got[2] and not got[3]
    assert all(0.5 <= w.p <= 1 for w in got[1])


def test_odd_rows(odd, odd_rows, empty, model):
    got = language.identify(odd, model).collect()
    assert len(got) == len(odd_rows) and language.identify(empty, model).collect() == []
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 13)) and by[4].lang_pred in ("de", "en")


def test_no_labels(spark, odd):
    rows = language.training_rows(odd.withColumn("lang", odd.lang.substr(9, 1).cast("string")).where("false"), LanguageSpec())
    assert rows == [] and {r.lang_pred for r in language.identify(odd, fit(rows)).collect()} == {"und"}


def test_training_leaves_out_held_out_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = language.training_rows(docs, LanguageSpec(per_language=5, max_rows=12))
    free = [f" {' '.join(language.words_of(r.text))} " for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    # Each is a stretch of the words of a text that is not held out.
    assert len(rows) == 12 and all(len(t.split()) <= 160 and any(f" {t} " in x for x in free) for t, _ in rows)


def test_features_are_of_the_word_alone():
    a, start = language.features(["ab", "straße", "x"], {"x": 0}, 1 << 16)
    b, _ = language.features(["straße"], {"x": 0}, 1 << 16)
    assert sorted(a[start[1] : start[2]]) == sorted(b)

import random
import re
from collections import Counter

import zstandard

from rangeloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {w for w, k in Counter(windows).items() if k > 1}
    hit = {j for i, w in enumerate(windows) if w in often for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n


def verdict(text):
    """By a compressor of its own: the whole text's ratio in the band of its length, and at most half of the chunks outside theirs."""
    raw = (text or "").encode()
    if brute(text)[-1] or not raw:
        return False
    size = lambda x: len(zstandard.ZstdCompressor(level=3).compress(x)) / len(x)
    low, high = next((lo, hi) for below, lo, hi in quality.Bands().limits if len(raw) < below)
    cuts = [*range(0, len(raw), 2048), len(raw)]
    chunks = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
    if len(chunks) > 1 and len(chunks[-1]) < 1024:
        chunks[-2:] = [chunks[-2] + chunks[-1]]
    chunks = [] if len(raw) < 1024 else chunks
    bad = [c for c in chunks if not 0.18 <= size(c) <= 0.80]
    return low <= size(raw) <= high and 2 * len(bad) <= len(chunks)


def columns(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_query_equals_brute_force(spark, sf, corpus):
    rows = quality.op10_compression_bands(spark, sf).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        assert columns(r) == brute(corpus[r.doc_id])
        assert r.kept == verdict(corpus[r.doc_id])


def test_odd_rows(odd, odd_rows, empty):
    rows = quality.quality_report(odd).collect()
    assert len(rows) == len(odd_rows) and quality.quality_report(empty).collect() == []
    texts = {r[0]: r[1] for r in odd_rows}
    for r in rows:
        assert columns(r) == brute(texts[r.doc_id])
        assert r.kept == (r.doc_id in (4, 9, 10)) == verdict(texts[r.doc_id])


def test_bands():
    measure = quality.measurer()
    r = random.Random(1)
    vocab = ["".join(r.choice("etaoinsrhld") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    prose = " ".join(r.choices(vocab, weights=[1 / (i + 3) for i in range(3000)], k=600))
    noise = " ".join("".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60)) for _ in range(60))
    dull = " ".join(f"item{i % 7} and so on" for i in range(400))
    assert measure(prose).kept
    assert not measure(noise).kept and measure(noise).ratio > 0.7
    assert not measure(dull).kept and measure(dull).ratio < 0.1
    # A good start does not hide a bad rest: chunks are judged too.
    long = prose + " " + " ".join("".join(r.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+-") for _ in range(70)) for _ in range(150))
    assert not measure(long).kept


def test_keep_quality_keeps_columns(odd):
    kept = quality.keep_quality(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [4, 9, 10]


def test_agreement_with_labels(spark):
    docs = spark.createDataFrame([(1, "x y"), (2, " ".join(f"w{i * i}" for i in range(60))), (3, ""), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (9, 1), (None, 0), (2, None)], "doc_id long, quality int")
    got = {(r.quality, r.kept): r.n for r in quality.agreement(docs, labels).collect()}
    assert got == {(0, False): 1, (1, True): 1, (1, False): 1}

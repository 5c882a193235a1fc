import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rangeloom.llm import packing
from rangeloom.llm.bpe import vocabulary
from rangeloom.llm.packing import PackSpec


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(vocabulary(packing.VOCABULARY))
    t.no_truncation()
    t.no_padding()
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check(pieces, docs, library, window=2048):
    """Each id of each row in one piece, no gap in a sequence, no padding; ``docs`` are ``(doc_id, text)``."""
    want, sequences = {}, {}
    for k, text in docs:
        want.setdefault(k, []).append(library(text))
    left = {k: sorted(x.tobytes() for x in v) for k, v in want.items()}
    for k, own in want.items():
        mine = sorted((r for r in pieces if r.doc_id == k), key=lambda r: (r.doc_tokens, r.start))
        assert sum(r.length for r in mine) == sum(map(len, own))
        if len({x.tobytes() for x in own}) == 1:  # repeated rows of one id: each place as often as there are rows
            covered = [0] * len(own[0])
            for r in mine:
                assert r.length > 0 and r.doc_tokens == len(own[0]) and r.ids_crc32 == zlib.crc32(own[0][r.start : r.start + r.length].tobytes())
                covered[r.start : r.start + r.length] = [c + 1 for c in covered[r.start : r.start + r.length]]
            assert set(covered) == {len(own)}
    assert {r.doc_id for r in pieces} == set(left)
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and (at == window or at & (at - 1) == 0)


def test_query(spark, sf, corpus, library):
    check(packing.op12_bm25_packing(spark, sf).collect(), list(corpus.items()), library)


@pytest.mark.parametrize("spec", [PackSpec(), PackSpec(window=64, shard_load=4000, least_df=1)])
def test_odd_rows(spark, odd, odd_rows, library, spec):
    """Null and empty texts, a very long text, repeated rows, clashing columns; also with many shards for one name."""
    check(packing.packed(odd, spec=spec).collect(), [r[:2] for r in odd_rows], library, spec.window)


def test_empty(spark, empty):
    out = packing.packed(empty)
    assert out.collect() == [] and out.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_null_id(spark, library):
    rows = [(None, "a b"), (1, "a c"), (None, "a b")]
    check(packing.packed(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows, library)


def test_words_give_the_ids_of_the_text(library):
    """Odd characters, special tokens inside words, marks that compose, long words: the same as the library on the whole text."""
    r = random.Random(5)
    alphabet = "ab'sS tTÀéßſŉĿ×÷ ́éİΣÅﬁ \n\t1١,.!<|>\U0001f600　ẛ̣\x1c\x85"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["x<|endoftext|>y <|startoftext|>", "it's we'LL", "q" * 300 + " " + "q" * 300, "", "é" * 100, "a\x1cb\x0bc", "<|endoftext|", "ABC<|ENDOFTEXT|>é"]
    texts += ["".join(r.choice("abS'sÀéßſŉĿ1,! \n<|") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    t = packing.WordTokenizer(vocabulary(packing.VOCABULARY))
    for lo in range(0, len(texts), 700):
        own = texts[lo : lo + 700]
        got, place = t.encode(pa.array(own), 1)
        assert sorted(place.tolist()) == list(range(len(own)))
        assert [np.frombuffer(x.as_py(), t.kind).tolist() for x in got] == [library(own[i]).tolist() for i in place]
    assert t.encode(pa.array([], pa.string()), 1)[0].to_pylist() == []


def test_known_characters_have_one_lower_case(library):
    """Each character that is cut here, alone and between letters: the same as the library."""
    t = packing.WordTokenizer(vocabulary(packing.VOCABULARY))
    texts = [x for c in map(chr, range(0x180)) if t.known_characters(c) for x in (c, f"A{c}b", f"{c}{c} {c}")]
    got, place = t.encode(pa.array(texts), 1)
    assert len(texts) > 900 and [np.frombuffer(x.as_py(), t.kind).tolist() for x in got] == [library(texts[i]).tolist() for i in place]


def brute_pack(docs, spec):
    """The rule in plain Python: scores by the formula over all documents, one neighbour after the other."""
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    terms = [{int(t): list(d[:-1]).count(t) for t in d[:-1]} for d in docs]
    df = {}
    for own in terms:
        for t in own:
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log((n - k + 0.5) / (k + 0.5)) for t, k in df.items()}

    def score(q, d):
        total = 0.0
        for t in sorted(terms[q]):
            if idf[t] > 0 and t in terms[d]:
                tf = terms[d][t]
                total += idf[t] * (tf * (spec.k1 + 1) / (tf + spec.k1 * (1 - spec.b + spec.b * (len(docs[d]) / mean))))
        return total

    sequences, at, rest = [], [0] * n, [len(d) for d in docs]
    for i in range(n):
        while rest[i] >= spec.window:
            sequences.append([(i, at[i], spec.window)])
            at[i], rest[i] = at[i] + spec.window, rest[i] - spec.window
    unused, following = [i for i in range(n) if rest[i]], None
    while unused or following is not None:
        seed = unused.pop(0) if following is None else following
        following, own, room = None, [], spec.window
        queue = [seed, *sorted(unused, key=lambda d: (-score(seed, d), d))]
        for d in queue:
            k = min(rest[d], room)
            own.append((d, at[d], k))
            at[d], rest[d], room = at[d] + k, rest[d] - k, room - k
            if d in unused:
                unused.remove(d)
            if rest[d]:
                following = d
            if not room:
                break
        sequences.append(own)
    return sequences


@pytest.mark.parametrize("seed", range(4))
def test_pack_equals_brute_force(seed):
    r = random.Random(seed)
    spec = PackSpec(window=64)
    docs = [np.array([min(int(r.expovariate(0.05)), 199) + 2 for _ in range(r.choice([0, 3, 20, 40, 150]))] + [1]) for _ in range(120)]
    docs += [docs[3], docs[3]]
    df = np.zeros(256, np.int64)
    for d in docs:
        df[np.unique(d[:-1])] += 1
    n = len(docs)
    c = packing.Corpus(n, sum(map(len, docs)) / n, np.array([math.log((n - k + 0.5) / (k + 0.5)) for k in df.tolist()]), np.zeros(256), spec)
    got = {}
    for i, at, k, sequence, offset, _ in packing.pack(docs, c):
        got.setdefault(sequence, []).append((offset, i, at, k))
    got = [[x[1:] for x in sorted(v)] for _, v in sorted(got.items())]
    want = brute_pack(docs, spec)
    full = len(want) - (sum(k for _, _, k in want[-1]) < spec.window)
    assert got[:full] == want[:full]
    assert all(sum(k for _, _, k in s).bit_count() == 1 for s in got[full:])


def test_statistics_cover_all_documents(spark, sf, corpus, library):
    """Document frequencies and the mean length are those of all documents, however they are cut in tasks."""
    t = packing.tokenizer(vocabulary(packing.VOCABULARY))
    rows = packing.tokens(spark.createDataFrame(list(corpus.items()), "doc_id long, text string").repartition(7))
    c = packing.corpus(rows, t.size, t.kind, PackSpec())
    df = np.zeros(t.size, np.int64)
    for x in corpus.values():
        df[np.unique(library(x)[:-1])] += 1
    n = len(corpus)
    assert c.docs == n and c.mean == sum(len(library(x)) for x in corpus.values()) / n
    assert np.allclose(c.idf, np.log((n - df + 0.5) / (df + 0.5)))

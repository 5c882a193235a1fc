import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rangeloom.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.vocabulary())


@pytest.fixture(scope="module")
def ours():
    return bpe.transducer(bpe.vocabulary())


def ids_of(t, text):
    return np.frombuffer(b"".join(t.encode(text)), "<u4").tolist()


def test_query_equals_library(spark, sf, corpus, library):
    rows = bpe.op6_bpe_transducer(spark, sf).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        ids = library.encode(corpus[r.doc_id] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab '-\n\t 0é<|endoftx>日🙂"), st.characters(codec="utf-8")), max_size=80))
def test_any_text(text):
    t = bpe.transducer(bpe.vocabulary())
    lib = tokenizers.Tokenizer.from_file(bpe.vocabulary()) if not hasattr(test_any_text, "lib") else test_any_text.lib
    test_any_text.lib = lib
    for x in (text, text + "<|endoftext|>" + text):
        ids = ids_of(t, x)
        assert ids == lib.encode(x, add_special_tokens=False).ids
        assert bpe.Decoder(t).feed(ids, final=True) == x


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=127), max_size=60), max_size=6))
def test_ascii_texts_together(texts):
    t = bpe.transducer(bpe.vocabulary())
    lib = test_any_text.lib
    assert [np.frombuffer(b"".join(p), "<u4").tolist() for p in t.encode_each(texts)] == [lib.encode(x, add_special_tokens=False).ids for x in texts]


def test_pieces_merged_together(ours):
    r = random.Random(6)
    tokens = [b for b in ours.bytes_of.values() if len(b) < 9]
    pieces = [b"".join(r.choices(tokens, k=r.randint(0, 7)))[:64] for _ in range(5000)] + [bytes(r.randrange(256) for _ in range(r.randint(0, 64))) for _ in range(500)]
    assert ours.merge_all(pieces) == [np.array(ours.merge(p), "<u4").tobytes() for p in pieces]
    assert ours.merge_all([]) == []


def test_known_pieces_are_bounded(ours, library, monkeypatch):
    monkeypatch.setattr(bpe, "_CACHE", 50)
    monkeypatch.setattr(bpe, "_GROUP", 300)
    r = random.Random(8)
    texts = ["", *(" ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 90))) for _ in range(60)), "x" * 2000]
    t = bpe.Transducer(bpe.vocabulary())
    assert [np.frombuffer(b"".join(p), "<u4").tolist() for p in t.encode_each(texts)] == [library.encode(x, add_special_tokens=False).ids for x in texts]


def test_streaming_equals_whole(ours):
    r = random.Random(2)
    tokens = [b for b in ours.bytes_of.values() if b.isalpha()]
    for data in [b"".join(r.choices(tokens, k=500)) for _ in range(20)] + [b"a" * 5000, b"ab" * 3000, "é".encode() * 3000, b"=-" * 4000]:
        assert list(ours.stream(data)) == ours.merge(data)


def test_lookahead_is_short_and_needed(ours):
    assert 0 < ours.lookahead < ours.window < 2000


def test_long_texts(ours, library):
    for text in ("x" * 150_000, "word " * 60_000, " " * 70_000 + "a", ("ab\n" * 30_000)):
        assert ids_of(ours, text) == library.encode(text, add_special_tokens=False).ids


def test_both_merge_ways_agree(ours):
    r = random.Random(4)
    for _ in range(300):
        data = bytes(r.randrange(256) for _ in range(r.randint(0, 60)))
        assert ours._merge_few(data) == ours._merge_many(data)


def test_decoder_takes_any_split(ours):
    text = "日本語🙂é ok"
    ids = ids_of(ours, text)
    d = bpe.Decoder(ours)
    assert "".join(d.feed([i]) for i in ids) + d.feed([], final=True) == text
    lone = [ours.byte_id[0xE6], ours.byte_id[0x97]]
    assert bpe.Decoder(ours).feed(lone, final=True) == "�"


def test_odd_rows(odd, odd_rows, empty, library):
    texts = {r[0]: r[1] or "" for r in odd_rows}
    encoded = bpe.encode(odd)
    rows = encoded.collect()
    assert len(rows) == len(odd_rows) and bpe.encode(empty).collect() == [] and bpe.round_trip(empty).collect() == []
    for r in rows:
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    assert all(r.text == texts[r.doc_id] for r in bpe.decode(encoded).collect())

import base64
import hashlib
import random
import re
import time

import numpy as np
import pytest
from rangeloom.llm import secrets
from rangeloom.llm.secrets import SecretSpec

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    kinds = [
        [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6],
        [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20],
        [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24],
    ]
    spans = sorted((s, k, e) for k, own in enumerate(kinds) for s, e in own)
    line = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)
    return *(len(x) for x in kinds), hashlib.sha256(line.encode()).hexdigest(), line


def test_query_equals_brute_force(spark, sf, corpus):
    rows = secrets.op7_randomness_battery(spark, sf).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        *want, line = brute(corpus[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex, r.base_sha256] == want
        assert [x for x in r.spans.split(",") if not x.startswith("random")] == line.split(",")


def test_patterns():
    for text in ["é token=abcdef", 'API_KEY": "a+b/c=", apikey=x', "ſecret=abcdefg", "passwordpassword=abcdef123 passwd:abcdef", "AKIA" * 6, "AKIA12", "0" * 24 + "g" + "f" * 23, "PASSWD  =  'secret=abcdefgh'"]:
        got = secrets.base_spans(text)
        assert ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in got) == brute(text)[-1]


def test_random_strings_are_found(spark, sf):
    r = random.Random(9)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    planted = {}
    rows = []
    for doc_id, text in docs:
        if doc_id % 5 == 0:
            key = base64.b64encode(r.randbytes(48)).decode()
            planted[doc_id] = (len(text) + 1, len(text) + 65)
            text = f"{text} {key} end"
        elif doc_id % 5 == 1:
            text += " http-header-accept-language-value-number-1 abcdefghijklmnopqrstuvwxyz0123456789 aaaaaaaaaaaaaaaaaaaaaaaaaa1b2c3"
        rows.append((doc_id, text))
    found = {x.doc_id: [s for s in x.spans.split(",") if s.startswith("random")] for x in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = sum(f"random:{s}:{e}" in found[i] for i, (s, e) in planted.items())
    assert hits >= 0.85 * len(planted)
    assert sum(len(v) for i, v in found.items() if i not in planted) == 0


def test_battery():
    r = random.Random(3)
    uniform = [[r.randrange(64) for _ in range(64)] for _ in range(400)]
    for test in (secrets.chi_squared, secrets.runs, secrets.serial):
        p = sorted(test(x, 64) for x in uniform)
        assert 0.3 < p[200] < 0.7 and sum(x < 0.05 for x in p) < 45
    assert secrets.chi_squared([1] * 64, 64) < 1e-6
    assert secrets.runs(list(range(64)), 64) < 1e-6
    assert secrets.serial(list(range(64)), 64) < 1e-6


def test_encoding():
    assert [secrets.encoding(s)[0] for s in ("00ff", "00FF", "XYZ234", "xyz189z", "aB+/")] == ["hex", "hex", "base32", "base36", "base64"]


def test_false_discovery_rule():
    spec = SecretSpec(lengths=(20,), bins=50, level=1e-4)
    null = {30 + i: 100 for i in range(10)}
    assert secrets.last_bins(null, {(0, 1): 5}, spec)[0] >= 1
    assert secrets.last_bins(null, {(0, 35): 5}, spec) == [-1]
    assert secrets.last_bins({}, {(0, 1): 5}, spec) == [-1] and secrets.last_bins(null, {}, spec) == [-1]


def test_odd_rows(odd, odd_rows, empty):
    texts = {r[0]: r[1] for r in odd_rows}
    rows = secrets.find_secrets(odd).collect()
    assert len(rows) == len(odd_rows) and secrets.find_secrets(empty).collect() == []
    assert all([r.n_assign, r.n_access, r.n_hex, r.base_sha256] == list(brute(texts[r.doc_id])[:-1]) for r in rows)


def test_rows_of_letters_score_as_single_strings():
    r = random.Random(5)
    spec = SecretSpec()
    for letters in ("abcdef", "ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "etaoinETAOINabcxyzXYZ", "aaaaaaaab"):
        for n in spec.lengths:
            strings = ["".join(r.choice(letters) for _ in range(n)) for _ in range(60)] + [letters[0] * n]
            counts = secrets.OrdinaryCounts(spec)
            want = np.zeros_like(counts.counts)
            for s in strings:
                counts.add(s, [])
                for k, size in enumerate(spec.lengths):
                    for i in range(0, len(s) - size + 1, size):
                        name, codes, of = secrets.encoding(s[i : i + size])
                        want[secrets._NAMES.index(name), k, secrets._bin(secrets.randomness(codes, of), spec)] += 1
            counts.flush()
            assert (counts.counts == want).all()


@pytest.mark.parametrize("middle", ["", "0123456789 | " * 400, "é" * 4000])
def test_null_counts_all_of_a_text(spark, middle):
    """Every string of a long text counts, wherever it stands; tested strings are not ordinary."""
    r = random.Random(6)
    key = "aB3" + base64.b64encode(r.randbytes(30)).decode()
    half = " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(3000))
    text = f"{half} {key} {middle} {half}"
    spec = SecretSpec()
    rows = secrets.scan(spark.createDataFrame([(1, text), (2, "short Words of some letters")], "doc_id long, text string").repartition(2), spec).collect()
    assert sorted(x.doc_id for x in rows if x.base is not None) == [1, 2]
    n = [0] * len(spec.lengths)
    for x in rows:
        for cell, k in x.ordinary or []:
            n[cell // spec.bins % len(n)] += k
    assert n == [30000 // size + (23 // size) for size in spec.lengths]


def test_null_is_of_the_own_encoding():
    spec = SecretSpec(lengths=(20,), bins=50, level=1e-4)
    lower, mixed = {2 * 50 + 35: 5000}, {3 * 50 + 1: 5000}
    last = secrets.last_bins(lower | mixed, {(2, 10): 5, (3, 10): 5}, spec, 4)
    assert last[2] >= 10 > last[3]
    assert secrets.last_bins(mixed, {(0, 10): 5}, spec, 4) == [-1] * 4


@pytest.mark.parametrize("seed", range(5))
def test_candidates_lie_outside_all_spans(seed):
    """The pass over two sorted lists gives what comparing each with each gives, spans of several kinds overlapping."""
    r = random.Random(seed)
    spec = SecretSpec()
    text = " ".join(base64.b64encode(r.randbytes(r.randint(15, 60))).decode() for _ in range(200))
    spans = sorted((a := r.randrange(len(text)), r.randrange(3), min(len(text), a + r.choice([1, 24, 300]))) for _ in range(60))
    everything = secrets.candidates(text, [], spec)
    assert everything and secrets.candidates(text, spans, spec) == [c for c in everything if not any(a < c[1] and c[0] < b for a, _, b in spans)]


def test_many_spans_in_a_text():
    """100,000 fixed-pattern spans beside 1,000 strings to test, in a time that no comparison of each with each meets."""
    r = random.Random(1)
    keys = [base64.b64encode(r.randbytes(30)).decode() for _ in range(1000)]
    text = "\n".join(f"token=abcdef{i}" + (f" {keys[i // 100]}" if i % 100 == 0 else "") for i in range(100_000))
    spans = secrets.base_spans(text)
    began = time.perf_counter()
    found = secrets.candidates(text, spans, SecretSpec())
    assert len(spans) == 100_000 and len(found) > 900 and time.perf_counter() - began < 2

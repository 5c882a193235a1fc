"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm._text import documents, per_row
from rangeloom.shared import stored

#: Kinds of the fixed patterns, in order, and the kind that the tests add (fixed values).
KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORDS = ("passw", "secret", "token", "api")

#: Strings that may be encoded random bytes.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

_BASE64 = {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")} | {"-": 62, "_": 63}
_ALPHABETS: tuple[tuple[str, re.Pattern, dict[str, int], int], ...] = (
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), {c: int(c, 16) for c in "0123456789abcdefABCDEF"}, 16),
    ("base32", re.compile(r"[A-Z2-7]+=*"), {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")}, 32),
    ("base36", re.compile(r"[0-9A-Z]+|[0-9a-z]+"), {c: int(c, 36) for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}, 36),
    ("base64", re.compile(r"[A-Za-z0-9+/_-]+=*"), _BASE64, 64),
)
_NAMES = [name for name, *_ in _ALPHABETS]

#: Base64 codes of ASCII letters by byte; 255 for all other bytes.
_LETTER_CODES = np.full(256, 255, np.uint8)
_LETTER_CODES[[*range(65, 91), *range(97, 123)]] = np.arange(52)


@dataclass(frozen=True)
class SecretSpec:
    """``rate``: share of false discoveries that is allowed among the added spans.

    ``lengths``: lower ends of the length classes; ``bins_per_decade``: resolution of the p-values that are
    counted over the corpus; ``least_null``: ordinary strings that a length class of an encoding needs for a null of
    its own, else the next shorter class is added to it, and where that is not enough, all encodings are taken.
    """

    rate: float = 0.05
    level: float = 1e-3
    lengths: tuple[int, ...] = (20, 24, 32, 40, 56, 80)
    bins_per_decade: int = 10
    bins: int = 200
    least_null: int = 1000


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared(codes: list[int], size: int) -> float:
    """p-value of uniformity over the alphabet, in as many equal cells as leave four expected symbols a cell."""
    n = len(codes)
    cells = max(2, min(size, 1 << max(1, (n // 4).bit_length() - 1)))
    counts = [0] * cells
    for c in codes:
        counts[c * cells // size] += 1
    expect = [((i + 1) * size + cells - 1) // cells - (i * size + cells - 1) // cells for i in range(cells)]
    x = sum((k - n * e / size) ** 2 / (n * e / size) for k, e in zip(counts, expect, strict=True))
    df = cells - 1
    # Wilson and Hilferty: the cube root of chi-squared over its degrees of freedom is nearly normal.
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return min(1.0, 0.5 * math.erfc(z / math.sqrt(2)))


def runs(codes: list[int], size: int) -> float:
    """p-value of the number of runs above and below the middle of the alphabet."""
    up = [2 * c >= size for c in codes]
    a = sum(up)
    b = len(up) - a
    if not a or not b:
        return 0.5 ** (len(up) - 1)
    n = a + b
    mean = 2 * a * b / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    seen = 1 + sum(x != y for x, y in zip(up, up[1:]))
    return _normal_tail((seen - mean) / math.sqrt(var)) if var > 0 else 1.0


def serial(codes: list[int], size: int) -> float:
    """p-value of the correlation of neighbouring symbols."""
    n = len(codes)
    mean = sum(codes) / n
    d = [c - mean for c in codes]
    total = sum(x * x for x in d)
    if not total:
        return 0.5 ** (n - 1)
    r = sum(x * y for x, y in zip(d, d[1:])) / total
    return _normal_tail((r + 1 / n) * math.sqrt(n))


def encoding(s: str) -> tuple[str, list[int], int]:
    """The smallest alphabet that a string fits, its symbols there and the alphabet's size."""
    for name, fits, codes, size in _ALPHABETS:
        if fits.fullmatch(s):
            return name, [codes[c] for c in s if c != "="], size
    return "base64", [_BASE64[c] for c in s if c != "="], 64


def randomness(codes: list[int], size: int) -> float:
    """Smallest p-value of the three tests, times three: how well symbols of an alphabet pass for uniform random ones."""
    if len(codes) < 8:
        return 0.0
    return min(1.0, 3 * min(chi_squared(codes, size), runs(codes, size), serial(codes, size)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the fixed patterns, leftmost and non-overlapping for each kind."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _bin(p: float, spec: SecretSpec) -> int:
    return min(spec.bins - 1, int(-math.log10(max(p, 1e-300)) * spec.bins_per_decade))


def _may_be_random(token: str) -> bool:
    if any(c.isdigit() for c in token):
        return len(set(token)) > 4 and not token.isdigit()
    upper = sum(c.isupper() for c in token[1:])
    return upper >= 3 and sum(c.islower() for c in token) >= 3


def candidates(text: str, spans: list[tuple[int, int, int]], spec: SecretSpec) -> list[tuple[int, int, int, int]]:
    """Strings outside ``spans`` that may be random: ``(start, end, class, bin)``, the class of encoding and length.

    ``spans`` are sorted by start and strings come in order, so one pass over both lists tells which meet: a string does if
    the furthest end of the spans that start before its own end lies behind its start.
    """
    found, i, reach = [], 0, 0
    for m in _CANDIDATE.finditer(text):
        s, e = m.span()
        while i < len(spans) and spans[i][0] < e:
            reach, i = max(reach, spans[i][2]), i + 1
        if reach <= s and _may_be_random(m[0]):
            name, codes, size = encoding(m[0])
            length = sum(1 for x in spec.lengths if x <= e - s) - 1
            found.append((s, e, _NAMES.index(name) * len(spec.lengths) + length, _bin(randomness(codes, size), spec)))
    return found


def encodings(rows: np.ndarray) -> np.ndarray:
    """For each row of letters (base64 codes) the number of the smallest alphabet that it fits, as :func:`encoding`."""
    upper = rows < 26
    n_upper = upper.sum(1)
    few = np.where(upper, rows, rows - 26).max(1) < 6
    one_case = np.where(n_upper == rows.shape[1], 1, np.where(n_upper == 0, 2, 3))
    return np.where(few & (one_case < 3), 0, one_case)


def bins_of_rows(codes: np.ndarray, size: int, spec: SecretSpec) -> np.ndarray:
    """Bin of :func:`randomness` for each row of ``codes``; p-values fall with z, so bins are found by limits of z."""
    m, n = codes.shape
    if n < 8:
        return np.full(m, spec.bins - 1)
    p = [10 ** (-b / spec.bins_per_decade) / 3 for b in range(1, spec.bins)]
    one_sided, two_sided = (np.array([-NormalDist().inv_cdf(x / k) for x in p]) for k in (1, 2))
    cells = max(2, min(size, 1 << max(1, (n // 4).bit_length() - 1)))
    cell = np.arange(size) * cells // size
    counts = np.bincount((np.arange(m)[:, None] * cells + cell[codes]).ravel(), minlength=m * cells).reshape(m, cells)
    df = cells - 1
    x = (counts * counts) @ (size / n / np.bincount(cell, minlength=cells)) - n
    z = (np.cbrt(np.maximum(x, 0) / df) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    out = np.searchsorted(one_sided, z, "right")
    same = min(spec.bins - 1, int(-math.log10(min(1.0, 3 * 0.5 ** (n - 1))) * spec.bins_per_decade))
    up = 2 * codes.astype(np.int16) >= size
    a = up.sum(1)
    mean = 2 * a * (n - a) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    seen = 1 + (up[:, 1:] != up[:, :-1]).sum(1)
    z = np.abs(seen - mean) / np.sqrt(np.where(var > 0, var, np.inf))
    out = np.maximum(out, np.where((a == 0) | (a == n), same, np.searchsorted(two_sided, z, "right")))
    # Sums of products of codes are whole numbers below 2**24, which float32 holds exactly.
    c = codes.astype(np.float32)
    s, squares, pairs = c.sum(1).astype(float), np.einsum("ij,ij->i", c, c).astype(float), np.einsum("ij,ij->i", c[:, 1:], c[:, :-1]).astype(float)
    mean = s / n
    total = squares - s * mean
    flat = n * squares == s * s
    r = (pairs - mean * (2 * s - c[:, 0] - c[:, -1]) + (n - 1) * mean * mean) / np.where(flat, 1, total)
    z = np.abs(r + 1 / n) * math.sqrt(n)
    return np.maximum(out, np.where(flat, same, np.searchsorted(two_sided, z, "right")))


class OrdinaryCounts:
    """Counts of ordinary strings by (encoding, length class, bin), summed over the texts of a task.

    A text's ordinary letters are all its ASCII letters outside the strings that are tested or found by pattern.
    For each length class they are cut into strings one behind the other, so all of a text counts, by its length.
    """

    def __init__(self, spec: SecretSpec):
        self.spec, self.counts = spec, np.zeros((len(_ALPHABETS), len(spec.lengths), spec.bins), np.int64)
        self._waiting, self._size = [], 0

    def add(self, text: str, tested: Iterable[tuple[int, int]]) -> None:
        codes = _LETTER_CODES[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
        for s, e in tested:
            codes[s:e] = 255
        codes = codes[codes != 255]
        self._waiting.append(codes)
        self._size += len(codes)
        if self._size >= 1 << 18 or len(self._waiting) >= 1 << 12:
            self.flush()

    def flush(self) -> None:
        for k, n in enumerate(self.spec.lengths):
            rows = [c[: len(c) // n * n] for c in self._waiting]
            rows = np.concatenate(rows).reshape(-1, n) if rows else np.empty((0, n), np.uint8)
            for i in range(0, len(rows), 1 << 12):
                part = rows[i : i + (1 << 12)]
                own = encodings(part)
                for e, (name, _, _, size) in enumerate(_ALPHABETS):
                    of = part[own == e]
                    if len(of):
                        codes = np.where(of < 26, of, of - 26) + 10 if name in ("hex", "base36") else of
                        self.counts[e, k] += np.bincount(bins_of_rows(codes, size, self.spec), minlength=self.spec.bins)
        self._waiting, self._size = [], 0


_SCAN = "doc_id long, base array<struct<start:int,kind:int,end:int>>, found array<struct<start:int,end:int,class:int,bin:int>>, ordinary array<struct<cell:int,n:long>>"


def scan(docs: DataFrame, spec: SecretSpec) -> DataFrame:
    """A row for each text, and for each task one with null ``base`` that holds the task's counts of ordinary strings."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    cand = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("class", pa.int32()), ("bin", pa.int32())]))
    cells = pa.list_(pa.struct([("cell", pa.int32()), ("n", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("base", span), ("found", cand), ("ordinary", cells)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        null = OrdinaryCounts(spec)

        def row(doc_id, text):
            text = text or ""
            base = base_spans(text)
            found = candidates(text, base, spec)
            null.add(text, [(s, e) for s, _, e in base] + [(s, e) for s, e, *_ in found])
            return doc_id, [dict(zip(("start", "kind", "end"), x, strict=True)) for x in base], [dict(zip(("start", "end", "class", "bin"), x, strict=True)) for x in found], None

        yield from per_row(schema, lambda: row)(batches)
        null.flush()
        counts = null.counts.ravel()
        own = [{"cell": int(i), "n": int(counts[i])} for i in counts.nonzero()[0]]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, None, None, own), schema.types, strict=True)], schema=schema)

    return docs.mapInArrow(run, _SCAN)


def last_bins(null_counts: dict[int, int], found: dict[tuple[int, int], int], spec: SecretSpec, n_encodings: int = 1) -> list[int]:
    """For each class (encoding * length classes + length class) the last bin that is a discovery, -1 for none.

    A weighted Benjamini-Hochberg rule: a candidate's p-value is the share of ordinary strings of its encoding and
    length class that pass for random at least as well. Longer strings are told apart better, so p-values are
    divided by a weight in proportion to the length class (mean 1 over the candidates) before the step-up rule
    runs over all of them. Cells of ``null_counts`` are class * bins + bin.
    """
    lengths, bins = len(spec.lengths), spec.bins
    k = lengths * n_encodings
    null = np.zeros((n_encodings, lengths, bins))
    for cell, n in null_counts.items():
        null.reshape(k, bins)[cell // bins, cell % bins] += n
    every = null.sum(0)
    for own in (*null, every):
        for c in range(1, lengths):
            if own[c].sum() < spec.least_null:
                own[c] += own[c - 1]
    null = np.where(null.sum(2, keepdims=True) < spec.least_null, every, null).reshape(k, bins)
    p = (1 + np.cumsum(null, 1)) / (1 + null.sum(1, keepdims=True))
    seen = np.zeros((k, bins))
    for (c, b), n in found.items():
        seen[c, b] += n
    m = seen.sum()
    if not m:
        return [-1] * k
    weight = np.tile(np.array(spec.lengths, float), n_encodings)
    weight /= (weight * seen.sum(1)).sum() / m
    q = (p / weight[:, None]).ravel()
    order = np.argsort(q, kind="stable")
    rank = np.cumsum(seen.ravel()[order])
    passed = np.flatnonzero((q[order] <= spec.rate * rank / m) & (seen.ravel()[order] > 0))
    if not len(passed):
        return [-1] * k
    cut = q[order][passed[-1]]
    most = _bin(spec.level, spec)
    return [int((row[:most] <= cut).nonzero()[0].max(initial=-1)) for row in q.reshape(k, bins)]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: SecretSpec = SecretSpec()) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row; ``spans`` is ``kind:start:end,...``.

    Fixed patterns find ``assign``, ``access`` and ``hex`` spans. Other strings of at least 20 letters and digits
    are tested for randomness. The null is how ordinary letters pass the same tests: all letters of every row
    that are not in a tested or fixed-pattern string, in strings of each length class one behind the other, each in the
    smallest alphabet that it fits. Null and tests are counted over all rows in a table of (encoding, length
    class, bin) cells, which is bounded, and the strings whose discovery survives the false-discovery rule are added as
    ``random``. Offsets are code points, ends exclusive. Null counts as empty; a text without spans has the
    digest of the empty string. Repeated rows give a row each and count each; an empty table gives an empty one.
    Other columns are not read.
    """
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    scanned = stored(scan(docs, spec), "secret-scan")
    null = {r[0]: r[1] for r in scanned.select(F.explode("ordinary").alias("x")).groupBy("x.cell").agg(F.sum("x.n")).collect()}
    found = {(r[0], r[1]): r[2] for r in scanned.select(F.explode("found").alias("x")).groupBy("x.class", "x.bin").count().collect()}
    last = F.array(*map(F.lit, last_bins(null, found, spec, len(_ALPHABETS))))
    kinds = F.array(*map(F.lit, KINDS))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
    added = F.transform(
        F.filter("found", lambda x: x["bin"] <= F.get(last, x["class"])),
        lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), x["end"].alias("end")),
    )
    return scanned.where("base IS NOT NULL").select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", added))).alias("spans"),
    )


def op7_randomness_battery(spark, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))

"""Language ID: a linear-chain conditional random field labels the words of (code-switched) texts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.llm._text import documents, mixed, per_row

_WORD = re.compile(r"[^\W\d_]+")
_GRAMS = (1, 2, 3, 4)
_AFFIXES = (1, 2, 3, 4)


@dataclass(frozen=True)
class LanguageSpec:
    """The model is fitted on a bounded sample: ``per_language`` labelled rows of each language, ``max_rows`` in
    all, and of each row ``max_words`` words (their first ``max_letters`` letters) from a place drawn for it. Everything
    else reads whole texts.

    ``buckets``: weights a label; ``length``: words of a training sequence; ``switched``: share of sequences that
    are spliced from texts of different languages, ``span`` words at a time; ``known``: a word is in a language's
    lexicon if the sample has it ``known`` times and nine times in ten in that language.
    """

    per_language: int = 400
    max_rows: int = 4000
    max_words: int = 160
    max_letters: int = 64
    buckets: int = 1 << 16
    length: int = 40
    switched: float = 0.4
    span: int = 12
    known: int = 3
    epochs: int = 6
    batch: int = 128
    rate: float = 0.3
    seed: int = 11


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; none if the text has no letter."""
    words = _WORD.findall(text.lower()) if text else []
    return words if any(w.isalpha() or any(map(str.isalpha, w)) for w in words) else []


def features(words: list[str], lexicon: dict[str, int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bucket, start)``: hashed features of all words in one array, and where each word's begin.

    n-grams of 1 to 4 bytes of ``^word$``, prefixes and suffixes of 1 to 4 bytes, the word itself, and the
    language whose lexicon has it.
    """
    n = len(words)
    raw = [b"^" + w.encode() + b"$" for w in words]
    size = np.fromiter(map(len, raw), np.int64, n)
    data = np.frombuffer(b"".join(raw) + bytes(8), np.uint8).astype(np.uint64)
    end = np.cumsum(size)
    begin = end - size
    owner = np.repeat(np.arange(n), size)
    left = end[owner] - np.arange(len(owner))
    code = np.zeros(len(owner), np.uint64)
    whole = np.zeros(n, np.uint64)
    found, who = [], []
    for k in range(1, max(_GRAMS) + 1):
        code = code * np.uint64(257) + data[k - 1 : k - 1 + len(owner)] + np.uint64(1)
        ok = np.flatnonzero(left >= k)
        found.append(code[ok] * np.uint64(16) + np.uint64(k))
        who.append(owner[ok])
    for k in _AFFIXES:
        ok = np.flatnonzero(size >= k + 2)
        head = sum(data[begin[ok] + 1 + i] * np.uint64(257**i) for i in range(k))
        tail = sum(data[end[ok] - 2 - i] * np.uint64(257**i) for i in range(k))
        found += [head * np.uint64(16) + np.uint64(4 + k), tail * np.uint64(16) + np.uint64(8 + k)]
        who += [ok, ok]
    place = np.arange(len(owner)) - begin[owner]
    np.add.at(whole, owner, mixed(data[: len(owner)] + place.astype(np.uint64) * np.uint64(65537)))
    member = np.fromiter((lexicon.get(w, -1) + 1 for w in words), np.uint64, n)
    found += [whole * np.uint64(16) + np.uint64(13), member * np.uint64(16) + np.uint64(14)]
    who += [np.arange(n), np.arange(n)]
    who_all = np.concatenate(who)
    order = np.argsort(who_all, kind="stable")
    bucket = (mixed(np.concatenate(found)) % np.uint64(buckets)).astype(np.int64)[order]
    return bucket, np.searchsorted(who_all[order], np.arange(n))


@dataclass
class Model:
    """``weights`` (bucket, label) and ``moves`` (label, next label), both logarithmic."""

    labels: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.labels)), np.float32)
        bucket, start = features(words, self.lexicon, len(self.weights))
        return np.add.reduceat(self.weights[bucket], start).astype(np.float32)


def _norm(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def marginals(emit: np.ndarray, lengths: np.ndarray, moves: np.ndarray, segment: int = 64) -> np.ndarray:
    """Label probabilities of every word by forward-backward; ``emit`` holds the sequences one after the other.

    Sequences are cut in segments, whose transfer matrices carry the messages across; so all segments of a batch
    run side by side, the result is that of whole sequences, and the number of steps is bounded. The label
    before the first word is uniform.
    """
    k, n = emit.shape[1], len(emit)
    if not n:
        return emit
    lengths = lengths[lengths > 0]
    e = np.exp(emit - emit.max(1, keepdims=True))
    t = np.exp(moves - moves.max()).astype(np.float32)
    segs = -(-lengths // segment)
    doc = np.repeat(np.arange(len(lengths)), segs)
    index = np.arange(len(doc)) - np.repeat(np.cumsum(segs) - segs, segs)
    size = np.minimum(segment, lengths[doc] - index * segment)
    at = np.cumsum(size) - size
    steps = np.arange(segment)
    inside = steps[None, :] < size[:, None]
    slot = np.where(inside, at[:, None] + steps[None, :], 0)
    x = e[slot]
    start = np.full((len(doc), k), 1 / k, np.float32)
    stop = np.full((len(doc), k), 1 / k, np.float32)
    if len(doc) > len(lengths):
        m = np.broadcast_to(np.eye(k, dtype=np.float32), (len(doc), k, k)).copy()
        for i in steps:
            m = np.where(inside[:, i, None, None], (m @ t) * x[:, i, None, :], m)
            m /= m.sum((1, 2), keepdims=True)
        for j in range(1, int(segs.max())):
            now = np.flatnonzero(index == j)
            start[now] = _norm(np.einsum("ij,ijk->ik", start[now - 1], m[now - 1]))
        for j in range(int(segs.max()) - 2, -1, -1):
            now = np.flatnonzero((index == j) & (j < segs[doc] - 1))
            stop[now] = _norm(np.einsum("ijk,ik->ij", m[now + 1], stop[now + 1]))
    out = np.empty_like(x)
    a = start
    for i in steps:
        a = np.where(inside[:, i, None], _norm((a @ t) * x[:, i]), a)
        out[:, i] = a
    b = stop
    for i in steps[::-1]:
        out[:, i] = out[:, i] * b
        b = np.where(inside[:, i, None], _norm((b * x[:, i]) @ t.T), b)
    return _norm(out[inside])


def _sequences(rows: list[tuple[list[str], int]], spec: LanguageSpec, rng: np.random.Generator) -> tuple[list[str], np.ndarray]:
    """Training words and labels, ``length`` to a sequence: stretches of one text, and splices of several languages."""
    words, labels = [], []
    by_label: dict[int, list[list[str]]] = {}
    for w, y in rows:
        by_label.setdefault(y, []).append(w)
        for at in range(0, len(w) - spec.length + 1, spec.length):
            words += w[at : at + spec.length]
            labels += [y] * spec.length
    kinds = sorted(by_label)
    for _ in range(int(spec.switched / (1 - spec.switched) * len(labels) / spec.length)):
        line: list[str] = []
        tags: list[int] = []
        while len(line) < spec.length:
            y = kinds[rng.integers(len(kinds))]
            w = by_label[y][rng.integers(len(by_label[y]))]
            k = int(rng.integers(1, 2 * spec.span))
            at = int(rng.integers(max(1, len(w) - k)))
            line += w[at : at + k]
            tags += [y] * len(w[at : at + k])
        words += line[: spec.length]
        labels += tags[: spec.length]
    return words, np.array(labels)


def fit(rows: list[tuple[str, str]], spec: LanguageSpec = LanguageSpec()) -> Model:
    """A model from ``(text, language)`` rows, by Adagrad on the log-likelihood of whole sequences."""
    rng = np.random.default_rng(spec.seed)
    names = sorted({y for _, y in rows})
    number = {y: i for i, y in enumerate(names)}
    sample = []
    for text, y in rows:
        w = words_of(text)
        at = int(rng.integers(max(1, len(w) - spec.max_words + 1)))
        if w:
            sample.append((w[at : at + spec.max_words], number[y]))
    counts = Counter((w, y) for ws, y in sample for w in ws)
    totals: Counter[str] = Counter()
    for (w, _), c in counts.items():
        totals[w] += c
    lexicon = {w: y for (w, y), c in counts.items() if totals[w] >= spec.known and 10 * c >= 9 * totals[w]}
    k = len(names)
    model = Model(names, lexicon, np.zeros((spec.buckets, k), np.float32), np.zeros((k, k), np.float32))
    if k < 2 or not sample:
        return model
    words, labels = _sequences(sample, spec, rng)
    if not words:
        words, labels = [w for ws, _ in sample for w in ws], np.repeat([y for _, y in sample], [len(ws) for ws, _ in sample])
    n = len(words) // spec.length
    length = spec.length if n else len(words)
    n = max(1, n)
    words, labels = words[: n * length], labels[: n * length].reshape(n, length)
    distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
    bucket, start = features(list(distinct), lexicon, spec.buckets)
    stop = np.r_[start[1:], len(bucket)]
    ids = np.fromiter((distinct[w] for w in words), np.int64, len(words)).reshape(n, length)
    g_w, g_m = np.full_like(model.weights, 1e-6), np.full_like(model.moves, 1e-6)
    for _ in range(spec.epochs):
        order = rng.permutation(n)
        for lo in range(0, n, spec.batch):
            at = order[lo : lo + spec.batch]
            word, back = np.unique(ids[at].ravel(), return_inverse=True)
            sizes = stop[word] - start[word]
            flat = bucket[np.repeat(start[word] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            emit = np.add.reduceat(model.weights[flat], np.cumsum(sizes) - sizes)[back].reshape(len(at), length, k)
            d_emit, d_moves = _gradient(emit, model.moves, labels[at])
            by_word = np.stack([np.bincount(back, d_emit[..., y].ravel(), len(word)) for y in range(k)], 1)
            by_feature = np.repeat(by_word, sizes, 0)
            touched, where = np.unique(flat, return_inverse=True)
            d_w = np.stack([np.bincount(where, by_feature[:, y], len(touched)) for y in range(k)], 1) / len(at)
            g_w[touched] += d_w**2
            model.weights[touched] -= spec.rate * d_w / np.sqrt(g_w[touched])
            d_m = d_moves / len(at)
            g_m += d_m**2
            model.moves -= spec.rate * d_m / np.sqrt(g_m)
    return model


def _gradient(emit: np.ndarray, moves: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the negative log-likelihood by emissions and moves, for sequences of one length."""
    b, n, k = emit.shape
    e = np.exp(emit - emit.max(2, keepdims=True))
    t = np.exp(moves - moves.max())
    alpha, beta = np.empty_like(e), np.empty_like(e)
    a = np.full((b, k), 1 / k)
    for i in range(n):
        alpha[:, i] = a = _norm((a @ t) * e[:, i])
    z = np.full((b, k), 1 / k)
    for i in range(n - 1, -1, -1):
        beta[:, i] = z
        z = _norm((z * e[:, i]) @ t.T)
    own = _norm(alpha * beta)
    pair = alpha[:, :-1, :, None] * t * (e * beta)[:, 1:, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    d_moves = pair.sum((0, 1))
    np.subtract.at(d_moves, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), 1)
    np.subtract.at(own, (np.arange(b)[:, None], np.arange(n)[None, :], labels), 1)
    return own, d_moves


class Labeller:
    """Word probabilities for texts; emissions of words are kept up to a fixed number."""

    def __init__(self, model: Model, keep: int = 300_000) -> None:
        self.model, self.keep = model, keep
        self.rows: dict[str, int] = {}
        self.table = np.empty((0, len(model.labels)), np.float32)
        self.used = 0

    def emissions(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > self.keep:
            self.rows, self.used = {}, 0
        new = [w for w in dict.fromkeys(words) if w not in self.rows]
        if new:
            got = self.model.emissions(new)
            need = self.used + len(new)
            if need > len(self.table):
                self.table = np.concatenate([self.table[: self.used], np.empty((need, self.table.shape[1]), np.float32)])
            self.table[self.used : need] = got
            self.rows.update(zip(new, range(self.used, need), strict=True))
            self.used = need
        return self.table[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))]

    def __call__(self, texts: list[list[str]]) -> np.ndarray:
        """Probabilities of all words of ``texts``, one after the other."""
        return marginals(self.emissions([w for t in texts for w in t]), np.array([len(t) for t in texts]), self.model.moves)


def _grouped(texts: list[str | None], most: int = 200_000) -> Iterator[tuple[int, list[list[str]]]]:
    """Consecutive texts as words, up to ``most`` words at a time; a longer text is a group of its own."""
    held: list[list[str]] = []
    n = first = 0
    for i, text in enumerate(texts):
        words = words_of(text)
        if held and n + len(words) > most:
            yield first, held
            held, n, first = [], 0, i
        held.append(words)
        n += len(words)
    if held:
        yield first, held


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, spec: LanguageSpec) -> list[tuple[str, str]]:
    """``(text, lang)`` of a bounded sample of the rows that may be learned from, drawn by a hash of the id.

    The first rows by hash are taken from each of 64 parts of a language and then from the language, so no task
    ranks more than a part's rows. Texts are cut to their ``max_words`` words by the tasks that read them, so the driver gets
    at most ``max_rows * max_words`` words of ``max_letters`` letters. Of the rows of one id, the first by text is taken.
    """
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    rows = usable.select("doc_id", "lang", F.pmod(F.hash("doc_id"), F.lit(64)).alias("part"))
    first = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("rank") <= spec.per_language)
    picked = first(first(rows, "lang", "part"), "lang")
    ids = [r[0] for r in picked.orderBy("rank", "lang").limit(spec.max_rows).collect()]
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("text", pa.string())])

    def make() -> Callable:
        def row(doc_id, lang, text):
            words = words_of(text)
            at = int(np.random.default_rng([spec.seed, doc_id % 2**63]).integers(max(1, len(words) - spec.max_words + 1)))
            return doc_id, lang, " ".join(w[: spec.max_letters] for w in words[at : at + spec.max_words])

        return row

    cut = usable.where(F.col("doc_id").isin(ids)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").mapInArrow(per_row(schema, make), "doc_id long, lang string, text string")
    rows = cut.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r")).select("doc_id", "r.text", "r.lang").collect()
    return [(r[1], r[2]) for r in sorted(rows, key=lambda r: r[0])]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, from the whole text alone.

    ``lang_pred`` is the language with the largest mean probability over the words, the first by name among
    equals, ``score`` that mean. Null texts and texts without a letter, and all texts if the model knows no
    language, get ``und`` and 0. Repeated rows give a row each; an empty table gives an empty one; other columns
    are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
    names = np.array(model.labels or ["und"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labeller(model)
        for batch in batches:
            pred, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            for first, texts in _grouped(batch.column(2).to_pylist()):
                sizes = np.array([len(t) for t in texts])
                some = np.flatnonzero(sizes)
                if len(some) and model.labels:
                    p = np.add.reduceat(label(texts).astype(np.float64), (np.cumsum(sizes) - sizes)[some])
                    p /= sizes[some][:, None]
                    best = p.argmax(1)
                    pred[first + some], score[first + some] = names[best], p.max(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1))], schema=schema)

    own = docs.select(docs[id_col].cast("long").alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def label_words(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, words``: for each word of the text ``(word, lang, p)``; no words for null texts or without letters."""
    word = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("p", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("words", word)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labeller(model)
        for batch in batches:
            for first, texts in _grouped(batch.column(1).to_pylist()):
                p = label(texts)
                at, out = 0, []
                for t in texts:
                    own = p[at : at + len(t)]
                    at += len(t)
                    out.append([{"word": w, "lang": model.labels[int(q.argmax())], "p": float(q.max())} for w, q in zip(t, own, strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column(0)[first : first + len(texts)], pa.array(out, word)], schema=schema)

    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, words array<struct<word:string,lang:string,p:double>>")


def op1_word_crf(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, fit(training_rows(docs, LanguageSpec())))

"""Sequences for training: each seed document's window is filled with its BM25 neighbours from a sharded inverted index."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm._text import documents, slices
from rangeloom.llm.bpe import vocabulary
from rangeloom.shared import stored

VOCABULARY = "word_bpe_49k.json"
#: Characters of which lower case and classes are known one by one: ASCII, and the letters up to U+017F but for the dotted I.
_KNOWN = r"\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_LETTERS = r"a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
#: The pattern that splits text before the merges, as published with the vocabulary (fixed value), on those characters.
_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+"
_SHORT = 64
_CACHE = 1_000_000
_TOGETHER = 256


@dataclass(frozen=True)
class PackSpec:
    """``window`` tokens a sequence; ``end`` follows each document; ``k1`` and ``b`` of BM25.

    A shard holds documents of about ``shard_load`` tokens, each counted with ``doc_load`` more, so that the index of a
    shard is bounded in documents too. ``least_df``: documents that a term must stand in to name a shard.
    """

    window: int = 2048
    end: int = 1
    k1: float = 1.2
    b: float = 0.75
    shard_load: int = 1 << 20
    doc_load: int = 256
    least_df: int = 8


class WordTokenizer:
    """Ids of whole texts by the library, a word at a time: what stands between ASCII white space is encoded once and kept.

    The vocabulary's pattern drops white space and its normalizers do not reach across it, so a text's ids are its words'
    ids in turn. Texts of ASCII and of letters with their marks composed (up to U+017F) are put in lower case here, and their
    words are cut by the pattern: on those characters the normalizers change nothing else and the pattern's classes are
    known. Their new pieces go to the library many at a time, with blanks between; a piece's last token is one that ends a
    word. Words of other texts are encoded one by one. Words and pieces above 64 bytes are not kept; others up to a fixed number.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # The same merges for pieces that are cut already: blanks part them, bytes become letters.
        spec |= {"normalizer": None, "truncation": None, "padding": None, "added_tokens": []}
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "ByteLevel")]}
        self.merges = Tokenizer.from_str(json.dumps(spec))
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.size = len(vocabulary)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known_characters = re.compile(f"[{_KNOWN}]*").fullmatch
        self.cut = re.compile(_PIECES, re.ASCII).findall
        self.pieces: dict[str, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.others: dict[bytes, bytes] = {}

    def _simple(self, text: str) -> bool:
        return (text.isascii() or self.known_characters(text) is not None) and not any(x in text for x in self.special)

    def _each(self, words: list[bytes]) -> list[bytes]:
        return [np.array(x.ids, self.kind).tobytes() for x in self.library.encode_batch([w.decode() for w in words], add_special_tokens=False)]

    def _by_pieces(self, words: list[str]) -> list[bytes]:
        cut = [self.cut(w) for w in words]
        every = list(set().union(*cut))
        known = dict(zip(every, _ids(self.pieces, every, self._merged), strict=True))
        return [b"".join(map(known.__getitem__, own)) for own in cut]

    def _merged(self, pieces: list[str]) -> list[bytes]:
        groups = [pieces[at : at + _TOGETHER] for at in range(0, len(pieces), _TOGETHER)]
        out, width = [], self.kind.itemsize
        for own, found in zip(groups, self.merges.encode_batch_fast([" ".join(own) for own in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, self.kind)
            end = np.flatnonzero(self.ends[ids]) + 1
            if len(end) != len(own):
                raise ValueError("the vocabulary's tokens do not tell where a piece ends")
            data = ids.tobytes()
            out += [data[i * width : j * width] for i, j in zip([0, *end[:-1].tolist()], end.tolist(), strict=True)]
        return out

    def encode(self, texts: pa.StringArray, end: int) -> tuple[pa.BinaryArray, np.ndarray]:
        """The ids of each text and ``end``, as bytes, and the places of the texts, which come in another order."""
        simple = np.array([self._simple(x) for x in texts.to_pylist()], bool)
        last = np.array([end], self.kind).tobytes()
        words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.utf8_lower(texts.filter(pa.array(simple)))))
        # A text without words comes as one empty word.
        coded = pc.dictionary_encode(words.flatten())
        distinct = coded.dictionary.to_pylist()
        ids = [*_ids(self.words, distinct, self._by_pieces), last]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        first = np.append(0, np.cumsum(size)[:-1])
        ends = words.offsets.to_numpy()[1:] - words.offsets.to_numpy()[0]
        word = np.insert(coded.indices.to_numpy(), ends, len(distinct))
        n = size[word]
        upto = np.cumsum(n)
        data = np.frombuffer(b"".join(ids), self.kind)[np.repeat(first[word] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]
        offsets = np.append(0, upto[ends + np.arange(len(ends))] * self.kind.itemsize).astype(np.int32)
        plain = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        if simple.all():
            return plain, np.arange(len(texts))
        cut = [x.encode().split() for x in texts.filter(pa.array(~simple)).to_pylist()]
        every = list(set().union(*cut))
        known = dict(zip(every, _ids(self.others, every, self._each), strict=True))
        others = pa.array([b"".join(map(known.__getitem__, c)) + last for c in cut], pa.binary())
        return pa.concat_arrays([plain, others]), np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])


def _ids(known: dict, things: list, encode: Callable[[list], list[bytes]]) -> list[bytes]:
    """The ids of distinct ``things``, of which the short ones are in ``known`` from now on."""
    found = list(map(known.get, things))
    if new := [i for i, x in enumerate(found) if x is None]:
        if len(known) + len(new) > _CACHE:
            known.clear()
        for i, x in zip(new, encode([things[i] for i in new]), strict=True):
            found[i] = x
            if len(things[i]) <= _SHORT:
                known[things[i]] = x
    return found


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One per worker and vocabulary file."""
    return WordTokenizer(path)


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = 1) -> DataFrame:
    """``doc_id, n, ids binary`` of every row: its ids and ``end``, as little-endian integers of the vocabulary's width.

    A null text has only ``end``. ``path``: the vocabulary file, on every executor; None: the one of the executor's own package.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path or vocabulary(VOCABULARY))
        for batch in (part for batch in batches for part in slices(batch)):
            ids, place = t.encode(pc.fill_null(batch.column(1), ""), end)
            n = pc.divide(pc.binary_length(ids), t.kind.itemsize).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place)), n, ids], names=["doc_id", "n", "ids"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, ids binary")


def _starts(own: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the length."""
    new = np.ones(len(own) + 1, bool)
    np.not_equal(own[1:], own[:-1], out=new[1:-1])
    return np.flatnonzero(new) if len(own) else np.zeros(1, np.int64)


@dataclass(frozen=True)
class Corpus:
    """Statistics over all documents: their number, mean length, and each term's inverse document frequency.

    ``idf`` is ``ln((N - df + 0.5) / (df + 0.5))``; terms in half of the documents or more have none and are not indexed.
    ``names`` has it for the terms that may name a shard, else 0. A number for each entry of the vocabulary.
    """

    docs: int
    mean: float
    idf: np.ndarray
    names: np.ndarray
    spec: PackSpec

    def terms(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct indexed terms of a document (its end is none), ascending, and their BM25 weights."""
        own = np.sort(ids[:-1], kind="stable")  # by radix, as ids have 16 bits
        at = _starts(own)
        term, tf = own[at[:-1]], at[1:] - at[:-1]
        use = self.idf[term] > 0
        term, tf = term[use], tf[use]
        s = self.spec
        return term, self.idf[term] * (tf * (s.k1 + 1) / (tf + s.k1 * (1 - s.b + s.b * (len(ids) / self.mean))))

    def name(self, ids: np.ndarray) -> int:
        """The rarest indexed term that may name a shard, of ties the first in the text; the vocabulary's size if there is none."""
        own = self.names[ids[:-1]]
        at = int(own.argmax()) if len(own) else 0
        return int(ids[at]) if len(own) and own[at] > 0 else len(self.idf)


def corpus(rows: DataFrame, size: int, kind: np.dtype, spec: PackSpec) -> Corpus:
    """Counted over all of :func:`tokens`'s ``rows``: a task leaves a count for each term, at most the vocabulary comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                own = np.sort(np.frombuffer(ids, kind)[:-1], kind="stable")
                df[own[_starts(own)[:-1]]] += 1
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], names=["term", "df"])

    counts = rows.select("ids").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[counts["term"].to_numpy()] = counts["df"].to_numpy()
    docs, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    idf = np.log((docs - df + 0.5) / (df + 0.5))
    return Corpus(docs, total / max(docs, 1), idf, np.where(df >= spec.least_df, np.maximum(idf, 0), 0), spec)


def _placement(rows: DataFrame, c: Corpus, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """For each shard name its first shard and the number of its shards; small names share one.

    A task leaves a load for each name, so at most the vocabulary comes back. A name that many documents have gets
    as many shards as its load asks for.
    """
    spec, size = c.spec, len(c.idf) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                own = np.frombuffer(ids, kind)
                load[c.name(own)] += len(own) + spec.doc_load
        name = np.flatnonzero(load)
        yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(load[name])], names=["name", "load"])

    found = rows.select("ids").mapInArrow(run, "name long, load long").groupBy("name").agg(F.sum("load").alias("load")).toArrow()
    first, count, shard, room = np.zeros(size, np.int64), np.ones(size, np.int64), -1, 0
    for name, load in sorted(zip(found["name"].to_pylist(), found["load"].to_pylist(), strict=True)):
        k = -(-load // spec.shard_load)
        if k == 1 and load <= room:
            first[name], room = shard, room - load
        else:
            first[name], count[name] = shard + 1, k
            shard, room = shard + k, (spec.shard_load - load if k == 1 else 0)
    return first, count


class ShardIndex:
    """Inverted index over the documents of a shard."""

    def __init__(self, docs: list[np.ndarray], c: Corpus) -> None:
        self.own = [c.terms(ids) for ids in docs]
        sizes = [len(t) for t, _ in self.own]
        term = np.concatenate([t for t, _ in self.own]) if docs else np.empty(0, np.int64)
        order = np.argsort(term, kind="stable")
        self.doc = np.repeat(np.arange(len(docs)), sizes)[order]
        self.weight = (np.concatenate([w for _, w in self.own]) if docs else np.empty(0))[order]
        self.term, self.start = np.unique(term[order], return_index=True)
        self.end = np.append(self.start[1:], len(order))

    def scores(self, i: int) -> np.ndarray:
        """BM25 of every document for document ``i``'s terms, each asked for once; sums by ascending term."""
        at = np.searchsorted(self.term, self.own[i][0])
        lo, n = self.start[at], self.end[at] - self.start[at]
        place = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        return np.bincount(self.doc[place], self.weight[place], minlength=len(self.own))


def pack(docs: list[np.ndarray], c: Corpus) -> list[tuple[int, int, int, int, int, float | None]]:
    """Pieces ``(document, start, length, sequence, offset, score)`` of a shard's documents.

    A document's full windows are sequences of their own. What is left of it waits to be used: the first unused document
    is a seed, and its window takes unused documents by falling score (of ties, and without a common term, the earlier
    one); the one that does not fit whole is cut, and the rest of it is the next seed. When no document is left, the last
    window is cut at its binary digits, so no sequence is padded. ``score`` is null for seeds and full windows.
    """
    window, out, sequence = c.spec.window, [], 0
    start, left = np.zeros(len(docs), np.int64), np.array([len(x) for x in docs], np.int64)
    for i, n in enumerate(left.tolist()):
        for at in range(0, n - window + 1, window):
            out.append((i, at, window, sequence, 0, None))
            sequence += 1
    start, left = left // window * window, left % window
    index, unused, following, first = ShardIndex(docs, c), left > 0, None, 0
    while following is not None or unused[first:].any():
        if following is None:
            first += int(unused[first:].argmax())
        seed = first if following is None else following
        scores, pieces, used, following = index.scores(seed), [(seed, None)], 0, None
        unused[seed] = False
        there = np.flatnonzero(unused)
        # A window takes few documents: the best ones are sorted first, all of them only where those do not fill it.
        few = 64
        if len(there) > few:
            worst = np.partition(scores[there], -few)[-few]
            top = there[scores[there] > worst]
            top = np.concatenate([top, there[scores[there] == worst]]) if left[top].sum() + left[seed] < window else top
            there = top if left[top].sum() + left[seed] >= window else there
        there = there[np.lexsort((there, -scores[there]))]
        took = []
        for i, score in [(seed, None), *zip(there.tolist(), scores[there].tolist(), strict=True)]:
            n = min(int(left[i]), window - used)
            took.append((i, int(start[i]), n, used, score))
            start[i], left[i], used = start[i] + n, left[i] - n, used + n
            unused[i] = False
            if left[i]:
                following = i
            if used == window:
                break
        for cut in [window] if used == window else _digits(used):
            took, rest = _split(took, cut)
            out += [(i, at, n, sequence, offset, score) for i, at, n, offset, score in took]
            took, sequence = rest, sequence + 1
    return out


def _digits(n: int) -> list[int]:
    """The powers of two that ``n`` is the sum of, falling."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def _split(pieces: list[tuple], at: int) -> tuple[list[tuple], list[tuple]]:
    """Pieces ``(document, start, length, offset, score)`` before token ``at`` of their sequence, and those behind it from offset 0."""
    before, behind = [], []
    for i, start, n, offset, score in pieces:
        here = max(0, min(n, at - offset))
        if here:
            before.append((i, start, here, offset, score))
        if here < n:
            behind.append((i, start + here, n - here, offset + here - at, score))
    return before, behind


_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, score double"
_OUT_TYPES = pa.schema([(x.split()[0], pa.float64() if x.endswith("double") else pa.int64()) for x in _OUT.split(", ")])


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, spec: PackSpec = PackSpec()) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, score`` of every piece of every row.

    Every row is a document, also one that repeats another or has a null id; a null text counts as empty and is one token. Statistics
    are counted over all documents. A document's heaviest term names its shard; names of much load have many shards, over
    which a hash of the row deals their documents, and a task holds one shard at a time. Sequence numbers are unique, not dense.
    Tokens are written once, with a number for each row, so every later pass sees the same rows. An empty table gives no piece.
    """
    t = tokenizer(path or vocabulary(VOCABULARY))
    kind = t.kind
    rows = stored(tokens(docs, id_col, text_col, path, spec.end).withColumn("row", F.monotonically_increasing_id()), "tokens")
    c = corpus(rows, t.size, kind, spec)
    first, count = _placement(rows, c, kind)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = []
            for ids, row in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = c.name(np.frombuffer(ids, kind))
                shard.append(int(first[name]) + xxhash.xxh3_64_intdigest(row.to_bytes(8, "little")) % int(count[name]))
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), *batch.columns], names=["shard", "doc_id", "row", "ids"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, names = None, [], []
        for batch in batches:
            for shard, doc_id, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if shard != at and own:
                    yield _sequences(at, names, own, c)
                    own, names = [], []
                at = shard
                names.append(doc_id)
                own.append(np.frombuffer(ids, kind))
        if own:
            yield _sequences(at, names, own, c)

    dealt = rows.select("doc_id", "row", "ids").mapInArrow(deal, "shard long, doc_id long, row long, ids binary")
    return dealt.repartition("shard").sortWithinPartitions("shard", "row").select("shard", "doc_id", "ids").mapInArrow(fill, _OUT)


def _sequences(shard: int, names: list[int], docs: list[np.ndarray], c: Corpus) -> pa.RecordBatch:
    rows = [(names[i], at, n, zlib.crc32(docs[i][at : at + n].astype("<u4").tobytes()), len(docs[i]), shard << 32 | s, offset, score) for i, at, n, s, offset, score in pack(docs, c)]
    return pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(zip(*rows, strict=True), _OUT_TYPES.types, strict=True)], schema=_OUT_TYPES)


def op12_bm25_packing(spark, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))

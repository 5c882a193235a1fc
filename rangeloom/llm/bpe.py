"""Byte-pair encoding as a bounded-lookahead transducer, and decoding as a byte-to-text state machine."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rangeloom.llm._text import documents, per_row, slices

#: The pattern that splits text before the merges, as published with the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same on ASCII text, for the quicker ``re``.
_ASCII = PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")

_SEGMENT = 1 << 16
_GROUP = 1 << 20
_CACHED_PIECE = 64
_CACHE = 250_000
_TOGETHER = 4096


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes themselves, others from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Merges of one vocabulary; ``lookahead`` is the number of bytes after a token that can still change it.

    A token's right end can only move if a merge of lower rank takes one of the pieces on its right edge, which
    needs the merge's right part; that part in turn is certain only if no merge of still lower rank takes one of
    *its* right pieces. Ranks fall strictly along such a chain, so one pass over the merge list by rank gives
    the longest chain in bytes: ``reach[z]`` is the longest chain that starts by taking piece ``z``, ``inner[t]``
    the longest that takes a piece inside token ``t``.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = [0] * 256
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        reach: dict[int, int] = {}
        inner: dict[int, int] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.ranks[left, right] = rank
            self.made.append(made)
            beyond = max(reach.get(right, 0), inner.get(right, 0))
            inner[made] = max(inner.get(made, 0), beyond)
            reach[left] = max(reach.get(left, 0), len(self.bytes_of[right]) + beyond)
        keys = np.array([a << 32 | b for a, b in self.ranks], np.int64)
        self._by_key = np.argsort(keys).astype(np.int32)
        self._keys = keys[self._by_key]
        self._made = np.array(self.made, np.int32)
        self._byte_ids = np.array(self.byte_id, np.int32)
        self._byte_ranks = self._rank(self._byte_ids[:, None], self._byte_ids[None, :]) if self.made else None
        self.lookahead = max([0, *reach.values(), *inner.values()])
        self.window = 4 * self.lookahead + 2 * max(map(len, self.bytes_of.values()))
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        self._any, self._ascii = regex.compile(PATTERN).findall, re.compile(_ASCII, re.ASCII).findall
        self._cache = _Pieces(self)

    def _pieces(self, text: str) -> list[str]:
        return self._ascii(text) if text.isascii() else self._any(text)

    def merge(self, data: bytes) -> list[int]:
        """Tokens of one buffer: the pair of lowest rank first, from the left."""
        return self._merge_few(data) if len(data) <= _CACHED_PIECE else self._merge_many(data)

    def _merge_few(self, data: bytes) -> list[int]:
        """The ranks of all pairs in a list: quick while it is short."""
        get, none, made = self.ranks.get, len(self.made), self.made
        ids = [self.byte_id[b] for b in data]
        ranks = list(map(get, zip(ids, ids[1:]), repeat(none)))
        while ranks and (rank := min(ranks)) < none:
            i = ranks.index(rank)
            ids[i : i + 2] = [new := made[rank]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], new), none)
            if i < len(ranks):
                ranks[i] = get((new, ids[i + 1]), none)
        return ids

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, the number of merges where a pair has none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._by_key[at], np.int32(len(self.made)))

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many short pieces as bytes: the same as ``merge`` of each, one merge of all pieces at a time.

        A row is a piece, padded; pieces of like length are worked on together, and rows leave when no pair of
        theirs can merge.
        """
        out: list[bytes] = [b""] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        none = len(self.made)
        for lo in range(0, len(order), _TOGETHER):
            who = np.array(order[lo : lo + _TOGETHER])
            size = np.array([len(pieces[i]) for i in who])
            wide = int(size[-1])
            raw = np.frombuffer(b"".join(pieces[i].ljust(wide, b"\0") for i in who), np.uint8).reshape(-1, wide)
            ids, place = self._byte_ids[raw], np.arange(wide)
            ranks = np.full(ids.shape, none, np.int32)
            if none and wide > 1:
                ranks[:, :-1] = np.where(place[1:] < size[:, None], self._byte_ranks[raw[:, :-1], raw[:, 1:]], none)
            while len(who):
                at, row = ranks.argmin(1), np.arange(len(who))
                best = ranks[row, at]
                if (ready := best == none).any():
                    for i, n, own in zip(who[ready].tolist(), size[ready].tolist(), ids[ready].astype("<u4"), strict=True):
                        out[i] = own[:n].tobytes()
                    more = ~ready
                    who, size, ids, ranks, at, best = who[more], size[more], ids[more], ranks[more], at[more], best[more]
                    if not len(who):
                        break
                    wide = int(size.max())
                    ids, ranks, place, row = ids[:, :wide], ranks[:, :wide], place[:wide], np.arange(len(who))
                new = self._made[best]
                source = np.minimum(place + (place > at[:, None]), wide - 1)
                ids, ranks = np.take_along_axis(ids, source, 1), np.take_along_axis(ranks, source, 1)
                ids[row, at] = new
                size = size - 1
                ranks[:, -1] = none
                before, after = at > 0, at + 1 < size
                ranks[row, at] = none
                ranks[row[after], at[after]] = self._rank(new[after], ids[row[after], at[after] + 1])
                ranks[row[before], at[before] - 1] = self._rank(ids[row[before], at[before] - 1], new[before])
        return out

    def _merge_many(self, data: bytes) -> list[int]:
        """The same with a heap."""
        ids = [self.byte_id[b] for b in data]
        n, get = len(ids), self.ranks.get
        nxt, prev, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []
        for i in range(n - 1):
            if (rank := get((ids[i], ids[i + 1]))) is not None:
                heap.append((rank, i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            new = self.made[rank]
            ids[i], ids[j] = new, -1
            nxt[i] = k = nxt[j]
            if k < n:
                prev[k] = i
                if (rank := get((new, ids[k]))) is not None:
                    heapq.heappush(heap, (rank, i, new, ids[k]))
            if (h := prev[i]) >= 0 and (rank := get((ids[h], new))) is not None:
                heapq.heappush(heap, (rank, h, ids[h], new))
        return [x for x in ids if x >= 0]

    def stream(self, data: bytes) -> Iterator[int]:
        """Tokens of a piece of any length from a window of fixed size: a token leaves once ``lookahead`` bytes follow it."""
        at, n = 0, len(data)
        while n - at > self.window:
            done, end = 0, self.window - self.lookahead
            for token in self.merge(data[at : at + self.window]):
                size = len(self.bytes_of[token])
                if done + size > end:
                    break
                done += size
                yield token
            at += done
        yield from self.merge(data[at:])

    def parts(self, text: str) -> Iterator[list[str] | int]:
        """The pieces of each part of a text, or the number of a special token.

        Parts end between a non-white and a white character, where a piece always ends.
        """
        for k, part in enumerate(self._split(text)):
            if k % 2:
                yield self.special[part]
                continue
            at = 0
            while at < len(part):
                end = _cut(part, at + _SEGMENT)
                yield self._pieces(part[at:end] if at or end < len(part) else part)
                at = end

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, a part of the text at a time."""
        for part in self.parts(text):
            if isinstance(part, list):
                self._cache.learn([part])
            yield self._coded(part)

    def _coded(self, part: list[str] | int) -> bytes:
        return b"".join(map(self._cache.__getitem__, part)) if isinstance(part, list) else part.to_bytes(4, "little")

    def encode_each(self, texts: list[str]) -> Iterator[Iterable[bytes]]:
        """``encode`` of each text; short texts are cut in pieces together, up to about a million characters."""
        for lo, hi in groups(texts):
            if hi - lo == 1:
                yield self.encode(texts[lo])
                continue
            parts = [list(self.parts(x)) for x in texts[lo:hi]]
            self._cache.learn(p for own in parts for p in own if isinstance(p, list))
            for own in parts:
                yield map(self._coded, own)


def groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most a million characters, or of one longer text."""
    lo = held = 0
    for i, x in enumerate(texts):
        if i > lo and held + len(x) > _GROUP:
            yield lo, i
            lo, held = i, 0
        held += len(x)
    if lo < len(texts):
        yield lo, len(texts)


_edge = re.compile(r"(?<=\S)\s")


def _cut(text: str, at: int) -> int:
    found = _edge.search(text, at) if at < len(text) else None
    return found.start() if found else len(text)


class _Pieces(dict):
    """Ids of short pieces, kept up to a fixed number."""

    def __init__(self, transducer: Transducer) -> None:
        self.transducer = transducer

    def learn(self, pieces: Iterable[list[str]]) -> None:
        """Merge the short pieces that are not known, all at once."""
        if len(self) >= _CACHE:
            self.clear()
        new = [(p, data) for p in set().union(*pieces).difference(self) if len(data := p.encode()) <= _CACHED_PIECE]
        self.update(zip((p for p, _ in new), self.transducer.merge_all([data for _, data in new]), strict=True))

    def __missing__(self, piece: str) -> bytes:
        t = self.transducer
        data = piece.encode()
        if len(data) > _CACHED_PIECE:
            return np.fromiter(t.stream(data), "<u4").tobytes()
        if len(self) >= _CACHE:
            self.clear()
        self[piece] = ids = array("I", t.merge(data)).tobytes()
        return ids


class Decoder:
    """Bytes of tokens to text: the state is at most three bytes of an unfinished character."""

    def __init__(self, transducer: Transducer) -> None:
        self._bytes = transducer.bytes_of
        self._text = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        return self._text.decode(b"".join(map(self._bytes.__getitem__, ids)), final)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One per worker and vocabulary file."""
    return Transducer(path)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _ids(docs: DataFrame, id_col: str, text_col: str, path: str | None, row: Callable, schema: pa.Schema, out: str) -> DataFrame:
    """``path``: the vocabulary file, on every executor; None: the file that the executor's own package names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path or vocabulary())
        for batch in (part for batch in batches for part in slices(batch)):
            if batch.num_rows:
                texts = [x or "" for x in batch.column(1).to_pylist()]
                rows = [row(t, parts) for parts in t.encode_each(texts)]
                columns = [pa.array(c, ty) for c, ty in zip(zip(*rows, strict=True), schema.types[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=schema)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, out)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids array<int>)`` of every row; null and empty texts have no tokens.

    Repeated rows and equal ids give a row each; other columns are not read; an empty table gives an empty one.
    """

    def row(t: Transducer, parts: Iterable[bytes]) -> tuple:
        ids = np.frombuffer(b"".join(parts), "<u4").astype(np.int32)
        return len(ids), ids

    return _ids(docs, id_col, text_col, path, row, pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))]), "doc_id long, n_tokens long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; null ids give an empty text, special tokens are kept."""

    def make() -> Callable:
        t = transducer(path or vocabulary())
        return lambda key, ids: (key, Decoder(t).feed(ids or [], final=True))

    return tokens.select("doc_id", "ids").mapInArrow(per_row(pa.schema([("doc_id", pa.int64()), ("text", pa.string())]), make), "doc_id long, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode every text, decode its tokens, and return digests of both: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Ids leave the transducer part by part and go straight to the digest and the decoder, so a task holds
    about a million characters in pieces, or one part of a longer text, besides the texts. Null counts as empty; repeated rows give a row each.
    """

    def row(t: Transducer, parts: Iterable[bytes]) -> tuple:
        n, ids_hash, text_hash, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(t)
        for part in parts:
            n += len(part) // 4
            ids_hash.update(part)
            text_hash.update(decoder.feed(np.frombuffer(part, "<u4").tolist()).encode())
        text_hash.update(decoder.feed((), final=True).encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest()

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _ids(docs, id_col, text_col, path, row, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe_transducer(spark, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))

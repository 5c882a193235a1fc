"""Substring dedup: repeated word windows by compaction of a De Bruijn graph of words.

Edges are the windows of the texts, each between the nodes of its first and last ``window - 1`` words. Edges that stand
more than once are found in one exchange, which carries runs of edges (:func:`cut`). What a later copy shares with the
first place of each edge is a run in coordinates of both. From there on it is a graph: links between runs that follow each
other in a text come from a join, degrees from aggregation; runs whose node has one way in and one way out are
compacted by pointer jumping; and what is left, long repeated spans, is verified on the words at the coordinates of
both sources. A hash never decides: where words differ, the windows concerned are grouped again by their words.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.llm._text import combined, covered, documents, per_row, window_hashes, word_hashes, words_of
from rangeloom.shared import stored

_EDGE_BYTES = 6
#: Anchors counted together before those below the bound are left out.
_COUNTED = 1 << 20
#: Hot edges or runs that a task holds before it writes them out.
_HELD = 200_000


@dataclass(frozen=True)
class RepeatSpec:
    """A repeated span is a window of ``window`` words that starts earlier too.

    ``anchor``: words of the k-mers whose smallest hash cuts texts into runs. ``hot_share``: an anchor with more than
    ``1 / (hot_share * partitions)`` of all runs, and more than ``hot_least``, is dealt out edge by edge. ``hash_bits`` of
    the word hashes are used; fewer make collisions, which cost time and no result.
    """

    window: int = 20
    anchor: int = 5
    hot_share: float = 4.0
    hot_least: int = 64
    hash_bits: int = 64


@dataclass(frozen=True)
class _Runs:
    """Runs of one text: edge ``start[i]`` and the ``length[i] - 1`` edges after it share ``anchor[i]``."""

    start: np.ndarray
    length: np.ndarray
    anchor: np.ndarray
    edges: np.ndarray | None


def _hashes(text: str | None, spec: RepeatSpec) -> np.ndarray:
    h = word_hashes(text.encode()) if text else np.empty(0, np.uint64)
    return h if spec.hash_bits == 64 else h & np.uint64((1 << spec.hash_bits) - 1)


def edge_hashes(h: np.ndarray, kmers: np.ndarray, spec: RepeatSpec) -> np.ndarray:
    times, rest = divmod(spec.window, spec.anchor)
    return window_hashes(h, spec.window) if rest or times > 8 else combined(kmers, spec.anchor, times)


def cut(h: np.ndarray, spec: RepeatSpec, edges: bool = True) -> _Runs:
    """Cut the edges of a text (its word hashes) into runs of edges with the same smallest k-mer, at its leftmost place.

    The k-mer depends on an edge's words alone, so equal edges anywhere lie in runs of the same anchor, and not
    twice in one run.
    """
    kmers = window_hashes(h, spec.anchor)
    low, width, all_ = kmers, 1, spec.window - spec.anchor + 1
    while width < all_:
        step = min(width, all_ - width)
        low, width = np.minimum(low[:-step], low[step:]), width + step
    start = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (kmers[: len(low) - 1] == low[:-1])])
    return _Runs(start, np.diff(np.r_[start, len(low)]), low[start], edge_hashes(h, kmers, spec) if edges else None)


def _texts(batches: Iterator[pa.RecordBatch], spec: RepeatSpec, edges: bool) -> Iterator[tuple[int, int, _Runs]]:
    """``doc_id, key, runs`` of the texts that have a window; ``key`` is the text's 31 bits, moved up by 32."""
    for batch in batches:
        for doc_id, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if doc_id is not None:
                h = _hashes(text, spec)
                if len(h) >= spec.window:
                    yield doc_id, key << 32, cut(h, spec, edges)


def hot_anchors(docs: DataFrame, spec: RepeatSpec, partitions: int) -> np.ndarray:
    """Every anchor with more than ``1 / (hot_share * partitions)`` of all runs, by lossy counting.

    Of each ``_COUNTED`` anchors, those with at most an eighth of that share there are left out. So an anchor loses at
    most an eighth of the share of all runs, and seven eighths are a bound that finds all hot ones; at most
    ``8 / 7 * hot_share * partitions`` anchors reach it. The bound and the cost follow the partitions at any size.
    """
    share = 1 / (spec.hot_share * partitions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            anchor, c = np.unique(np.concatenate(held), return_counts=True)
            some = c > share * n / 8
            return pa.RecordBatch.from_arrays([pa.array([None, *anchor[some].view(np.int64).tolist()], pa.int64()), pa.array([n, *c[some].tolist()], pa.int64())], names=["anchor", "n"])

        for _, _, p in _texts(batches, spec, edges=False):
            held.append(p.anchor)
            n += len(p.anchor)
            if n >= _COUNTED:
                yield counted()
                held, n = [], 0
        if n:
            yield counted()

    counts = stored(docs.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")), "anchor-counts")
    total = counts.where("anchor is null").first()
    least = max(spec.hot_least, 7 / 8 * share * total["n"]) if total else 0.0
    hot = counts.where(F.col("anchor").isNotNull() & (F.col("n") > least)).select("anchor").toArrow()["anchor"].to_numpy()
    return np.sort(hot.astype(np.int64).view(np.uint64))


_ROW = "anchor long, edge long, doc_id long, place long, known boolean, edges binary"
_ROW_SCHEMA = pa.schema([("anchor", pa.int64()), ("edge", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("known", pa.bool_()), ("edges", pa.binary())])
_KNOWN = struct.Struct("<qqq")


class _Hot:
    """The hot edges that a task has met: their earliest places, and later ones as runs ``doc_id, place, n`` of those."""

    def __init__(self) -> None:
        self.first: dict[tuple[int, int], tuple[int, int]] = {}
        self.late: list[list[int]] = []

    def add(self, edge: tuple[int, int], here: tuple[int, int]) -> None:
        there = self.first.setdefault(edge, here)
        if there == here:
            return
        late, early = max(there, here), min(there, here)
        self.first[edge] = early
        last = self.late[-1] if self.late else None
        if last and (last[0], last[1] + last[2], last[3], last[4] + last[2]) == (*late, *early):
            last[2] += 1
        else:
            self.late.append([*late, 1, *early])

    def rows(self) -> pa.RecordBatch:
        rows = [(d, 0, d, at, True, _KNOWN.pack(fd, fat, n)) for d, at, n, fd, fat in self.late] + [(*k, *v, False, bytes(_EDGE_BYTES)) for k, v in self.first.items()]
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROW_SCHEMA.types, strict=True)], schema=_ROW_SCHEMA)


def _dealt(docs: DataFrame, spec: RepeatSpec, hot: np.ndarray) -> DataFrame:
    """A row per run; of hot anchors a row per edge, after a first reduction in the task.

    Of the equal edges of a hot anchor that one task meets, the earliest goes on; the others are known to be late
    and pass the exchange as such, dealt by document. A task writes them out when it holds ``_HELD`` entries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Hot()
        anchors, docs_, places, sizes, data, held = [], [], [], [], [], 0

        def cold() -> pa.RecordBatch:
            a = np.concatenate(anchors).view(np.int64)
            n = len(a)
            offsets = np.r_[0, np.cumsum(np.concatenate(sizes) * _EDGE_BYTES)].astype(np.int32)
            edges = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(data).tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.zeros(n, np.int64)), pa.array(np.concatenate(docs_)), pa.array(np.concatenate(places)), pa.array(np.zeros(n, bool)), edges], schema=_ROW_SCHEMA)

        for doc_id, key, p in _texts(batches, spec, edges=True):
            raw = p.edges.view(np.uint8).reshape(-1, 8)[:, :_EDGE_BYTES]
            warm = hot[np.minimum(np.searchsorted(hot, p.anchor), len(hot) - 1)] == p.anchor if len(hot) else np.zeros(len(p.anchor), bool)
            if warm.any():
                edge = p.edges.view(np.int64)
                for i in np.flatnonzero(warm):
                    a, at = int(p.anchor[i : i + 1].view(np.int64)[0]), int(p.start[i])
                    for j, e in enumerate(edge[at : at + int(p.length[i])].tolist(), at):
                        found.add((a, e), (doc_id, key + j))
                raw = raw[np.repeat(~warm, p.length)]
                p = _Runs(p.start[~warm], p.length[~warm], p.anchor[~warm], None)
            if len(p.start):
                anchors.append(p.anchor), places.append(p.start + key), sizes.append(p.length), data.append(raw)
                docs_.append(np.full(len(p.start), doc_id, np.int64))
                held += len(p.start)
            if held > 50_000:
                yield cold()
                anchors, docs_, places, sizes, data, held = [], [], [], [], [], 0
            if len(found.first) > _HELD or len(found.late) > _HELD:
                yield found.rows()
        if held:
            yield cold()
        if found.first:
            yield found.rows()

    return docs.mapInArrow(run, _ROW)


_RUN = "doc_id long, place long, n int, first_doc long, first_place long"
_RUN_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows by anchor, edge, document and place: the runs of edges that occur earlier, with their first places.

    A task holds the distinct edges of one anchor. Equal rows (of a repeated document) count once.
    """
    at, seen, whole, last = None, {}, {}, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        anchor, edge, doc_id, place = (batch.column(i).to_numpy() for i in range(4))
        known = batch.column(4).to_numpy(zero_copy_only=False)
        edges = batch.column(5)
        new = np.r_[(anchor[0], edge[0]) != at, (anchor[1:] != anchor[:-1]) | (edge[1:] != edge[:-1])]
        # A group of one row in the midst of a batch has nothing to compare with.
        alone = new & np.r_[new[1:], False]
        out: list[tuple[int, int, int, int, int]] = []
        for i in np.flatnonzero(~alone | known):
            data = edges[int(i)].as_py()
            d, p = int(doc_id[i]), int(place[i])
            if known[i]:
                fd, fp, k = _KNOWN.unpack(data)
                out.append((d, p, k, fd, fp))
                continue
            if new[i]:
                seen, whole, last = {}, {}, None
            if last == (d, p):
                continue
            last = (d, p)
            n_edges = len(data) // _EDGE_BYTES
            if data in whole:
                out.append((d, p, n_edges, *whole[data]))
                continue
            fresh = True
            run, rd, rp = 0, 0, 0
            for j in range(n_edges):
                fd, fp = seen.setdefault(data[j * _EDGE_BYTES : (j + 1) * _EDGE_BYTES], (d, p + j))
                late = fd != d or fp != p + j
                if late:
                    fresh = False
                if run and not (late and fd == rd and fp == rp + run):
                    out.append((d, p + j - run, run, rd, rp))
                    run = 0
                if late:
                    if not run:
                        rd, rp = fd, fp
                    run += 1
            if run:
                out.append((d, p + n_edges - run, run, rd, rp))
            if fresh:
                whole[data] = (d, p)
        if alone[n - 1]:
            seen, whole, last = {}, {}, None
        at = (anchor[n - 1], edge[n - 1])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((),) * 5, _RUN_TYPES, strict=True)], names=["doc_id", "place", "n", "first_doc", "first_place"])


def late_runs(docs: DataFrame, spec: RepeatSpec = RepeatSpec()) -> DataFrame:
    """``doc_id, place, n, first_doc, first_place``: runs of edges of ``docs`` (``doc_id, key, text``) that stand earlier too.

    Earlier: in a smaller (doc_id, key), or in the same text at a smaller start. ``place`` is ``key << 32 | start``. Each late
    edge lies in one run. Edges are told apart by their anchor's 64 bits and 48 (hot anchors: 64) of their own.
    """
    hot = hot_anchors(docs, spec, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = _dealt(docs, spec, hot).repartition("anchor", "edge").sortWithinPartitions("anchor", "edge", "doc_id", "place")
    return rows.mapInArrow(_later, _RUN)


_PATH = ["first_doc", "first_place", "n"]


def _named(df: DataFrame, prefix: str, *more: str | Column) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}_{c}") for c in _PATH), *more)


def nonbranching(runs: DataFrame) -> DataFrame:
    """Links ``a_*, b_*`` between distinct runs whose common node has one way in and one way out.

    Runs that are equal in coordinates of their first place are one path of the graph. ``b`` follows ``a`` where it starts at
    the edge after ``a`` in the same text. The node between them does not branch if ``a`` is left for ``b`` each time
    it stands somewhere, and ``b`` is entered from ``a`` each time: the link stands as often as either.
    """
    degree = stored(runs.groupBy(*_PATH).agg(F.count(F.lit(1)).alias("c")), "path-degrees")
    left = _named(runs, "a", "doc_id", (F.col("place") + F.col("n")).alias("at"))
    right = _named(runs, "b", "doc_id", F.col("place").alias("at"))
    ab = [f"{x}_{c}" for x in "ab" for c in _PATH]
    links = left.join(right, ["doc_id", "at"]).groupBy(*ab).agg(F.count(F.lit(1)).alias("links"))
    out = links.join(_named(degree, "a", F.col("c").alias("links")), [f"a_{c}" for c in _PATH] + ["links"])
    return out.join(_named(degree, "b", F.col("c").alias("links")), [f"b_{c}" for c in _PATH] + ["links"]).select(*ab)


def compacted(links: DataFrame) -> DataFrame:
    """``b_*, a_*, offset``: for each run that another leads to, the first run ``a`` of its path and the edges before it.

    Pointer jumping: each round joins every run's pointer with that of the run it points to, so a path of n runs
    takes log2(n) rounds. No run points to itself in the end, as texts end. Tables are written each round.
    """
    mine, above = [f"b_{c}" for c in _PATH], [f"a_{c}" for c in _PATH]
    at = stored(links.select(*mine, *above, F.col("a_n").cast("long").alias("offset")), "path-links")
    while True:
        up = at.select(*(F.col(m).alias(a) for m, a in zip(mine, above, strict=True)), *(F.col(a).alias(f"u{a}") for a in above), F.col("offset").alias("more"))
        jumped = at.join(up, above, "left").select(*mine, *(F.coalesce(f"u{a}", a).alias(a) for a in above), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"), F.col("more").isNotNull().alias("moved"))
        jumped = stored(jumped, "path-jump")
        at = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return at


def paths(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(spans, stretches)`` of the compacted graph of ``runs``.

    ``spans``: where paths stand, ``doc_id, place`` and the path (its first run: ``first_doc, first_place, n``).
    ``stretches``: what a path consists of, ``first_doc, first_place, n`` and ``offset, stretch_doc, stretch_place,
    stretch_n``: its runs, joined where they go on at their first place too.
    """
    inner = compacted(nonbranching(runs))
    own = inner.select(*(F.col(f"b_{c}").alias(c) for c in _PATH))
    heads = stored(runs.join(own, _PATH, "left_anti").select("doc_id", "place", *_PATH), "path-places")
    members = inner.select(*(F.col(f"a_{c}").alias(c) for c in _PATH), "offset", *(F.col(f"b_{c}").alias(f"m_{c}") for c in _PATH))
    members = members.unionByName(heads.select(*_PATH).distinct().select(*_PATH, F.lit(0).cast("long").alias("offset"), *(F.col(c).alias(f"m_{c}") for c in _PATH)))
    order = Window.partitionBy(*_PATH).orderBy("offset")
    back = lambda c: F.lag(c).over(order)
    goes_on = (back("m_first_doc") == F.col("m_first_doc")) & (back("m_first_place") + back("m_n") == F.col("m_first_place"))
    numbered = members.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("no", F.sum("new").over(order))
    stretches = numbered.groupBy(*_PATH, "no").agg(
        F.min("offset").alias("offset"), F.first("m_first_doc").alias("stretch_doc"), F.min("m_first_place").alias("stretch_place"), F.sum("m_n").cast("int").alias("stretch_n")
    )
    return heads, stretches.drop("no")


def _digest(words: list[bytes], start: int, n: int, window: int) -> bytes | None:
    """Digest of the words of ``n`` windows from ``start`` on; none where the text has no such windows."""
    end = start + n + window - 1
    return hashlib.blake2b(b" ".join(words[start:end]), digest_size=16).digest() if end <= len(words) else None


def _start(place: str) -> Column:
    return F.col(place).bitwiseAND(F.lit(0xFFFFFFFF))


def path_digests(stretches: DataFrame, docs: DataFrame, spec: RepeatSpec) -> DataFrame:
    """``first_doc, first_place, n, parts``: for each path its stretches ``offset, n, digest`` of the words at their first place."""
    wanted = stretches.select("stretch_doc", F.shiftrightunsigned("stretch_place", 32).alias("stretch_key"), F.struct(*_PATH, "offset", _start("stretch_place").alias("start"), F.col("stretch_n").alias("k")).alias("w"))
    by_doc = stored(wanted.groupBy("stretch_doc", "stretch_key").agg(F.collect_list("w").alias("wanted")), "path-sources")
    texts = by_doc.join(docs, (F.col("stretch_doc") == F.col("doc_id")) & (F.col("stretch_key") == F.col("key"))).select("text", "wanted")
    schema = pa.schema([("first_doc", pa.int64()), ("first_place", pa.int64()), ("n", pa.int32()), ("offset", pa.int64()), ("k", pa.int32()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                out += [(w["first_doc"], w["first_place"], w["n"], w["offset"], w["k"], _digest(words, w["start"], w["k"], spec.window)) for w in wanted]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    found = texts.mapInArrow(run, "first_doc long, first_place long, n int, offset long, k int, digest binary")
    return found.groupBy(*_PATH).agg(F.collect_list(F.struct("offset", "k", "digest")).alias("parts"))


def _removed(docs: DataFrame, spans: DataFrame, exact: DataFrame | None, spec: RepeatSpec, digest: bool) -> DataFrame:
    """The result and ``failed``, the edges of spans whose words are not those of their path."""
    by_doc = spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "parts")).alias("spans"))
    cols = ["doc_id", "text", "spans"]
    joined = docs.join(by_doc, ["doc_id", "key"], "left")
    if exact is not None:
        joined = joined.join(exact.groupBy("doc_id", "key").agg(F.collect_list("start").alias("late")), ["doc_id", "key"], "left")
        cols.append("late")
    window = spec.window

    def make() -> Callable:
        def row(doc_id, text, spans, late=None):
            words = words_of(text)
            starts, failed = [], []
            for s in spans or ():
                for part in s["parts"]:
                    at, k = s["start"] + part["offset"], part["k"]
                    own = _digest(words, at, k, window)
                    if own is not None and own == part["digest"]:
                        starts.append(np.arange(at, at + k))
                    else:
                        failed.append((at, k))
            keys = []
            if failed and late is None:
                h = _hashes(text, spec)
                edges = edge_hashes(h, window_hashes(h, spec.anchor), spec) & np.uint64((1 << 8 * _EDGE_BYTES) - 1)
                keys = np.unique(np.concatenate([edges[at : at + k] for at, k in failed])).tolist()
            if late:
                starts.append(np.array(late))
            removed = 0
            if starts:
                gone = covered(np.unique(np.concatenate(starts)), window, len(words))
                removed = int(gone.sum())
                words_kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            else:
                words_kept = words
            kept = b" ".join(words_kept)
            return doc_id, len(words), removed, hashlib.sha256(kept).hexdigest() if digest else kept.decode(), keys

        return row

    last = "kept_sha256" if digest else "text"
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), (last, pa.string()), ("failed", pa.list_(pa.int64()))])
    return joined.select(*cols).mapInArrow(per_row(schema, make), f"doc_id long, n_words long, n_removed long, {last} string, failed array<long>")


def late_by_words(docs: DataFrame, edges: DataFrame, spec: RepeatSpec) -> DataFrame:
    """``doc_id, key, start`` of the windows that start earlier too, of those with an ``edge`` in ``edges``, by their words."""
    window = spec.window

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                h = _hashes(text, spec)
                if doc_id is None or len(h) < window:
                    continue
                words = words_of(text)
                own = (edge_hashes(h, window_hashes(h, spec.anchor), spec) & np.uint64((1 << 8 * _EDGE_BYTES) - 1)).view(np.int64)
                for lo in range(0, len(own), 10_000):
                    part = own[lo : lo + 10_000]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part), pa.array([doc_id] * n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array(range(lo, lo + n), pa.int32()), pa.array([b" ".join(words[i : i + window]) for i in range(lo, lo + n)], pa.binary())],
                        names=["edge", "doc_id", "key", "start", "words"],
                    )

    windows = docs.mapInArrow(every, "edge long, doc_id long, key long, start int, words binary").join(edges, "edge", "left_semi")
    windows = stored(windows.drop("edge").distinct(), "windows-in-doubt")
    place = F.struct("doc_id", "key", "start")
    first = windows.groupBy("words").agg(F.min(place).alias("first"))
    return windows.join(first, "words").where(place > F.col("first")).select("doc_id", "key", "start")


def _once(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated rows taken once; texts cross an exchange only if there are such rows, and only those."""
    again = stored(docs.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1 and doc_id is not null").drop("c"), "repeated-rows")
    if again.isEmpty():
        return docs
    on = ["doc_id", "key"]
    return docs.join(again, on, "left_anti").unionByName(docs.join(again, on, "left_semi").dropDuplicates([*on, "text"]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: RepeatSpec = RepeatSpec(), digest: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed`` and the words kept, joined by one space (``text``, or its ``kept_sha256``).

    Words inside a window that starts earlier too are removed; windows are those of the input. Null and empty
    texts have no words, texts shorter than a window lose none. Rows that repeat a doc_id and its text are one
    document and stay alike; different texts under one doc_id are documents of their own, in the order of their
    ``key``, 31 bits of the text's hash. A null doc_id loses nothing. An empty table gives an empty one; other
    columns are not read.
    """
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    docs = docs.select("doc_id", F.shiftrightunsigned(F.xxhash64("text"), 33).alias("key"), "text")
    runs = stored(late_runs(_once(docs), spec), "repeat-runs")
    heads, stretches = paths(runs)
    known = stored(path_digests(stretches, docs, spec), "path-digests")
    spans = stored(heads.join(known.hint("merge"), _PATH).select("doc_id", F.shiftrightunsigned("place", 32).alias("key"), _start("place").alias("start"), "parts"), "repeat-spans")
    out = stored(_removed(docs, spans, None, spec, digest), "repeats-removed")
    doubt = out.where(F.size("failed") > 0)
    if not doubt.isEmpty():
        edges = stored(doubt.select(F.explode("failed").alias("edge")).distinct(), "edges-in-doubt")
        out = _removed(docs, spans, stored(late_by_words(docs, edges, spec), "late-by-words"), spec, digest)
    return out.drop("failed")


def op9_de_bruijn(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), digest=True)

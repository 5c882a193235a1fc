"""Near duplicates: banded MinHash candidates, odd sketches, and links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm._text import documents, mixed, per_row, slices, window_hashes, word_hashes
from rangeloom.llm.bitmap import likely
from rangeloom.llm.components import components
from rangeloom.shared import stored


@dataclass(frozen=True)
class NearSpec:
    """Similar: 100 * intersection >= ``percent`` * union of the sets of distinct ``shingle``-word shingles.

    ``bands`` of ``rows`` MinHash samples each: a pair at 0.8 shares no band with probability
    (1 - 0.8**5)**32 = 3e-6, at 0.85 with 2e-8. All samples are folded into an odd sketch of ``bits`` bits.
    A candidate pair passes if the sketches estimate at least ``percent / 100 - slack``, six standard deviations of
    the estimate below the threshold. A second odd sketch of ``fine_bits`` bits holds the parity of a coordinated
    sample of the set, the whole set up to ``fine_sample`` shingles, and sharpens that: see ``possible``. ``group``: documents of a star that are compared in
    one place; ``block``: members of a bucket, as sets of 1,024 shingles, that are compared in one place.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    bits: int = 512
    slack: float = 0.2
    fine_bits: int = 2048
    fine_sample: int = 1024
    group: int = 32
    block: int = 256

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_differing(self) -> int:
        """Differing sketch bits at the lowest estimate: the inverse of ``1 + bits / (4 k) * ln(1 - 2 d / bits)``."""
        lowest = self.percent / 100 - self.slack
        return int(np.ceil(self.bits / 2 * (1 - np.exp(-4 * self.samples * (1 - lowest) / self.bits))))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle, one without words none."""
    h = word_hashes(text.encode().lower()) if text else np.empty(0, np.uint64)
    n = len(h)
    if not n:
        return h
    if n < size:
        return mixed(window_hashes(h, n) + np.uint64(n) * np.uint64(0xD6E8FEB86659FD93))
    return np.unique(window_hashes(h, size))


def estimate(differing: np.ndarray, samples: int, bits: int) -> np.ndarray:
    """Similarity from the number of differing bits of two odd sketches of ``samples`` MinHash samples each."""
    return 1 + bits / (4 * samples) * np.log(np.maximum(1 - 2 * np.asarray(differing) / bits, 1e-9))


class Signer:
    """MinHash samples, band keys and odd sketch of a set; the hash functions follow from the spec alone."""

    def __init__(self, spec: NearSpec) -> None:
        rng = np.random.default_rng(20240229)
        self.spec = spec
        self.a = rng.integers(0, 2**63, spec.samples, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, spec.samples, dtype=np.uint64)[:, None]
        self.salt = rng.integers(0, 2**63, spec.samples, dtype=np.uint64)

    def samples(self, s: np.ndarray) -> np.ndarray:
        out = None
        for at in range(0, len(s), 2048):
            low = (self.a * s[None, at : at + 2048] + self.b).min(1)
            out = low if out is None else np.minimum(out, low)
        return out

    def keys(self, m: np.ndarray) -> np.ndarray:
        m = m.reshape(self.spec.bands, self.spec.rows)
        key = np.arange(self.spec.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for i in range(self.spec.rows):
            key = mixed(key + m[:, i])
        return key.view(np.int64)

    def sketch(self, m: np.ndarray) -> bytes:
        bit = mixed(m + self.salt) % np.uint64(self.spec.bits)
        return np.packbits(np.bincount(bit.astype(np.int64), minlength=self.spec.bits) % 2 == 1).tobytes()


    def fine(self, s: np.ndarray) -> tuple[int, bytes]:
        """Level and odd sketch of the shingles whose hash is below 2**-level of all."""
        level = max(0, int(np.ceil(np.log2(len(s) / self.spec.fine_sample))))
        low = mixed(s + np.uint64(0x5851F42D4C957F2D))
        bit = (low % np.uint64(self.spec.fine_bits))[low >> np.uint64(64 - level) == 0] if level else low % np.uint64(self.spec.fine_bits)
        return level, np.packbits(np.bincount(bit.astype(np.int64), minlength=self.spec.fine_bits) % 2 == 1).tobytes()


@dataclass
class Sketches:
    """Set sizes and odd sketches of some nodes, as arrays; one column of :func:`signatures` each."""

    n: np.ndarray
    sketch: np.ndarray
    level: np.ndarray
    fine: np.ndarray

    @staticmethod
    def of(n: list[int], sketch: list[bytes], level: list[int], fine: list[bytes]) -> Sketches:
        words = lambda x: np.frombuffer(b"".join(x), np.uint64).reshape(len(x), -1) if len(x) else np.empty((0, 1), np.uint64)
        return Sketches(np.array(n, np.int64), words(sketch), np.array(level, np.int64), words(fine))

    def at(self, i: np.ndarray) -> Sketches:
        return Sketches(self.n[i], self.sketch[i], self.level[i], self.fine[i])


def sizes_allow(n: np.ndarray, m: np.ndarray, spec: NearSpec) -> np.ndarray:
    """Similar sets have sizes within ``percent`` of each other."""
    return 100 * np.minimum(n, m) >= spec.percent * np.maximum(n, m)


def samples_allow(x: np.ndarray, y: np.ndarray, spec: NearSpec) -> np.ndarray:
    """Whether odd sketches of the MinHash samples, as words, leave a pair possible."""
    return np.bitwise_count(x ^ y).sum(1) <= spec.most_differing


def sets_allow(x: Sketches, y: Sketches, spec: NearSpec) -> np.ndarray:
    """Whether the sketches of the sets themselves leave a pair possible.

    Similar sets of sizes a and b differ in at most ``(a + b) * (100 - percent) / (100 + percent)`` elements. Each
    of them flips at most one bit of the fine sketch, so where that holds whole sets the bound is sure; where it
    holds a sample, six standard deviations are added. Sketches of different levels are not compared.
    """
    p = spec.percent
    share = 0.5 ** x.level.astype(float)
    most = share * (x.n + y.n) * (100 - p) / (100 + p)
    most = most + 6 * np.sqrt(most * (1 - share)) + 1e-9
    return (np.bitwise_count(x.fine ^ y.fine).sum(1) <= most) | (x.level != y.level)


def possible(x: Sketches, y: Sketches, spec: NearSpec) -> np.ndarray:
    """Which pairs sizes and sketches leave possible; ``x`` and ``y`` are of one length, or one of them of length 1."""
    ok = sizes_allow(x.n, y.n, spec) & samples_allow(x.sketch, y.sketch, spec)
    i = np.flatnonzero(ok)
    one = lambda z: z if len(z.n) == 1 else z.at(i)
    if len(i):
        ok[i] = sets_allow(one(x), one(y), spec)
    return ok


def signatures(docs: DataFrame, spec: NearSpec) -> DataFrame:
    """``doc_id, n_shingles, set_key, keys, sketch, level, fine`` of ``docs`` (``doc_id, text``)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary()), ("level", pa.int32()), ("fine", pa.binary())])

    def make():
        signer = Signer(spec)

        def row(key, text):
            s = shingle_set(text, spec.shingle)
            if not len(s):
                return key, 0, None, None, None, None, None
            m = signer.samples(s)
            return key, len(s), xxhash.xxh3_128_digest(s.tobytes()), signer.keys(m), signer.sketch(m), *signer.fine(s)

        return row

    return docs.mapInArrow(per_row(schema, make, 1 << 22), "doc_id long, n_shingles long, set_key binary, keys array<long>, sketch binary, level int, fine binary")


_SKETCH = ["n", "sketch", "level", "fine"]


def _near_enough(pairs: DataFrame, reps: DataFrame, spec: NearSpec) -> DataFrame:
    """Of ``(a, b)``, those that sizes and sketches leave possible: the small sketches first, the large ones of what they leave."""
    words = lambda x: np.frombuffer(b"".join(x), np.uint64).reshape(len(x), -1)

    def small(n: list, sketch: list, m: list, other: list) -> np.ndarray:
        return sizes_allow(np.array(n), np.array(m), spec) & samples_allow(words(sketch), words(other), spec)

    def large(*c: list) -> np.ndarray:
        of = lambda n, level, fine: Sketches(np.array(n), np.empty((len(n), 0), np.uint64), np.array(level), words(fine))
        return sets_allow(of(*c[:3]), of(*c[3:]), spec)

    return _sifted(_sifted(pairs, reps, ["n", "sketch"], small), reps, ["n", "level", "fine"], large)


def _sifted(pairs: DataFrame, reps: DataFrame, cols: list[str], test: Callable[..., np.ndarray]) -> DataFrame:
    """Of ``(a, b)``, those that pass ``test`` on ``cols`` of both sides, as lists."""
    side = lambda x: reps.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in cols))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = pa.array(test(*(x.to_pylist() for x in batch.columns[2:])))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], schema=out)

    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return stored(both.select("a", "b", *(f"{c}_{x}" for x in "ab" for c in cols)).mapInArrow(run, "a long, b long"), "pairs-left")


def confirmed(pairs: DataFrame, docs: DataFrame, spec: NearSpec) -> DataFrame:
    """Of distinct ``(a, b)``, those whose full sets are similar; ``docs`` gives ``doc_id, text``.

    Pairs are stars around ``a``; a star is cut in groups of about ``group`` documents, each with its own copy
    of ``a``'s text, so a large star is spread over many tasks. A task holds the set of one centre at a time.
    """
    if pairs.isEmpty():
        return pairs
    sizes = stored(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    groups = pairs.join(sizes, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("degree") / spec.group)))
    needs = groups.select(F.col("b").alias("doc_id"), "a", "part", F.lit(True).alias("member"))
    needs = stored(needs.unionByName(groups.select(F.col("a").alias("doc_id"), "a", "part", F.lit(False).alias("member")).distinct()), "needs")
    texts = likely(docs, needs, ["doc_id"]).join(needs, "doc_id").select("a", "part", "member", "doc_id", "text")
    ordered = texts.repartition(F.col("a"), F.col("part")).sortWithinPartitions("a", "part", "member")
    percent, size = spec.percent, spec.shingle
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for a, _, member, doc_id, text in _rows([batch]):
                s = shingle_set(text, size)
                if not member:
                    centre, own = a, s
                elif centre == a:
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if both and 100 * both >= percent * (len(own) + len(s) - both):
                        found.append((a, doc_id))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], schema=out)

    return stored(ordered.mapInArrow(run, "a long, b long").distinct(), "confirmed")


_MEMBER = pa.schema([
    ("key", pa.int64()), ("qb", pa.int64()), ("mb", pa.int64()), ("member", pa.bool_()), ("id", pa.int64()), ("comp", pa.int64()), ("of_main", pa.bool_()),
    ("n", pa.int64()), ("sketch", pa.binary()), ("level", pa.int32()), ("fine", pa.binary()), ("keys", pa.list_(pa.int64())),
])
_MEMBER_DDL = "key long, qb long, mb long, member boolean, id long, comp long, of_main boolean, n long, sketch binary, level int, fine binary, keys array<long>"


class _Block:
    """Queries of a bucket's block, and which of them a member may be linked with; rows begin with the columns of ``_MEMBER``."""

    def __init__(self, rows: list[tuple]) -> None:
        self.rows = rows
        _, _, _, _, ids, comps, _, *sketches, keys = (list(c) for c in zip(*(r[: len(_MEMBER)] for r in rows), strict=True))
        self.ids, self.comps, self.keys, self.sketches = np.array(ids), np.array(comps), np.array(keys), Sketches.of(*sketches)

    def near(self, row: tuple, spec: NearSpec) -> np.ndarray:
        """Places of the queries that sizes and sketches leave possible.

        A pair is looked at in one place only: in the first band in which it shares a bucket, and of two queries the one with the smaller id asks.
        """
        key, _, _, _, i, comp, of_main, *sketches, keys = row[: len(_MEMBER)]
        keys = np.array(keys)
        band = int((keys == key).argmax())
        other = (self.comps != comp) & ~(self.keys[:, :band] == keys[:band]).any(1)
        at = np.flatnonzero(other if of_main else other & (self.ids < i))
        return at[possible(self.sketches.at(at), Sketches.of(*([x] for x in sketches)), spec)] if len(at) else at


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for part in slices(batch):
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def _blocks(rows: Iterator[tuple]) -> Iterator[tuple[_Block, tuple | None]]:
    """Each member with the queries of its block pair, which come before it; None behind a block pair's last member."""
    at, queries, block = None, [], None
    for row in rows:
        if row[:3] != at:
            if block:
                yield block, None
            at, queries, block = row[:3], [], None
        if not row[3]:
            queries.append(row)
        elif queries:
            block = block or _Block(queries)
            yield block, row
    if block:
        yield block, None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.types, strict=True)], schema=schema)


def _by_block_pair(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.col("key"), F.col("qb"), F.col("mb")).sortWithinPartitions("key", "qb", "mb", "member")


def _close(members: DataFrame, spec: NearSpec) -> DataFrame:
    """Of each block pair, the members that may be linked with one of another component there: rows of ``_MEMBER``, not pairs.

    ``members``: ``key, id, comp, keys`` and the sketches of buckets with several components. The bucket's largest
    component is not compared with itself; the other members are queries against all members. Queries and
    members of a bucket are cut in blocks of about ``block`` sets of 1,024 shingles, and every block of queries meets every
    block of members in a task of its own.
    """
    members = stored(members.withColumn("load", F.greatest("n", F.lit(1024))), "bucket-members")
    by_comp = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("load").alias("load"))
    main = F.max(F.struct(F.col("c"), (-F.col("comp")).alias("less"), F.col("load"))).alias("main")
    buckets = by_comp.groupBy("key").agg(main, F.sum("load").alias("all"))
    buckets = stored(buckets.select("key", (-F.col("main.less")).alias("main"), (F.col("all") - F.col("main.load")).alias("asked"), "all"), "buckets")
    m = members.join(buckets, "key").withColumn("of_main", F.col("comp") == F.col("main"))
    load = spec.block * 1024
    nq, nm = F.greatest(F.ceil(F.col("asked") / load), F.lit(1)), F.ceil(F.col("all") / load)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    place = lambda n: F.pmod(F.xxhash64("id"), n)
    asked = m.where("not of_main").withColumn("qb", place(nq)).withColumn("mb", upto(nm)).withColumn("member", F.lit(False)).select(*_MEMBER.names)
    there = m.withColumn("mb", place(nm)).withColumn("qb", upto(nq)).withColumn("member", F.lit(True)).select(*_MEMBER.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, hit = [], set()
        for block, row in _blocks(_rows(batches)):
            if row is None:
                out += [block.rows[i] for i in sorted(hit)]
                hit = set()
            elif len(near := block.near(row, spec)):
                out.append(row)
                hit.update(near.tolist())
            if len(out) > 4096:
                yield _batch(out, _MEMBER)
                out = []
        yield _batch(out, _MEMBER)

    return _by_block_pair(asked.unionByName(there)).mapInArrow(run, _MEMBER_DDL)


def _across(members: DataFrame, docs: DataFrame, spec: NearSpec) -> DataFrame:
    """Links ``(a, b)`` between different components of a bucket, enough to join all components that are linked.

    What :func:`_close` leaves is compared on full sets, block against block: a text travels once for each block pair in
    which it may be linked, however many pairs that is. Pairs whose components a link has joined in the task are passed over.
    """
    close = stored(_close(members, spec), "close-members")
    if close.isEmpty():
        return close.select(F.col("id").alias("a"), F.col("id").alias("b"))
    near = likely(docs, close.select(F.col("id").alias("doc_id")), ["doc_id"])
    texts = near.join(close, F.col("doc_id") == F.col("id")).select(*_MEMBER.names, "text")
    percent, size = spec.percent, spec.shingle
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        up: dict[int, int] = {}

        def root(c: int) -> int:
            while up.get(c, c) != c:
                c = up[c]
            return c

        # A text is cut into its set as it comes: a block holds sets.
        for block, row in _blocks((*r[:-1], shingle_set(r[-1], size)) for r in _rows(batches)):
            if row is None:
                up.clear()
                continue
            own = row[-1]
            for i in block.near(row, spec).tolist():
                a, b = root(block.rows[i][5]), root(row[5])
                if a == b:
                    continue
                other = block.rows[i][-1]
                both = len(np.intersect1d(other, own, assume_unique=True))
                if both and 100 * both >= percent * (len(other) + len(own) - both):
                    found.append((block.rows[i][4], row[4]))
                    up[max(a, b)] = min(a, b)
            if len(found) > 4096:
                yield _batch(found, out)
                found = []
        yield _batch(found, out)

    return stored(_by_block_pair(texts).mapInArrow(run, "a long, b long").distinct(), "confirmed-across")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: NearSpec = NearSpec()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Words are lower-cased (A-Z). Null, empty and white texts have no shingles and are linked with nothing. Rows
    that repeat a doc_id are one document, also if their texts differ: what any of its texts links to is reachable from it, and
    ``n_shingles`` is that of the row's text. A null doc_id is linked with nothing. An empty table gives an empty one.
    Other columns are not read.

    1. Documents with equal sets are one node from here on, found by a digest of the set. A node is named by a doc_id; the
       texts of an id that has several, and only those, get numbers of their own, and links that join them.
    2. Band buckets: every member is a candidate of the bucket's smallest node, never all pairs of a bucket.
    3. Size and odd sketches drop most false candidates; the rest is confirmed on full sets from the texts.
    4. Buckets whose members are not yet in one component are searched across components, by sketches in
       blocks, and what may be linked is compared on full sets, block against block; so no link between components is
       missed that shares a bucket.
    """
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    signed = stored(signatures(docs, spec), "signatures")
    named = _named(signed)
    nodes = signed.where("set_key is not null and doc_id is not null").withColumn("node", F.col("doc_id"))
    if named is not None:
        docs = _with_nodes(docs, named, spec)
        own = nodes.drop("node").join(named, ["doc_id", "set_key"], "left").withColumn("node", F.coalesce("node", "doc_id"))
        nodes = stored(own, "signed-nodes")
    reps = stored(nodes.groupBy("set_key").agg(F.min("node").alias("id"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), *(F.first(c).alias(c) for c in _SKETCH[1:])), "set-representatives")
    links = _links(reps, docs, spec)
    if named is None:
        sets = _components_of(reps, components(links))
        out = signed.select("doc_id", "n_shingles", "set_key").join(sets.hint("merge"), "set_key", "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
    # Texts of one id are linked through the nodes of their sets. A component that holds such an id is named anew, by the smallest id in it.
    at = named.join(reps.select("set_key", "id"), "set_key").select("doc_id", "id")
    same = at.join(at.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b"))
    sets = _components_of(reps, components(links.unionByName(same)))
    placed = named.join(sets, "set_key").select("doc_id", "component_id")
    anew = placed.groupBy("component_id").agg(F.min("doc_id").alias("smallest"))
    own = nodes.where(F.col("node") == F.col("doc_id")).join(sets, "set_key").join(anew.select("component_id"), "component_id")
    anew = stored(anew.unionByName(own.select("component_id", F.col("doc_id").alias("smallest"))).groupBy("component_id").agg(F.min("smallest").alias("smallest")), "components-named")
    sets = stored(sets.join(anew, "component_id", "left").select("set_key", F.coalesce("smallest", "component_id").alias("component_id")), "set-components-named")
    by_id = named.join(sets, "set_key").groupBy("doc_id").agg(F.min("component_id").alias("of_id"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(sets.hint("merge"), "set_key", "left").join(by_id, "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_id", "component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _named(signed: DataFrame) -> DataFrame | None:
    """``doc_id, set_key, node`` of the ids with several texts, None if there are none; sets that are empty have no node.

    Nodes are numbers that no doc_id has, above the largest one or, where that is near the end of the numbers, below the smallest.
    """
    key = F.xxhash64("set_key")
    several = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo <> hi").select("doc_id")
    if several.isEmpty():
        return None
    named = signed.join(stored(several, "several-texts"), "doc_id").where("set_key is not null").select("doc_id", "set_key").distinct()
    named = stored(named.withColumn("number", F.monotonically_increasing_id()), "text-numbers")
    low, high = signed.agg(F.min("doc_id"), F.max("doc_id")).first()
    count = named.agg(F.max("number")).first()[0] or 0
    if high + count < 2**63 - 1:
        node = F.col("number") + F.lit(high + 1)
    elif low - count > -(2**63):
        node = F.lit(low - 1) - F.col("number")
    else:
        raise ValueError("the ids leave no numbers for the texts of ids that have several")
    return stored(named.select("doc_id", "set_key", node.alias("node")), "text-nodes")


def _with_nodes(docs: DataFrame, named: DataFrame, spec: NearSpec) -> DataFrame:
    """``docs`` and, under their nodes, the texts of the ids in ``named``, which alone are read twice and written."""
    ids = stored(named.select("doc_id").distinct(), "ids-of-several")
    texts = likely(docs, ids, ["doc_id"]).join(ids, "doc_id")
    schema = pa.schema([("doc_id", pa.int64()), ("set_key", pa.binary()), ("text", pa.string())])

    def make():
        def row(key, text):
            s = shingle_set(text, spec.shingle)
            return key, xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, text

        return row

    keyed = texts.select("doc_id", "text").mapInArrow(per_row(schema, make), "doc_id long, set_key binary, text string")
    own = keyed.join(named, ["doc_id", "set_key"]).dropDuplicates(["node"]).select(F.col("node").alias("doc_id"), "text")
    return docs.unionByName(stored(own, "node-texts"))


def _components_of(reps: DataFrame, labels: DataFrame) -> DataFrame:
    return stored(reps.join(labels.withColumnRenamed("node", "id"), "id", "left").select("set_key", F.coalesce("component", "id").alias("component_id")), "set-components")


def _links(reps: DataFrame, docs: DataFrame, spec: NearSpec) -> DataFrame:
    """Confirmed links between the nodes ``reps`` (``id, n, keys`` and sketches), enough to join all that are linked; ``docs`` gives nodes' texts."""
    banded = reps.select("id", F.explode("keys").alias("key"))
    centres = stored(banded.groupBy("key").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "centre"), "centres")
    buckets = stored(banded.join(centres.hint("merge"), "key"), "bucket-stars")
    first = _near_enough(buckets.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), reps, spec)
    links = confirmed(first, docs, spec)
    labels = components(links)

    # The centre of a bucket was compared with all of it; buckets whose other members are of one component are done, as all of two are.
    others = buckets.where("id <> centre").join(labels.withColumnRenamed("node", "id"), "id", "left")
    labelled = stored(others.select("key", "id", F.coalesce("component", "id").alias("comp")), "labelled")
    open_keys = stored(labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key"), "open-buckets")
    members = labelled.join(open_keys, "key").join(reps.select("id", "keys", *_SKETCH), "id")
    return links.unionByName(_across(members, docs, spec))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: NearSpec = NearSpec()) -> DataFrame:
    """The rows of ``docs`` without those of a near-duplicate group's other documents, with all columns.

    Rows without shingles or with a null id stay, rows that repeat a kept id stay all; an empty table gives an
    empty one; columns may have any names.
    """
    gone = near_duplicates(docs, id_col, text_col, spec).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(stored(gone, "near-duplicates"), F.col(id_col) == F.col("__gone"), "left_anti")


def op2_odd_sketches(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), spec=NearSpec(shingle=2))

"""Integer product quantization: codebooks by k-means, entries screened in float32 and decided in int64."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.shared import stored


@dataclass(frozen=True)
class CodeSpec:
    """``parts`` equal parts of a vector, ``entries`` of a codebook, ``rounds`` of k-means, integers ``floor(scale * x)``."""

    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096


def _whole(vector: Column, scale: int) -> Column:
    """The integers of a vector, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", spec: CodeSpec = CodeSpec()) -> DataFrame:
    """``vec_id, label, q array<int>`` of the vectors that are not null and hold neither null nor non-finite components.

    Squared distances are taken in 64 bits, so ``len(vector) * (2 * |integer|)**2`` must stay below 2**62: vectors that
    do not fit (64 components beyond 32,767 at a scale of 4,096) are refused by an error, as are mixed lengths later on.
    """
    v = F.col("__v")
    finite = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = vectors[label_col] if label_col else F.lit(None).cast("int")
    kept = vectors.select(vectors[id_col].cast("long").alias("vec_id"), label.alias("label"), vectors[vector_col].cast("array<double>").alias("__v")).where(finite)
    most = F.sqrt(F.lit(2.0**60) / F.greatest(F.size("__v"), F.lit(1)))
    fits = F.forall(v, lambda x: F.abs(x * spec.scale) < most)
    q = F.when(fits, _whole(v, spec.scale).cast("array<int>")).otherwise(F.raise_error(F.lit("a component is too large for squared distances in 64 bits")).cast("array<int>"))
    return kept.select("vec_id", "label", q.alias("q"))


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each row of ``x`` the index of the nearest row of ``c``, the lower one of ties; both of int64.

    With ``s = |c|**2 - 2 x.c`` the nearest entry has the smallest ``s``. A float32 product of ``d`` terms, summed in any
    order, is off by at most ``g * |x| |c|``, ``g = (d + 4) u / (1 - (d + 4) u)``, ``u = 2**-24``, the rounding of its
    operands included; rounding ``|c|**2`` and the difference adds ``u`` of each. So each ``s`` lies in an interval,
    and only entries whose interval reaches below the lowest upper end can be nearest. Rows with one such entry are
    decided; of the others these entries are evaluated again in int64.
    """
    d, u = x.shape[1], 2.0**-24
    square = (c * c).sum(1)
    score = (square.astype(np.float32)[None, :] - np.float32(2) * (x.astype(np.float32) @ c.astype(np.float32).T)).astype(np.float64)
    both = 2 * np.sqrt((x * x).sum(1).astype(np.float64))[:, None] * np.sqrt(square.astype(np.float64))[None, :]
    g = (d + 4) * u / (1 - (d + 4) * u)
    off = (g * both + 4 * u * (square.astype(np.float64)[None, :] + both)) * (1 + 2.0**-20)
    open_ = score - off <= (score + off).min(1)[:, None]
    out = open_.argmax(1)
    rows = np.flatnonzero(open_.sum(1) > 1)
    if len(rows):
        at, entry = np.nonzero(open_[rows])
        exact = np.full((len(rows), len(c)), np.iinfo(np.int64).max)
        exact[at, entry] = ((x[rows[at]] - c[entry]) ** 2).sum(1)
        out[rows] = exact.argmin(1)
    return out


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    if (np.diff(column.offsets.to_numpy()) != d).any():
        raise ValueError(f"vectors of other lengths beside those of {d}")
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), d)


def _slices(d: int, parts: int) -> list[slice]:
    return [slice(i * (d // parts), (i + 1) * (d // parts)) for i in range(parts)]


def _moved(rows: DataFrame, books: np.ndarray, d: int) -> np.ndarray:
    """The codebooks after a round: sums and counts of each entry, in the task and then by Spark; unused entries stay.

    A task leaves ``parts * entries`` rows however many vectors it reads; ``entries * d`` numbers come back.
    """
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            for i, s in enumerate(_slices(d, parts)):
                own = i * entries + nearest(x[:, s], books[i])
                np.add.at(sums, own, x[:, s])
                counts += np.bincount(own, minlength=parts * entries)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["entry", "n", "sums"])

    moved = rows.select("q").mapInArrow(run, "entry long, n long, sums array<long>")
    both = moved.select("entry", F.posexplode(F.concat(F.array("n"), "sums")).alias("place", "x")).groupBy("entry", "place").agg(F.sum("x").alias("total"))
    out, totals = books.reshape(parts * entries, width).copy(), {}
    for entry, place, total in both.collect():
        totals.setdefault(entry, [0] * (width + 1))[place] = total
    for entry, (n, *total) in totals.items():
        out[entry] = [t // n for t in total]
    return out.reshape(books.shape)


def fitted(rows: DataFrame, spec: CodeSpec = CodeSpec()) -> np.ndarray | None:
    """Codebooks ``[part, entry, place]`` of :func:`quantized` rows; None if there are none.

    They start as the parts of the rows with the smallest ids (of equal ids the smaller vector, null ids last), fewer than ``entries`` if
    there are fewer rows. Only codebooks pass through the driver: ``entries`` integers for each component.
    """
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(spec.entries).select("q").collect()
    if not first:
        return None
    d = len(first[0][0])
    if d % spec.parts:
        raise ValueError(f"vectors of {d} components are not cut in {spec.parts} equal parts")
    if any(len(r[0]) != d for r in first):
        raise ValueError("vectors of different lengths")
    seeds = np.array([r[0] for r in first], np.int64).reshape(len(first), d)
    books = np.stack([seeds[:, s] for s in _slices(d, spec.parts)])
    for _ in range(spec.rounds):
        books = _moved(rows, books, d)
    return books


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of every row: entry indexes in part order, two hex digits each, and the squared distances' sum."""
    parts, _, width = books.shape
    d = parts * width
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), d)
            entry, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for i, s in enumerate(_slices(d, parts)):
                entry[:, i] = own = nearest(x[:, s], books[i])
                error += ((x[:, s] - books[i][own]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([e.tobytes().hex() for e in entry], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "q").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of the entries' components in decimal, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", spec: CodeSpec = CodeSpec()) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of every vector that :func:`quantized` keeps.

    ``label_error`` is the error summed over the rows of equal labels, nulls together. Rows that repeat an id give a row
    each and all count; a null id is kept, and starts a codebook entry only after all others. A table without vectors gives
    an empty one. Other columns are not read. Entries are numbered by one byte, so a codebook has 256 at most.
    """
    if not 1 <= spec.entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    rows = stored(quantized(vectors, id_col, vector_col, label_col, spec), "quantized")
    books = fitted(rows, spec)
    if books is None:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    codes = stored(encoded(rows, books), "codes")
    sums = codes.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    joined = codes.join(sums, F.col("label").eqNullSafe(F.col("__label")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op13_screened_codes(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return compressed(vectors).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _rounds(spec: CodeSpec) -> str:
    """An assignment and the next codebooks for each round, then the last assignment."""
    assign = """a{i} AS MATERIALIZED (
  SELECT p.row, p.part, arg_min(c.entry, {{'d': p.xx - 2 * list_inner_product(p.x, c.c) + list_inner_product(c.c, c.c), 'e': c.entry}}) AS entry,
         min(p.xx - 2 * list_inner_product(p.x, c.c) + list_inner_product(c.c, c.c)) AS d
  FROM p JOIN c{i} c ON p.part = c.part GROUP BY 1, 2)"""
    move = """m{j} AS (
  SELECT part, entry, list(floor(s / n) ORDER BY place) AS c FROM (
    SELECT part, entry, place, sum(x) AS s, count(*) AS n FROM (
      SELECT p.part, a.entry, unnest(p.x) AS x, unnest(range(len(p.x))) AS place FROM p JOIN a{i} a ON p.row = a.row AND p.part = a.part)
    GROUP BY 1, 2, 3) GROUP BY 1, 2),
c{j} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN m{j} m ON c.part = m.part AND c.entry = m.entry)"""
    n = spec.rounds
    return ",\n".join([*(assign.format(i=i) + ",\n" + move.format(i=i, j=i + 1) for i in range(n)), assign.format(i=n)])


#: Integers stay below 2**53, so DuckDB's doubles are exact.
OP13_SQL = f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS row, vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 4096)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT row, part, x, list_inner_product(x, x) AS xx FROM (
    SELECT row, part, q[part * (len(q) // 8) + 1 : (part + 1) * (len(q) // 8)] AS x FROM v, (SELECT unnest(range(8)) AS part))),
c0 AS MATERIALIZED (SELECT part, row AS entry, x AS c FROM p WHERE row < 16),
{_rounds(CodeSpec())},
k AS (
  SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM (
    SELECT part, entry, unnest(c) AS x, unnest(range(len(c))) AS place FROM c6)),
e AS (
  SELECT row, string_agg(lower(printf('%02x', CAST(entry AS INTEGER))), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY 1)
SELECT v.vec_id, e.code, e.error, CAST(sum(e.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, k.codebooks_sha256
FROM v JOIN e ON v.row = e.row, k
"""

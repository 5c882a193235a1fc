"""Quality rules: compression bands over whole documents and fixed chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm._text import WHITE, covered, documents, per_row, slices, window_hashes, word_hashes

_SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio (compressed bytes / bytes) by length.

    ``limits``: (bytes below which the band holds, lowest ratio, highest ratio), ascending. Short texts
    compress badly, so the lowest band has no limits at all. ``chunk``: bytes of a chunk; a rest of less
    than half a chunk is part of the last one, and a text of less than half a chunk has none: its band measures
    the same bytes. ``chunk_limits`` hold for chunks; a text is rejected if more than
    ``max_bad_chunks`` of its chunks are outside.
    """

    limits: tuple[tuple[float, float, float], ...] = (
        (200, 0.0, 9.0),
        (400, 0.36, 0.95),
        (800, 0.32, 0.85),
        (1600, 0.28, 0.80),
        (3200, 0.25, 0.72),
        (12800, 0.22, 0.68),
        (float("inf"), 0.20, 0.62),
    )
    chunk: int = 2048
    chunk_limits: tuple[float, float] = (0.18, 0.80)
    max_bad_chunks: float = 0.5
    level: int = 3


@dataclass(frozen=True)
class Measures:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    ratio: float
    bad_chunks: float
    base_failed: bool
    kept: bool


def measurer(bands: Bands = Bands()) -> Callable[[str | None], Measures]:
    """A function of a text; it holds one compressor, so make one a task."""
    zstd = zstandard.ZstdCompressor(level=bands.level)

    def measure(text: str | None) -> Measures:
        text = text or ""
        raw = text.encode()
        h = word_hashes(raw)
        n = len(h)
        seen: set[str] = set()
        dup_lines = 0
        for line in text.split("\n"):
            if line.strip(WHITE):
                dup_lines += line in seen
                seen.add(line)
        repeat = 0
        if n > 8:
            w = window_hashes(h, 8)
            _, back, count = np.unique(w, return_inverse=True, return_counts=True)
            if len(count) < len(w):
                repeat = int(covered(np.flatnonzero(count[back] > 1), 8, n).sum())
        size = len(raw)
        ratio = len(zstd.compress(raw)) / size if size else 0.0
        low, high = next(x[1:] for x in bands.limits if size < x[0])
        bad = total = 0
        ends = list(range(bands.chunk, size, bands.chunk))
        if ends and 2 * (size - ends[-1]) < bands.chunk:
            ends.pop()
        for at, end in zip([0, *ends], [*ends, size] if 2 * size >= bands.chunk else []):
            part = raw[at:end]
            total += 1
            bad += not bands.chunk_limits[0] <= len(zstd.compress(part)) / len(part) <= bands.chunk_limits[1]
        bad_chunks = bad / total if total else 0.0
        failed = n < 20 or 100 * repeat > 30 * n
        return Measures(
            n_words=n,
            word_chars=len(text) - (size - len(raw.translate(None, WHITE.encode()))),
            n_symbols=size - len(raw.translate(None, _SYMBOLS)),
            n_dup_lines=dup_lines,
            n_repeat_words=repeat,
            ratio=ratio,
            bad_chunks=bad_chunks,
            base_failed=failed,
            kept=not failed and low <= ratio <= high and bad_chunks <= bands.max_bad_chunks,
        )

    return measure


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """Measures and verdict of every whole text: the columns of :class:`Measures` after the id.

    A null or empty text has no words and fails. Repeated rows and equal ids give a row each; other columns
    of ``docs`` are not read, so their names cannot clash. An empty table gives an empty table. One pass, no
    shuffle; a task holds one Arrow batch.
    """
    fields = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("ratio", pa.float64()), ("bad_chunks", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
    schema = pa.schema([(id_col, pa.int64()), *fields])

    def make() -> Callable:
        measure = measurer(bands)
        return lambda key, text: (key, *vars(measure(text)).values())

    out = f"`{id_col}` long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, bad_chunks double, base_failed boolean, kept boolean"
    return docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias(text_col)).mapInArrow(per_row(schema, make), out)


def keep_quality(docs: DataFrame, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all their columns, whatever their names.

    Null and empty texts go, repeated rows are judged alike; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = measurer(bands)
        for batch in (part for batch in batches for part in slices(batch)):
            yield batch.filter(pa.array([measure(x).kept for x in batch.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def agreement(docs: DataFrame, labels: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """``quality, kept, n``: how many labelled documents of each quality are kept and rejected; precision and recall follow."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), "quality").where(F.col("quality").isNotNull())
    return quality_report(docs, bands=bands).select("doc_id", "kept").join(known, "doc_id").groupBy("quality", "kept").agg(F.count(F.lit(1)).alias("n"))


def op10_compression_bands(spark, sf_dir: str) -> DataFrame:
    return quality_report(documents(spark, sf_dir))

"""Small helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

#: ASCII white space, which separates words (fixed values).
WHITE = " \t\n\x0b\x0c\r"

_WINDOW_SEED = np.uint64(0x9E3779B97F4A7C15)


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of non-white characters in UTF-8; ``bytes.split`` splits at just the six characters of WHITE."""
    return text.encode().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
_FACTOR = int(_rng.integers(0, 2**62)) * 4 + 3
_SOLID = np.array([chr(i) not in WHITE for i in range(256)])
_CHUNK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


_UP, _DOWN = _powers(_FACTOR, _CHUNK), _powers(pow(_FACTOR, -1, 2**64), _CHUNK)


def _chunk_hashes(b: np.ndarray) -> np.ndarray:
    solid = np.zeros(len(b) + 2, np.int8)
    solid[1:-1] = _SOLID[b]
    change = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = change[::2], change[1::2]
    whole = len(b) <= _CHUNK
    up, down = (_UP, _DOWN) if whole else (_powers(_FACTOR, len(b)), _powers(pow(_FACTOR, -1, 2**64), len(b)))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
    size = (end - start).astype(np.uint64)
    out = mixed((total[end] - total[start]) * down[start] + size * _LENGTH)
    for i in np.flatnonzero(size > 64):
        out[i] = xxhash.xxh3_64_intdigest(b[start[i] : end[i]].tobytes())
    return out


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text in UTF-8, words as in :func:`words_of`.

    A word of up to 64 bytes is a polynomial in an odd number modulo 2**64, scrambled: all words of a chunk come
    from one running sum over its bytes. Longer words have a hash of their own. Chunks end at white space, so an array
    holds 64 KiB of text or one longer word.
    """
    data, n, at, parts = np.frombuffer(raw, np.uint8), len(raw), 0, []
    while at < n:
        end = min(at + _CHUNK, n)
        if end < n and _SOLID[data[end]]:
            back = np.flatnonzero(~_SOLID[data[at:end]])
            while len(back) == 0 and end < n:
                step = np.flatnonzero(~_SOLID[data[end : end + _CHUNK]])
                end = end + int(step[0]) if len(step) else min(end + _CHUNK, n)
                if len(step):
                    break
            if len(back):
                end = at + int(back[-1]) + 1
        parts.append(_chunk_hashes(data[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


_FACTORS = _rng.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def combined(h: np.ndarray, step: int, count: int) -> np.ndarray:
    """Hash of each ``count`` (at most 8) values that stand ``step`` apart: their sum by fixed odd factors, scrambled."""
    n = len(h) - step * (count - 1)
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n] * _FACTORS[0]
    for i in range(1, count):
        out += h[i * step : i * step + n] * _FACTORS[i]
    return mixed(out)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive values; runs longer than 8 are joined from runs of 1, 2, 4..."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if size <= len(_FACTORS):
        return combined(h, 1, size)
    out, done, power, width = None, 0, h, 1
    rest = size
    while rest:
        if rest & 1:
            part = power[done : done + n]
            out = part if out is None else mixed(out * _WINDOW_SEED + part + np.uint64(width))
            done += width
        rest >>= 1
        if rest:
            power = mixed(power[:-width] * _WINDOW_SEED + power[width:] + np.uint64(width))
            width *= 2
    return out


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Of ``n`` places, those inside a window of ``size`` places at one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge[:n]) > 0


def slices(batch: pa.RecordBatch, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with at most ``most`` bytes of strings and binaries, or of one row that has more.

    What a task makes of a batch in Python is several times its size, so it is made of one run at a time.
    """
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    upto, lo = np.cumsum(sizes), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, most + (upto[lo - 1] if lo else 0), side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def per_row(schema: pa.Schema, make: Callable[[], Callable], most: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: one output row (a tuple) for each input row; ``make`` is called once a task.

    ``most``: bytes of texts that are taken at once, see :func:`slices`; by default those of a whole batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for batch in batches if most is None else (part for batch in batches for part in slices(batch, most)):
            if batch.num_rows:
                out = [row(*x) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run

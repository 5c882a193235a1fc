"""The range of each key among sorted splitters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Splitters up to which a literal array is scanned; more go through a binary search on Arrow batches.
_FEW = 64


def _as_words(keys: pa.Array, width: int) -> np.ndarray:
    """Keys of at most ``width`` bytes as rows of big-endian 64-bit words, the length as the last one."""
    size = -(-width // 8) * 8
    lengths = np.diff(np.frombuffer(keys.buffers()[1], np.int32, len(keys) + 1, keys.offset * 4))
    if len(keys) and (lengths == width).all() and not keys.null_count:
        first = int(np.frombuffer(keys.buffers()[1], np.int32, 1, keys.offset * 4)[0])
        data = np.frombuffer(keys.buffers()[2], np.uint8, len(keys) * width, first).reshape(-1, width)
        padded = np.zeros((len(keys), size), np.uint8)
        padded[:, :width] = data
    else:
        padded = np.frombuffer(b"".join(k[:size].ljust(size, b"\0") for k in keys.to_pylist()), np.uint8).reshape(-1, size)
    words = np.ascontiguousarray(padded).view(">u8").astype(np.uint64)
    return np.column_stack([words, lengths.astype(np.uint64)])


def _upto(rows: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """For each row the number of ``cuts`` (ascending rows) that are <= it, by a binary search of all rows at once."""
    lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(cuts))
    for _ in range(len(cuts).bit_length()):
        mid = np.minimum((lo + hi) // 2, len(cuts) - 1)
        at, more = cuts[mid], np.zeros(len(rows), bool)
        equal = np.ones(len(rows), bool)
        for c in range(rows.shape[1]):
            more |= equal & (at[:, c] < rows[:, c])
            equal &= at[:, c] == rows[:, c]
        right = (more | equal) & (lo < hi)
        lo, hi = np.where(right, mid + 1, lo), np.where(~right & (lo < hi), mid, hi)
    return lo


def range_assign(df: DataFrame, key: str, splitters: Sequence[bytes]) -> DataFrame:
    """Add ``pid``, the number of splitters <= key (unsigned bytes): a key equal to a splitter goes right.

    More than 64 splitters are searched in Arrow batches, a whole batch at a time; keys are then not null.
    """
    if len(splitters) <= _FEW:
        pid = F.size(F.filter(F.array(*map(F.lit, map(bytes, splitters))), lambda s: s <= F.col(key))) if splitters else F.lit(0)
        return df.withColumn("pid", pid.cast("int"))
    plain = [bytes(s) for s in splitters]

    @F.arrow_udf("int")
    def find(keys: pa.Array) -> pa.Array:
        keys = keys.cast(pa.binary())
        longest = max(max(map(len, plain)), int(np.diff(np.frombuffer(keys.buffers()[1], np.int32, len(keys) + 1, keys.offset * 4)).max(initial=0)))
        return pa.array(_upto(_as_words(keys, longest), _as_words(pa.array(plain, pa.binary()), longest)), pa.int32())

    return df.withColumn("pid", find(F.col(key)))

"""Order statistics of keys that no task holds together: mergeable quantile summaries, refined by exact counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeloom.operators.ranges import range_assign
from rangeloom.shared import stored

_SIGN = -(2**63)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def sort_key(df: DataFrame, cols: Sequence[str]) -> Column:
    """One binary column that sorts as ``cols`` do, nulls first: text of hexadecimal digits, so a shorter value sorts first.

    Whole numbers, dates, times, booleans, strings and binaries; others have no such text here and are refused.
    """
    parts = []
    for c in cols:
        kind, x = df.schema[c].dataType, F.col(c)
        if isinstance(kind, _WHOLE):
            whole = F.unix_micros(x.cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else F.unix_date(x) if isinstance(kind, T.DateType) else x.cast("int") if isinstance(kind, T.BooleanType) else x
            text = F.lpad(F.hex(whole.cast("long").bitwiseXOR(F.lit(_SIGN))), 16, "0")
        elif isinstance(kind, (T.StringType, T.BinaryType)):
            text = F.concat(F.hex(x.cast("binary")), F.lit("!"))  # less than any digit
        else:
            raise TypeError(f"{c} of {kind.simpleString()} has no sort key")
        parts.append(F.when(x.isNull(), "0").otherwise(F.concat(F.lit("1"), text)))
    return F.concat(*parts).cast("binary")


class Summary:
    """Quantile summary of binary values in levels: an item of level h stands for 2**h values.

    A level that is full is sorted and every other item goes one level up, from the first or the second by turns. Each
    such step moves no rank by more than 2**h, so ``error``, the sum over all steps, bounds how far any rank is off, for
    certain; errors of either sign mostly cancel. Summaries merge by joining their levels; errors add.
    """

    def __init__(self, size: int) -> None:
        self.size, self.levels, self.count, self.error, self._turn = size, [], 0, 0, 0

    def _put(self, h: int, values: pa.Array) -> None:
        while len(self.levels) <= h:
            self.levels.append([])
        self.levels[h].append(values)
        if sum(map(len, self.levels[h])) >= 2 * self.size:
            self._compact(h)

    def _compact(self, h: int) -> None:
        items = _sorted(self.levels[h])
        even = len(items) // 2 * 2
        self.levels[h] = [items.slice(even)] if even < len(items) else []
        self._turn ^= 1
        self.error += 1 << h
        self._put(h + 1, items.take(pa.array(np.arange(self._turn, even, 2))))

    def add(self, values: pa.Array) -> None:
        if len(values):
            self.count += len(values)
            self._put(0, values.cast(pa.binary()))

    def merge(self, levels: list[tuple[int, pa.Array]], count: int, error: int) -> None:
        self.count, self.error = self.count + count, self.error + error
        for h, items in levels:
            self._put(h, items)

    def rows(self, number: int) -> pa.RecordBatch:
        """A row for each level: ``number, count, error, level, items``; count and error stand in the first."""
        held = [(h, _sorted(x)) for h, x in enumerate(self.levels) if x] or [(0, pa.array([], pa.binary()))]
        first = [i == 0 for i in range(len(held))]
        items = pa.array([x.to_pylist() for _, x in held], pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array([number] * len(held)), pa.array([self.count if f else 0 for f in first]), pa.array([self.error if f else 0 for f in first]), pa.array([h for h, _ in held], pa.int32()), items], names=["number", "count", "error", "level", "items"])

    def quantiles(self, n: int) -> list[bytes]:
        """``n - 1`` values that cut the summarised ones in ``n`` about equal parts, without repeats."""
        held = [(h, _sorted(x)) for h, x in enumerate(self.levels) if sum(map(len, x))]
        if not held:
            return []
        values = pa.concat_arrays([x for _, x in held])
        weight = np.concatenate([np.full(len(x), 1 << h, np.int64) for h, x in held])
        by = pc.array_sort_indices(values)
        upto = np.cumsum(weight[by.to_numpy()])
        at = np.minimum(np.searchsorted(upto, np.arange(1, n) * (upto[-1] / n), side="right"), len(upto) - 1)
        return list(dict.fromkeys(values.take(by.take(pa.array(at))).to_pylist()))


def _sorted(parts: list[pa.Array]) -> pa.Array:
    x = pa.concat_arrays(parts)
    return x.take(pc.array_sort_indices(x))


_ROW = "number long, count long, error long, level int, items array<binary>"


def quantile_summary(df: DataFrame, key: str, size: int = 2048, together: int = 64) -> Summary:
    """A :class:`Summary` of all values of the binary column ``key``, nulls left out; one pass. Runs jobs.

    A task keeps at most ``2 * size`` items a level. Tasks' summaries are merged ``together`` at a time, in as many rounds as
    it takes until one task has merged them, so neither a task nor the driver holds more than ``together`` of them.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = Summary(size)
        for batch in batches:
            own.add(batch.column(0).drop_null())
        yield own.rows(TaskContext.get().partitionId())

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            for number, count, error, level, items in zip(*(batch.column(i) for i in range(5)), strict=True):
                if number.as_py() != at:
                    if own:
                        yield own.rows(at)
                    at, own = number.as_py(), Summary(size)
                own.merge([(level.as_py(), items.values)], count.as_py(), error.as_py())
        if own:
            yield own.rows(at)

    rows = stored(df.select(F.col(key).cast("binary")).mapInArrow(each, _ROW), "summaries")
    while (n := rows.agg(F.max("number")).first()[0] or 0) > 0:
        group = F.expr(f"number div {together}")
        parts = n // together + 1
        near = rows.withColumn("number", group).repartition(parts, "number").sortWithinPartitions("number", "level")
        rows = stored(near.mapInArrow(merged, _ROW), "summaries")
    out = Summary(size)
    for r in rows.orderBy("level").collect():
        out.merge([(r.level, pa.array([bytes(x) for x in r.items], pa.binary()))], r["count"], r.error)
    return out


def range_counts(df: DataFrame, key: str, cuts: Sequence[bytes]) -> np.ndarray:
    """How many values lie in each of the ``len(cuts) + 1`` ranges, exactly: partial counts in the task, one number for each range."""
    counts = np.zeros(len(cuts) + 1, np.int64)
    for pid, n in range_assign(df.select(key), key, cuts).groupBy("pid").agg(F.count(F.lit(1))).collect():
        counts[pid] = n
    return counts


def balanced_cuts(df: DataFrame, key: str, p: int, size: int = 2048, fine: int = 16) -> tuple[list[bytes], np.ndarray]:
    """``p - 1`` cuts of the binary column ``key`` in ranges of about equal size, and the exact sizes of the ranges. Runs jobs.

    A summary gives ``fine * p`` candidates, a second pass counts what lies between them, and of the candidates those
    nearest to the targets are taken. A range then has at most the mean and one range of candidates more, but for a value that is
    itself more frequent: equal values are never parted. There are fewer cuts where there are fewer values.
    """
    rows = df.select(key).where(F.col(key).isNotNull())
    candidates = quantile_summary(rows, key, max(size, 4 * p)).quantiles(fine * p)
    counts = range_counts(rows, key, candidates)
    before = np.cumsum(counts)
    chosen: list[int] = []
    for target in np.arange(1, p) * (before[-1] / p):
        i = int(np.abs(before[:-1] - target).argmin()) if len(candidates) else -1
        if i >= 0 and (not chosen or i > chosen[-1]) and 0 < before[i] < before[-1]:
            chosen.append(i)
    return [candidates[i] for i in chosen], np.diff(np.concatenate([[0], before[chosen], before[-1:]]).astype(np.int64))

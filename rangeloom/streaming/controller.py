"""The A/B controller as a stream: constant state for each key, kept by buckets of keys, early jobs waiting until their turn."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

_OUT = "key long, seq long, cycle int, slot int, r_used int"
#: Key of a job that only moves the watermark (fixed value).
CLOSING = -(2**63)
#: Rows of a part of the output.
_PART = 100_000
_JOB = (("key", np.dtype("<i8")), ("order", np.dtype("<i8")), ("tie", np.dtype("<i8")), ("cost", np.dtype("<f8")))
#: What is kept of a key: job count, last pair of order and tie, r, trial costs of the open cycle, when it was last seen.
_KEPT = np.dtype([(n, "<i8") for n in ("key", "seq", "last", "last_tie", "r", "seen")] + [(n, "<f8") for n in ("a1", "b1", "a2")])
_TRIALS = ("a1", "b1", "a2")
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Controller(StatefulProcessor):
    """State of a bucket of keys: a row of ``_KEPT`` for each key, packed and sorted by key, and a list of the jobs that wait.

    A job waits until the watermark has passed its order, as jobs before it may still come; a timer at the earliest waiting job's
    order wakes the bucket. Then the jobs that are due are taken by (order, tie), so the result does not depend on how they
    came. A pair that was taken is not taken again. The list holds the jobs of the watermark's delay, as packed columns of a
    micro-batch each; a key's row is of constant size. With ``idle`` a key that has no job for so long is forgotten, and begins
    anew if one comes. Calls to the state store go by bucket and micro-batch, not by key; a micro-batch reads and writes 72 bytes
    for each key of the buckets that it meets.
    """

    def __init__(self, r0: int, max_r: int, interval: int, idle: int | None) -> None:
        self.r0, self.max_r, self.interval, self.idle = r0, max_r, interval, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("controllers", "keys binary")
        self.waiting = handle.getListState("waiting", "key binary, order binary, tie binary, cost binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        jobs = tuple(map(np.concatenate, zip(*(tuple(x[c].to_numpy(t) for c, t in _JOB) for x in rows), strict=True)))
        if (real := jobs[0] != CLOSING).any():
            jobs = tuple(c[real] for c in jobs)
            self.waiting.appendValue(tuple(c.tobytes() for c in jobs))
            self.handle.registerTimer(_ms(int(jobs[1].min())))
            if self.idle is not None:
                kept, at = self._with(self._kept(), jobs[0])
                np.maximum.at(kept["seen"], at, jobs[1])
                self.value.update((kept.tobytes(),))
                self.handle.registerTimer(_ms(int(kept["seen"][at].min()) + self.idle))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        chunks = [[np.frombuffer(x, t) for x, (_, t) in zip(c, _JOB, strict=True)] for c in self.waiting.get()] if self.waiting.exists() else []
        # An earlier timer may find jobs of a later one due; that one then finds nothing.
        jobs = tuple(map(np.concatenate, zip(*chunks, strict=True))) if chunks else ()
        due = jobs[1] <= passed if chunks else np.zeros(0, bool)
        if due.any():
            if due.all():
                self.waiting.clear()
            else:
                self.waiting.put([tuple(c[~due].tobytes() for c in jobs)])
                self.handle.registerTimer(_ms(int(jobs[1][~due].min())))
            kept, taken = self._taken(self._kept(), *(c[due] for c in jobs))
            self.value.update((kept.tobytes(),))
            for i in range(0, len(taken), _PART):
                yield taken.iloc[i : i + _PART]
        if self.idle is not None:
            self._forget(passed)

    def close(self) -> None:
        pass

    def _kept(self) -> np.ndarray:
        return np.frombuffer(bytearray(self.value.get()[0]), _KEPT) if self.value.exists() else np.zeros(0, _KEPT)

    def _with(self, kept: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``kept`` with a row for each of ``keys``, and the rows' places."""
        if len(new := np.setdiff1d(keys, kept["key"])):
            rows = np.zeros(len(new), _KEPT)
            rows["key"], rows["r"] = new, self.r0
            for t in _TRIALS:
                rows[t] = np.nan
            kept = np.concatenate([kept, rows])
            kept = kept[np.argsort(kept["key"])]
        return kept, np.searchsorted(kept["key"], keys)

    def _forget(self, passed: int) -> None:
        """Drop keys that were not seen for ``idle``; one whose job waits was seen after the watermark."""
        kept = self._kept()
        stays = kept["seen"] + self.idle > passed
        if not stays.all():
            self.value.update((kept[stays].tobytes(),)) if stays.any() else self.value.clear()
        if stays.any():
            self.handle.registerTimer(_ms(int(kept["seen"][stays].min()) + self.idle))

    def _taken(self, kept: np.ndarray, key: np.ndarray, order: np.ndarray, tie: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
        """What is kept after the jobs, and the rows that they give. A key's jobs stand one behind the other: a run."""
        by = np.lexsort((tie, order, key))
        key, order, tie, cost = key[by], order[by], tie[by], cost[by]
        kept, at = self._with(kept, key)
        last, last_tie = kept["last"][at], kept["last_tie"][at]
        fresh = (kept["seq"][at] == 0) | (order > last) | ((order == last) & (tie > last_tie))
        fresh[1:] &= (key[1:] != key[:-1]) | (order[1:] != order[:-1]) | (tie[1:] != tie[:-1])
        key, order, tie, cost, at = (c[fresh] for c in (key, order, tie, cost, at))
        n = len(key)
        first = np.ones(n, bool)
        first[1:] = key[1:] != key[:-1]
        starts, run = np.flatnonzero(first), np.cumsum(first) - 1
        place = np.arange(n) - starts[run] if n else np.zeros(0, int)
        seq = kept["seq"][at] + place
        cycle, slot = np.divmod(seq, self.interval + 4)
        trial = slot - self.interval

        def back(jobs, steps, field):
            """The cost ``steps`` jobs before each of ``jobs``: in its run, or kept from an earlier micro-batch."""
            return np.where(place[jobs] >= steps, cost[np.maximum(jobs - steps, 0)], kept[field][at[jobs]])

        closed = np.flatnonzero(trial == 3)
        a1, b1, a2, b2 = back(closed, 3, "a1"), back(closed, 2, "b1"), back(closed, 1, "a2"), cost[closed]
        moves = np.where((a1 < b1) & (a2 < b2), 1, np.where((b1 < a1) & (b2 < a2), -1, 0))
        # r after each cycle that closed; a run begins with the r that was kept.
        after, r, of = [], 0, -1
        for move, i, begin in zip(moves.tolist(), run[closed].tolist(), kept["r"][at[closed]].tolist(), strict=True):
            r, of = min(self.max_r, max(1, (r if i == of else begin) + move)), i
            after.append(r)
        after = np.array(after, np.int64)

        def r_at(jobs, cycles):
            """r of each of ``jobs`` when the first ``cycles`` of ``closed`` are done."""
            if not len(closed):
                return kept["r"][at[jobs]]
            own = (cycles > 0) & (run[closed[np.maximum(cycles - 1, 0)]] == run[jobs])
            return np.where(own, after[np.maximum(cycles - 1, 0)], kept["r"][at[jobs]])

        done = np.cumsum(trial == 3)
        used = r_at(np.arange(n), done - (trial == 3))
        used = np.where(trial < 0, used, np.where(trial % 2 == 0, np.minimum(self.max_r, used + 1), np.maximum(1, used - 1)))
        ends = np.append(starts[1:], n)[: len(starts)] - 1
        rows, t = at[ends], trial[ends]
        trials = [np.where((t < k) | (t == 3), np.nan, back(ends, np.maximum(t - k, 0), f)) for k, f in enumerate(_TRIALS)]
        last_r = r_at(ends, done[ends])
        for f, x in zip(("seq", "last", "last_tie", "r", *_TRIALS), (seq[ends] + 1, order[ends], tie[ends], last_r, *trials), strict=True):
            kept[f][rows] = x
        return kept, pd.DataFrame({"key": key, "seq": seq, "cycle": cycle, "slot": slot, "r_used": used})


def _ms(micros: int) -> int:
    """The first millisecond of a watermark that has passed a time in microseconds."""
    return -(-micros // 1000)


def tune_stream(jobs: DataFrame, r0: int = 1, max_r: int = 5, interval: int = 10, delay: str = "10 seconds", idle: str | None = None, buckets: int = 1024) -> DataFrame:
    """``key, seq, cycle, slot, r_used`` for a stream of finished jobs (``key, order, cost`` and, optionally, ``tie``).

    ``order`` is a job's time in microseconds. Jobs of a key are told apart and taken by (``order``, ``tie``); without a ``tie``
    it is 0; jobs without a key or a time are none. They may come in any order as long as none comes ``delay`` after a later one: until then jobs wait in the
    state, so the result equals the batch operators' on the same jobs; those beyond are dropped as late. Jobs leave when
    the watermark has passed them, the last ones when something later has come, see :func:`closing`. ``idle``: a key
    that has no job for this long is forgotten. ``buckets``: keys are dealt by hash to so many groups, whose state is kept
    together; it is fixed for a checkpoint. The state needs Spark's RocksDB store, see :func:`start`.
    """
    spark = jobs.sparkSession
    micros = spark.sql(f"SELECT INTERVAL {idle} AS i").select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.col("i"))).first()[0] if idle else None
    jobs = jobs.select("key", "order", ("tie" if "tie" in jobs.columns else F.lit(0)), "cost").toDF("key", "order", "tie", "cost")
    timed = jobs.where(F.col("key").isNotNull() & F.col("order").isNotNull()).withColumns({"key": F.col("key").cast("long"), "tie": F.col("tie").cast("long"), "cost": F.col("cost").cast("double"), "time": F.timestamp_micros("order")}).withWatermark("time", delay)
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
    return timed.select(bucket, "*").groupBy("bucket").transformWithStateInPandas(Controller(r0, max_r, interval, micros), _OUT, "append", "EventTime")


def closing(jobs: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """One job of no real key, ``delay`` and a second after all of ``jobs``: put behind them it lets all of them leave."""
    last = jobs.agg(F.max("order").alias("order"))
    at = F.unix_micros(F.timestamp_micros("order") + F.expr(f"INTERVAL {delay}") + F.expr("INTERVAL 1 second"))
    return last.where("order is not null").select(F.lit(CLOSING).alias("key"), at.alias("order"), F.lit(0).cast("long").alias("tie"), F.lit(0.0).alias("cost"))


def start(tuned: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start :func:`tune_stream`'s result as a query that appends to Parquet files at ``path``, with its state in RocksDB."""
    conf = tuned.sparkSession.conf
    before = conf.get(_STORE, None)
    conf.set(_STORE, _ROCKSDB)
    try:
        return tuned.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
    finally:
        conf.set(_STORE, before) if before else conf.unset(_STORE)

"""A/B trials that tune a replication factor: cost, cycle slots, decisions, trajectory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.operators.records import place_in_group
from rangeloom.shared import stored

#: Cost of a unit of computation in units of network load: 0.5 * 1e7 (fixed value).
COMPUTATION = 5e6


def cost(comp: Column, net: Column) -> Column:
    """Lower is better."""
    return COMPUTATION * comp + net


def arms(r: Column, max_r: int) -> tuple[Column, Column]:
    """Candidate A one above r, B one below, both within 1..max_r."""
    return F.least(r + 1, F.lit(max_r)), F.greatest(r - 1, F.lit(1))


def cycle_slots(df: DataFrame, key: str, order_cols: Sequence[str], interval: int = 10) -> DataFrame:
    """Add ``seq``, ``cycle`` and ``slot``: ``interval`` jobs as usual, then the trials 1A 1B 2A 2B, and again.

    Jobs are numbered in sorted ranges, so that a key of many jobs is spread over tasks. Runs a job that writes them.
    """
    return place_in_group(df, [key], order_cols, "seq").withColumn("cycle", F.expr(f"seq div {interval + 4}").cast("int")).withColumn("slot", F.col("seq") % (interval + 4))


def trial_decisions(slots: DataFrame, key: str, interval: int = 10) -> DataFrame:
    """``key, cycle, decision`` of complete cycles: 1 if A is cheaper in both trials, -1 if B is in both, else 0.

    ``slots`` has ``cost`` besides :func:`cycle_slots`'s columns.
    """
    pick = lambda i: F.max(F.when(F.col("slot") == interval + i, F.col("cost")))
    trials = slots.where(F.col("slot") >= interval).groupBy(key, "cycle")
    t = trials.agg(pick(0).alias("a1"), pick(1).alias("b1"), pick(2).alias("a2"), pick(3).alias("b2"), F.count(F.lit(1)).alias("c")).where("c = 4")
    up, down = (F.col("a1") < F.col("b1")) & (F.col("a2") < F.col("b2")), (F.col("b1") < F.col("a1")) & (F.col("b2") < F.col("a2"))
    return t.select(key, "cycle", F.when(up, 1).when(down, -1).otherwise(0).alias("decision"))


def _clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(x, lo), hi)


def r_trajectory(decisions: DataFrame, key: str, r0: int, max_r: int, block: int = 256) -> DataFrame:
    """``key, cycle, r``: r in force during each decided cycle and the one after the last. Runs jobs that write blocks of cycles.

    ``r`` moves by the decision and is clamped to 1..max_r. A run of decisions acts on r as ``clamp(r + shift, lo,
    hi)``, and such steps compose: cycles are reduced in blocks, blocks in blocks of blocks and so on until a key has one,
    and then r is handed down again, so no list holds more than ``block`` steps however many cycles a key has.
    """
    steps = decisions.select(key, F.col("cycle").cast("long").alias("at"), F.col("decision").alias("shift"), F.lit(1).alias("lo"), F.lit(max_r).alias("hi"))
    levels = []
    while True:
        blocks = steps.groupBy(key, F.expr(f"at div {block}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "shift", "lo", "hi"))).alias("steps"))
        levels.append(stored(blocks, "trajectory"))
        if not levels[-1].agg(F.max("block")).first()[0]:
            break
        nothing = F.struct(F.lit(0).alias("shift"), F.lit(-(2**30)).alias("lo"), F.lit(2**30).alias("hi"))
        shape = F.aggregate("steps", nothing, _then)
        steps = levels[-1].withColumn("shape", shape).select(key, F.col("block").alias("at"), "shape.*")
    at_start = levels[-1].withColumns({"start": F.lit(r0), "last": F.lit(True)})
    inside = F.aggregate("steps", F.array(F.col("start")), lambda acc, s: F.concat(acc, F.array(_clamp(F.element_at(acc, -1) + s["shift"], s["lo"], s["hi"]))))
    for below in [*reversed(levels[:-1]), None]:
        lines = at_start.select(key, "last", F.size("steps").alias("n"), F.element_at("steps", 1)["at"].alias("first"), F.posexplode(inside).alias("pos", "r"))
        if below is None:
            # What a block ends with is what the next begins with; only the last block has no next.
            return lines.where("pos < n or last").select(key, (F.col("first") + F.col("pos")).cast("int").alias("cycle"), "r")
        starts = lines.where("pos < n").select(key, (F.col("first") + F.col("pos")).alias("block"), F.col("r").alias("start"), (F.col("last") & (F.col("pos") == F.col("n") - 1)).alias("last"))
        at_start = below.join(starts, [key, "block"])


def _then(a: Column, s: Column) -> Column:
    """The step that does ``a`` and then ``s``."""
    lo, hi = _clamp(a["lo"] + s["shift"], s["lo"], s["hi"]), _clamp(a["hi"] + s["shift"], s["lo"], s["hi"])
    return F.struct((a["shift"] + s["shift"]).alias("shift"), lo.alias("lo"), hi.alias("hi"))


def assign_r(slots: DataFrame, trajectory: DataFrame, key: str, r0: int, max_r: int, interval: int = 10) -> DataFrame:
    """Add ``r_used``: the cycle's r for usual jobs, arm A or B for its trials."""
    joined = slots.join(trajectory, [key, "cycle"], "left").withColumn("r", F.coalesce("r", F.when(F.col("cycle") == 0, F.lit(r0))))
    a, b = arms(F.col("r"), max_r)
    used = F.when(F.col("slot") < interval, F.col("r")).when((F.col("slot") - interval) % 2 == 0, a).otherwise(b)
    return joined.withColumn("r_used", used).drop("r")

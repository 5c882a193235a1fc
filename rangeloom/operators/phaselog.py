"""Analytics over phase-time logs: pairs of map and shuffle times, ratios, totals, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.operators.records import place_in_group

#: Map times count in units of 0.5 * 1e7 (fixed value).
MAP_SCALE = 5e6


def pair_phases(log: DataFrame, scale: float = MAP_SCALE, order_cols: Sequence[str] = ("line_no",)) -> DataFrame:
    """``source, k, map, shuffle``: the k-th MAP with the k-th SHUFFLE of a source, map times scaled.

    ``log`` has ``source, phase, value`` and ``order_cols``; lines of either kind beyond the other's number are
    dropped, other phases ignored. Lines are numbered in sorted ranges, so that a source of many lines is spread over
    tasks; one exchange by (source, k) pairs them. Runs a job that writes the lines.
    """
    lines = log.where(F.col("phase").isin("MAP", "SHUFFLE"))
    numbered = place_in_group(lines.select(*dict.fromkeys(["source", "phase", "value", *order_cols])), ["source", "phase"], order_cols, "k")
    pick = lambda p: F.max(F.when(F.col("phase") == p, F.col("value")))
    pairs = numbered.groupBy("source", "k").agg((pick("MAP") * scale).alias("map"), pick("SHUFFLE").alias("shuffle"), F.count(F.lit(1)).alias("c"))
    return pairs.where("c = 2").drop("c")


def phase_ratios(pairs: DataFrame) -> DataFrame:
    """Add ``map_over_shuffle`` and ``shuffle_over_map``; null where the divisor is 0."""
    return pairs.withColumns({"map_over_shuffle": F.try_divide("map", "shuffle"), "shuffle_over_map": F.try_divide("shuffle", "map")})


def total_time(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("source").agg(F.sum(F.col("map") + F.col("shuffle")).alias("total"))


def ratio_stats(pairs: DataFrame) -> DataFrame:
    """Mean and sample variance of ``map_over_shuffle``; the variance of a single pair is null."""
    ratios = phase_ratios(pairs).groupBy("source").agg(F.avg("map_over_shuffle").alias("mean_ratio"), F.count("map_over_shuffle").alias("n"), F.var_samp("map_over_shuffle").alias("var_ratio"))
    return ratios.select("source", "n", "mean_ratio", F.when(F.col("n") > 1, F.col("var_ratio")).alias("var_ratio"))


def compare_schemes(totals: DataFrame, target: str, baselines: Sequence[str]) -> DataFrame:
    """``distribution, baseline, change``: ``(target - baseline) / baseline`` for each distribution.

    ``totals`` has ``distribution, scheme, total``.
    """
    own = totals.where(F.col("scheme") == target).select("distribution", F.col("total").alias("own"))
    base = totals.where(F.col("scheme").isin(*baselines)).select("distribution", F.col("scheme").alias("baseline"), "total")
    return base.join(own, "distribution").select("distribution", "baseline", F.try_divide(F.col("own") - F.col("total"), F.col("total")).alias("change"))


def phase_summary(times: DataFrame) -> DataFrame:
    """Average and largest time of a phase over the workers of a job: ``job, phase, avg_seconds, max_seconds``."""
    return times.groupBy("job", "phase").agg(F.avg("seconds").alias("avg_seconds"), F.max("seconds").alias("max_seconds"))

"""Transfer costs under a bandwidth that changes every interval."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.operators.records import last_in_group


@dataclass(frozen=True)
class Bandwidth:
    """Parameters of a series of rates; ``low`` and ``high`` are for the alternating kind."""

    low: float = 100.0
    high: float = 1000.0
    base: float = 100.0
    rate: float = 0.01
    scale: float = 200.0
    shape: float = 2.0


KINDS = ("uniform", "exponential", "pareto")


def bandwidth_series(buckets: DataFrame, dist: str, params: Bandwidth = Bandwidth()) -> DataFrame:
    """``bucket, rate, broadcast``: one row per interval of ``buckets`` (``bucket, u``, 0 < u < 1).

    ``uniform`` alternates low and high from low on, ``broadcast`` is the same; ``exponential`` is ``base + e`` in
    bucket 0 and ``base + 10 e`` after it, ``e = -ln(1 - u) / rate``; ``pareto`` is ``scale / u ** (1 / shape)``;
    for these two ``broadcast`` is six times the rate.
    """
    if dist not in KINDS:
        raise ValueError(f"dist must be one of {KINDS}")
    if dist == "uniform":
        rate = F.when(F.col("bucket") % 2 == 0, F.lit(params.low)).otherwise(F.lit(params.high))
    elif dist == "exponential":
        e = -F.log(1 - F.col("u")) / params.rate
        rate = params.base + F.when(F.col("bucket") == 0, e).otherwise(10 * e)
    else:
        rate = params.scale / F.pow(F.col("u"), F.lit(1 / params.shape))
    return buckets.select("bucket", rate.alias("rate"), (rate * (1 if dist == "uniform" else 6)).alias("broadcast"))


def rate_at(transfers: DataFrame, series: DataFrame, interval: int) -> DataFrame:
    """Add the rates in force at ``t`` seconds; intervals are equal, so the as-of join is an equi-join on the bucket."""
    return transfers.withColumn("bucket", F.floor(F.col("t") / interval)).join(series, "bucket")


def rate_as_of(transfers: DataFrame, series: DataFrame, key: str) -> DataFrame:
    """Add the rate of the last ``valid_from <= t`` within ``key``, for uneven intervals; null before the first.

    Both tables are stacked by time and the last rate is carried on, in sorted ranges, so that a key of many rows is
    spread over tasks. Runs a job that writes the stacked rows.
    """
    t = transfers.withColumns({"__rate": F.lit(None).cast("double"), "__at": F.col("t").cast("double"), "__row": F.lit(1)})
    s = series.select(F.col(key), F.col("rate").alias("__rate"), F.col("valid_from").cast("double").alias("__at"), F.lit(0).alias("__row"))
    both = last_in_group(t.unionByName(s, allowMissingColumns=True), [key], ["__at", "__row"], "__rate", "rate")
    return both.where("__row = 1").drop("__rate", "__at", "__row")


def transfer_cost(transfers: DataFrame, rate: str = "rate") -> DataFrame:
    """Seconds per source and destination: ``src, dst, bytes, seconds``; senders take turns, so times add up."""
    return transfers.groupBy("src", "dst").agg(F.sum("bytes").alias("bytes"), F.sum(F.col("bytes") / F.col(rate)).alias("seconds"))

"""Inputs of the registered jobs, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Nodes, replication and sample size of the registered sorts.
NODES, REPLICATION, SAMPLES = 6, 3, 1000

WORDS = ("w0", "w1", "w2")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _md5_key(text) -> F.Column:
    return F.unhex(F.substring(F.md5(text.cast("binary")), 1, 20))


def rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with uniform keys: the first ten bytes of the md5 of the event's id."""
    e = table(spark, sf_dir, "events")
    return e.select(_md5_key(F.col("event_id").cast("string")).alias("key"), F.col("event_id").alias("id"), F.col("event_id").alias("w0"), F.col("user_id").alias("w1"), F.round(F.col("value") * 100).cast("long").alias("w2"))


def rec_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with few distinct keys: one for each type of event."""
    e = table(spark, sf_dir, "events")
    return e.select(_md5_key(F.col("event_type")).alias("key"), F.col("event_id").alias("id"))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rec`` with the file and destination of each record."""
    from rangeloom.operators.coded import place_records

    return place_records(rec(spark, sf_dir), "key", ["id"], NODES, REPLICATION, SAMPLES)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).cast("int").alias("master_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "CodedTeraSort").otherwise("TeraSort").alias("type"),
        F.lit(-1).alias("input_file_num"), F.lit(NODES).alias("reducer_num"), (F.col("o_orderkey") % 7).cast("int").alias("r"), F.col("o_orderpriority").alias("prefix"),
    )


def phase_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase"))
    phase = F.when(F.col("event_type") == "click", "MAP").otherwise("SHUFFLE")
    return e.select(F.col("user_id").alias("source"), "ts", F.col("event_id").alias("line_no"), phase.alias("phase"), "value")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeloom.operators.tuning import cost

    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), cost(F.col("value") / 1e7, F.col("event_id") % 100).alias("cost"))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    t = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp_ltz"))
    rows = e.select((F.col("user_id") % 6).alias("src"), (F.col("event_id") % 6).alias("dst"), (100 * (1 + F.col("event_id") % 50)).alias("bytes"), t.alias("t"))
    return rows.where("src <> dst")


def band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interval a day that has transfers, with the number that its rate is drawn from."""
    days = transfers(spark, sf_dir).select(F.floor(F.col("t") / 86400).alias("bucket")).distinct()
    return days.withColumn("u", (F.col("bucket") + 0.5) / 31)

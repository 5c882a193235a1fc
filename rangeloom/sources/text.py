"""Job lists and phase logs from text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_jobs(spark: SparkSession, path: str, rejects: bool = False) -> DataFrame:
    """``type, input_file_num, reducer_num, r, prefix`` from lines with blanks between.

    Lines without five fields or with other than numbers in the middle three are left out; with ``rejects`` they come as
    rows of nulls, the line in ``rejected``. Empty lines are no jobs.
    """
    number = lambda i: F.get("p", F.lit(i)).try_cast("int")
    ok = (F.size("p") == 5) & number(1).isNotNull() & number(2).isNotNull() & number(3).isNotNull()
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"), "value").where(F.trim("value") != "").withColumn("ok", ok)
    fields = {"type": F.get("p", F.lit(0)), "input_file_num": number(1), "reducer_num": number(2), "r": number(3), "prefix": F.get("p", F.lit(4))}
    columns = [F.when(F.col("ok"), c).alias(n) for n, c in fields.items()]
    return lines.select(*columns, F.when(~F.col("ok"), F.col("value")).alias("rejected")) if rejects else lines.where("ok").select(*columns)


def read_phase_log(spark: SparkSession, path: str, source: Column | None = None, line: Column | None = None) -> DataFrame:
    """``source, line_no, phase, value``: MAP and SHUFFLE lines of each log in their order (CR is trimmed).

    Lines are numbered within the byte range they were read in, then moved up by the lines of the log's ranges
    before, so no window holds a whole file. ``source`` names a log, by default its file's name; an expression over
    ``_metadata`` must tell files apart too. Many small logs can share files: ``source`` and ``line`` then take
    a log's name and its line out of ``value``, the line of the file; a log lies in one file, whatever stands between its lines.
    """
    text = F.trim(F.regexp_replace(F.col("value") if line is None else line, "\r", ""))
    raw = spark.read.text(path).select((F.col("_metadata.file_name") if source is None else source).alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), text.alias("line"))
    parts = F.split("line", r"\s+")
    lines = raw.select("source", "block", "id", F.get(parts, F.lit(0)).alias("phase"), F.get(parts, F.lit(1)).try_cast("double").alias("value"))
    place = F.row_number().over(Window.partitionBy("source", "block").orderBy("id")) - 1
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = raw.groupBy("source", "block").count()
    starts = counts.select(F.col("source").alias("of"), F.col("block").alias("at"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    numbered = lines.withColumn("place", place).where(F.col("phase").isin("MAP", "SHUFFLE") & F.col("value").isNotNull())
    # A log may be called null.
    joined = numbered.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    return joined.select("source", (F.col("start") + F.col("place")).alias("line_no"), "phase", "value")

"""Job descriptors: text form, parsing and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Known kinds of job (fixed values).
TYPES = ("TeraSort", "CodedTeraSort")

FIELDS = ("master_id", "type", "input_file_num", "reducer_num", "r", "prefix")


def format_job(df: DataFrame, name: str = "job") -> DataFrame:
    """Add the text ``master_id:type:input_file_num:reducer_num:r:prefix``."""
    return df.withColumn(name, F.concat_ws(":", *(F.col(c).cast("string") for c in FIELDS)))


def parse_job(df: DataFrame, col: str) -> DataFrame:
    """Add the fields of a job text and ``job_ok``: six fields, whole numbers where they are due; else nulls."""
    parts = F.split(col, ":")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    raw = {"master_id": number(0), "type": F.get(parts, F.lit(1)), "input_file_num": number(2), "reducer_num": number(3), "r": number(4), "prefix": F.get(parts, F.lit(5))}
    ok = F.coalesce((F.size(parts) == 6) & number(0).isNotNull() & number(2).isNotNull() & number(3).isNotNull() & number(4).isNotNull(), F.lit(False))
    return df.withColumn("job_ok", ok).withColumns({k: F.when(ok, v) for k, v in raw.items()})


def validate_jobs(df: DataFrame, workers: int) -> DataFrame:
    """Add ``error``: null, or why the job is refused (unknown type; r outside 1..workers-1 or missing)."""
    kind = F.coalesce(F.col("type").isin(*TYPES), F.lit(False))
    r = F.coalesce(F.col("r").between(1, workers - 1), F.lit(False))
    return df.withColumn("error", F.when(~kind, "unknown type").when(~r, "r out of range"))

"""Tables that cut lineage, written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``; where that is unset, a local run gets a folder of its own.

    On a cluster an unset ``spark.checkpoint.dir`` is an error, as no other folder is known to be shared.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-shared-"))


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables of the shared folder, whatever file system it is on."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def exists(spark: SparkSession, path: str, files: bool = False) -> bool:
    """Whether there is something at ``path``, whatever file system it is on; ``files``: whether any file lies below it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(at) and (not files or fs.listFiles(at, True).hasNext())


@contextmanager
def scratch(spark: SparkSession, keep: list[str] | None = None) -> Iterator[None]:
    """Tables that are written in the block are removed when it ends well, but for the paths in ``keep``.

    Frames that read them must have been run or written by then. After an error they stay.
    """
    before = len(_made)
    yield
    remove(spark, [p for p in _made[before:] if p not in (keep or ())])
    _made[before:] = [p for p in _made[before:] if p in (keep or ())]


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a lost executor loses none of it."""
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Fixed-width records as a Python data source: reading by byte ranges, writing ordered part files that a manifest names."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from rangeloom.sources.storage import Manifests, Storage

_CHUNK = 1 << 22
#: Addresses that :class:`Storage` opens; files elsewhere are read through Hadoop's file systems.
_OPENED = ("", "file", "s3", "gs", "gcs", "abfs", "abfss", "hdfs")


class _Range(InputPartition):
    """Bytes ``start`` to ``stop`` of a file; ``place`` is the number of records before them in all files."""

    def __init__(self, file: str, start: int, stop: int, place: int) -> None:
        self.file, self.start, self.stop, self.place = file, start, stop, place


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.storage = Storage(options["path"])
        self.key, self.value = int(options.get("keysize", 10)), int(options.get("valuesize", 90))
        self.split = int(options.get("splitbytes", 64 << 20))
        self.places = _places(options)

    def files(self) -> list[tuple[str, int]]:
        """``(name, bytes)`` in the order of their records: those of the manifests, or all where there are none."""
        manifests = Manifests(self.storage)
        if manifests.any():
            return [(f["name"], f["bytes"]) for m in manifests.commits() for f in m["files"]]
        return [(n, b) for n, b in self.storage.list() if not os.path.basename(n).startswith(("_", "."))]

    def partitions(self) -> list[InputPartition]:
        width = self.key + self.value
        step = max(1, self.split // width) * width
        ranges, before = [], 0
        for name, size in self.files():
            whole = size // width * width
            ranges += [_Range(name, at, min(at + step, whole), before + at // width) for at in range(0, whole, step)]
            before += whole // width
        return ranges or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        width = self.key + self.value
        if partition.start >= partition.stop:
            return
        with self.storage.open(partition.file) as f:
            f.seek(partition.start)
            left, place = partition.stop - partition.start, partition.place
            while left:
                data = f.read(min(left, _CHUNK // width * width or width))
                if not data or len(data) % width:
                    raise OSError(f"{partition.file} ends before the bytes that were listed")
                left -= len(data)
                rows = np.frombuffer(data, np.uint8).reshape(-1, width)
                columns = {"key": _fixed(rows[:, : self.key]), "value": _fixed(rows[:, self.key :])}
                if self.places:
                    columns["place"] = pa.array(np.arange(place, place + len(rows)))
                place += len(rows)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _fixed(rows: np.ndarray) -> pa.Array:
    n, w = rows.shape
    offsets = np.arange(0, (n + 1) * w, w, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _places(options: dict) -> bool:
    return str(options.get("places", "false")).lower() == "true"


def _joined(batch: pa.RecordBatch) -> bytes:
    """Keys and values of a batch in turn; where all are of one length, as two blocks of bytes side by side."""
    sides = []
    for name in ("key", "value"):
        column = batch.column(name).cast(pa.binary())
        ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
        sizes = np.diff(ends)
        if column.null_count or not len(sizes) or not sizes[0] or (sizes != sizes[0]).any():
            return b"".join((k or b"") + (v or b"") for k, v in zip(batch.column("key").to_pylist(), batch.column("value").to_pylist(), strict=True))
        sides.append(np.frombuffer(column.buffers()[2], np.uint8, int(ends[-1] - ends[0]), int(ends[0])).reshape(len(column), -1))
    return np.concatenate(sides, axis=1).tobytes()


class _Commit(WriterCommitMessage):
    def __init__(self, part: int, name: str, size: int) -> None:
        self.part, self.name, self.size = part, name, size


class _Writer(DataSourceArrowWriter):
    """A task writes a file under a name of its own; the commit names one file for each partition in a manifest.

    So a task that ran twice counts once, a write that was killed is never seen, and no file is renamed. Names sort by
    write and partition, as records do. Files that ``overwrite`` replaces stay until they are cleared.
    """

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.storage, self.overwrite = Storage(options["path"]), overwrite
        self.id = options.get("writeid") or uuid.uuid4().hex
        self.number = Manifests(self.storage).next()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        part, size = TaskContext.get().partitionId(), 0
        name = f"part-{self.number:06d}-{part:06d}-{uuid.uuid4().hex}"
        with self.storage.create(name) as f:
            for batch in iterator:
                f.write(data := _joined(batch))
                size += len(data)
        return _Commit(part, name, size)

    def commit(self, messages: list) -> None:
        done = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        if not Manifests(self.storage).commit(self.id, [{"name": m.name, "bytes": m.size} for m in done], self.overwrite):
            self.abort(messages)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                self.storage.remove(m.name)


class FixedWidthSource(DataSource):
    """``path``, ``keysize``, ``valuesize``, ``splitbytes``, ``places``, ``writeid``; bytes short of a whole record at a file's end are dropped."""

    @classmethod
    def name(cls) -> str:
        return "fixed_width"

    def schema(self) -> str:
        return "key binary, value binary, place long" if _places(self.options) else "key binary, value binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def read_records(spark: SparkSession, path: str, key_size: int = 10, value_size: int = 90, split_bytes: int = 64 << 20, places: bool = False) -> DataFrame:
    """``key, value`` of back-to-back records; an input partition for each record-aligned range of bytes.

    With ``places`` also ``place``, the number of records before it in the files in their order. Where the folder has
    manifests, as :func:`write_records` leaves them, the files that they name are read, in their order; else all files, by name.
    Paths of file systems that only Spark knows are read by :func:`read_records_by_hadoop`, without ``places``.
    """
    if urlparse(path).scheme not in _OPENED:
        if places:
            raise ValueError(f"places of records are counted where files can be listed with their sizes, not at {path}")
        return read_records_by_hadoop(spark, path, key_size, value_size)
    spark.dataSource.register(FixedWidthSource)
    return spark.read.format("fixed_width").option("keysize", key_size).option("valuesize", value_size).option("splitbytes", split_bytes).option("places", str(places)).load(path)


def read_records_by_hadoop(spark: SparkSession, path: str, key_size: int = 10, value_size: int = 90) -> DataFrame:
    """``key, value`` of all files at ``path`` on any file system that Spark reads, in the JVM alone.

    Spark lists the files. Those of whole records are read by Hadoop's fixed-length format, which cuts them at records;
    one with a short tail, which that format refuses, is read at once (Spark's limit for that is 2 GiB a file) and cut
    there. Manifests are not followed: their folder is a hidden one.
    """
    width = key_size + value_size
    listed = spark.read.format("binaryFile").load(path)
    whole = listed.where((F.col("length") % width == 0) & (F.col("length") > 0)).select("path")
    tailed = listed.where(F.col("length") % width != 0)
    if tailed.isEmpty():
        names = [] if whole.isEmpty() else [path]
    else:
        names = [r.path for r in whole.toLocalIterator()]
        tailed = tailed.where(F.col("length") >= width)
    record = F.explode(F.transform(F.sequence(F.lit(0), (F.length("content") / width).cast("int") - 1), lambda i: F.substring("content", i * width + 1, F.lit(width))))
    rows = tailed.select(record.alias("value"))
    if names:
        jvm, session = spark._jvm, spark._jsparkSession
        records = spark.sparkContext._jsc.sc().binaryRecords(",".join(p.replace(",", "\\,") for p in names), width, spark.sparkContext._jsc.hadoopConfiguration())
        rows = DataFrame(session.createDataset(records, jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark).unionByName(rows)
    return rows.select(F.substring("value", 1, key_size).alias("key"), F.substring("value", key_size + 1, value_size).alias("value"))


def write_records(df: DataFrame, path: str, mode: str = "append", write_id: str | None = None) -> None:
    """Write ``key, value`` as a file per partition, numbered in their order: sorted partitions concatenate sorted.

    ``append`` adds files behind those that are there, ``overwrite`` replaces them. Readers see all files of a write or
    none. A write that is repeated under the same ``write_id`` adds nothing twice.
    """
    df.sparkSession.dataSource.register(FixedWidthSource)
    writer = df.select("key", "value").write.format("fixed_width").mode(mode)
    (writer.option("writeid", write_id) if write_id else writer).save(path)


def clear_replaced(path: str) -> int:
    """Remove part files that no manifest counts: replaced ones and those of writes that failed. No write may be running."""
    storage = Storage(path)
    counted = {f["name"] for m in Manifests(storage).commits() for f in m["files"]}
    gone = [n for n, _ in storage.list() if n.startswith("part-") and n not in counted]
    for name in gone:
        storage.remove(name)
    return len(gone)

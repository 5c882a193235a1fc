"""A queue of jobs as a streaming source: ordered segments in a shared folder, taken in order and in bounded parts."""

from __future__ import annotations

import bisect
import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from rangeloom.operators.records import sorted_ranges
from rangeloom.sources.storage import Manifests, Storage


def enqueue(jobs: DataFrame, path: str, order_cols: Sequence[str], ranges: int | None = None, write_id: str | None = None, file_jobs: int = 250_000) -> bool:
    """Put ``jobs`` behind all jobs in the queue, in the order of ``order_cols``; False if ``write_id`` was put there before.

    Jobs are sorted in ranges, files of at most ``file_jobs`` each, so a part of a segment is read without what is long before it; they appear all at once when a manifest names the files with their rows. Nothing
    depends on the files' times. All segments of a queue have the same columns.
    """
    spark, name = jobs.sparkSession, f"segment-{uuid.uuid4().hex}"
    sorted_ranges(jobs, order_cols, ranges).write.option("maxRecordsPerFile", file_jobs).parquet(f"{path}/{name}")
    # A file holds a part of one range, names follow the order. Its rows are counted by Spark, so nobody opens it for that.
    files = spark.read.schema(jobs.schema).parquet(f"{path}/{name}").groupBy("_metadata.file_name").count().collect()
    ddl = jobs.schema.simpleString().removeprefix("struct<").removesuffix(">")
    listed = [{"name": f"{name}/{f}", "rows": n} for f, n in sorted(map(tuple, files), key=lambda r: _place(r[0]))]
    return Manifests(Storage(path)).commit(write_id or name, listed, about={"schema": ddl})


def _place(file: str) -> tuple[int, int]:
    """Range and part of a file that Spark wrote: ``part-00003-<id>-c001...`` is the second part of the fourth range."""
    return int(file.split("-")[1]), int(re.search(r"[-.]c(\d+)\.", file)[1])


class _Rows(InputPartition):
    """Rows ``first`` to ``stop`` of a file."""

    def __init__(self, file: str, first: int, stop: int) -> None:
        self.file, self.first, self.stop = file, first, stop


class _QueueReader(DataSourceStreamReader):
    """Offsets count jobs from the head of the queue. A micro-batch takes at most ``maxjobs`` of them.

    Spark asks for the latest offset without saying how far it has come, so the reader keeps the end of the last batch that was
    planned; after a restart Spark plans the last batch of its log again, which sets it. A batch is a range of
    offsets, and files never change, so a batch that runs again reads the same jobs.
    """

    def __init__(self, options: dict) -> None:
        self.storage = Storage(options["path"])
        self.manifests = Manifests(self.storage)
        self.most = int(options.get("maxjobs", 1_000_000))
        self.split = int(options.get("splitjobs", 250_000))
        self.at = 0

    def _files(self) -> tuple[list[str], list[int]]:
        """Names, and the jobs before each file and behind the last one."""
        names, ends = [], [0]
        for m in self.manifests.commits():
            for f in m["files"]:
                names.append(f["name"])
                ends.append(ends[-1] + f["rows"])
        return names, ends

    def initialOffset(self) -> dict:
        return {"jobs": 0}

    def latestOffset(self) -> dict:
        return {"jobs": max(self.at, min(self._files()[1][-1], self.at + self.most))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, stop = start["jobs"], end["jobs"]
        self.at = max(self.at, stop)
        names, ends = self._files()
        out, at = [], first
        while at < stop:
            k = bisect.bisect_right(ends, at) - 1
            upto = min(stop, ends[k + 1], at + self.split)
            out.append(_Rows(names[k], at - ends[k], upto - ends[k]))
            at = upto
        return out

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        with self.storage.open(partition.file) as f:
            data, at = pq.ParquetFile(f), 0
            for g in range(data.num_row_groups):
                n = data.metadata.row_group(g).num_rows
                if at < partition.stop and at + n > partition.first:
                    here = at
                    for batch in data.iter_batches(row_groups=[g]):
                        lo, hi = max(0, partition.first - here), min(batch.num_rows, partition.stop - here)
                        if lo < hi:
                            yield batch.slice(lo, hi - lo)
                        here += batch.num_rows
                at += n


class JobQueue(DataSource):
    """``path``, ``maxjobs`` (a micro-batch takes that many at most), ``splitjobs`` (a task reads that many at most)."""

    @classmethod
    def name(cls) -> str:
        return "job_queue"

    def schema(self) -> str:
        commits = Manifests(Storage(self.options["path"])).commits()
        if not commits:
            raise ValueError(f"nothing was ever put in a queue at {self.options['path']}")
        return commits[0]["about"]["schema"].replace(":", " ")

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _QueueReader(self.options)


def read_queue(spark: SparkSession, path: str, most: int = 1_000_000, split: int = 250_000) -> DataFrame:
    """The queue at ``path`` as a stream: at most ``most`` jobs a micro-batch, in order; jobs put there later follow."""
    spark.dataSource.register(JobQueue)
    return spark.readStream.format("job_queue").option("maxjobs", most).option("splitjobs", split).load(path)

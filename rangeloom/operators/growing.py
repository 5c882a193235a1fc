"""Row indexes and paired phase logs that are kept and added to, batch by batch, instead of being made anew."""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.operators.phaselog import MAP_SCALE
from rangeloom.operators.quantiles import balanced_cuts, sort_key
from rangeloom.operators.ranges import range_assign
from rangeloom.operators.records import place_in_group
from rangeloom.shared import stored
from rangeloom.sources.storage import Manifests, Storage


class RankDirectory:
    """A dense row index over rows that keep coming: sorted ranges of ``order_cols``, each a folder with its rows' places.

    A batch is dealt to the ranges by their cuts; only ranges that get rows are read, merged and written again, and one
    that has grown beyond ``2 * range_rows`` is cut anew. A manifest says which folders count and how many rows each
    has, so the index of a row is its place and the rows of the ranges before, and readers see a batch as a whole or not
    at all. A batch that is added again under the same id changes nothing. Folders that no manifest names any more stay until they are cleared.
    """

    def __init__(self, spark: SparkSession, path: str, order_cols: Sequence[str], range_rows: int = 1_000_000) -> None:
        self.spark, self.path, self.order, self.range_rows = spark, path, list(order_cols), range_rows
        self.manifests = Manifests(Storage(path))

    def ranges(self) -> list[dict]:
        """``folder, rows, from`` of each range in order; ``from`` is the least sort key that it takes, in hexadecimal."""
        commits = self.manifests.commits()
        return commits[-1]["about"]["ranges"] if commits else []

    def add(self, rows: DataFrame, batch: str | None = None) -> bool:
        """Merge ``rows``, which have the columns of those before; False if the batch was added before. Runs jobs."""
        batch = batch or uuid.uuid4().hex
        if any(m["write"] == batch for m in self.manifests.commits()):
            return False
        keyed = stored(rows.withColumn("__key", sort_key(rows, self.order)), "rank-batch")
        ranges = self.ranges() or [{"folder": None, "rows": 0, "from": ""}]
        cuts = [bytes.fromhex(r["from"]) for r in ranges[1:]]
        new = range_assign(keyed, "__key", cuts)
        gained = dict(map(tuple, new.groupBy("pid").count().collect()))
        if not gained:
            return self.manifests.commit(batch, [], about={"ranges": ranges, "schema": rows.schema.jsonValue()})
        # The cuts of the ranges that are written: those that stay, and more in ranges that have grown too large.
        pieces = {i: [bytes.fromhex(ranges[i]["from"])] for i in sorted(gained)}
        large = [i for i in pieces if ranges[i]["rows"] + gained[i] > 2 * self.range_rows]
        if large:
            own = self._old(rows, [ranges[i] for i in large]).unionByName(new.where(F.col("pid").isin(large)).drop("pid"))
            size = sum(ranges[i]["rows"] + gained[i] for i in large)
            for cut in balanced_cuts(own, "__key", -(-size // self.range_rows))[0]:
                i = bisect.bisect_right(cuts, cut)
                if i in pieces and cut > pieces[i][-1]:
                    pieces[i].append(cut)
        touched = [ranges[i] for i in pieces]
        starts = [c for p in pieces.values() for c in p]
        merged = self._old(rows, touched).unionByName(new.drop("pid"))
        dealt = range_assign(merged, "__key", starts[1:]).withColumnRenamed("pid", "__range").repartitionById(len(starts), F.col("__range"))
        placed = dealt.sortWithinPartitions("__key").withColumn("__in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        version = f"ranges-{uuid.uuid4().hex}"
        placed.write.partitionBy("__range").parquet(f"{self.path}/{version}")
        sizes = dict(map(tuple, self.spark.read.parquet(f"{self.path}/{version}").groupBy("__range").count().collect()))
        written = iter([{"folder": f"{version}/__range={k}", "rows": sizes.get(k, 0), "from": c.hex()} for k, c in enumerate(starts)])
        after = []
        for i, r in enumerate(ranges):
            after += [next(written) for _ in pieces[i]] if i in pieces else [r]
        return self.manifests.commit(batch, [], about={"ranges": after, "schema": rows.schema.jsonValue()})

    def _old(self, rows: DataFrame, ranges: list[dict]) -> DataFrame:
        folders = [f"{self.path}/{r['folder']}" for r in ranges if r["rows"]]
        schema = rows.withColumn("__key", F.lit(b"")).schema
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def index(self, name: str = "idx") -> DataFrame:
        """All rows with their place in the whole; rows that are equal in ``order_cols`` stand together in any order."""
        from pyspark.sql.types import StructType

        commits = self.manifests.commits()
        if not commits:
            raise ValueError(f"nothing was ever added at {self.path}")
        schema = StructType.fromJson(commits[-1]["about"]["schema"])
        starts, total = [], 0
        for r in self.ranges():
            if r["rows"]:
                starts.append((r["folder"], total))
                total += r["rows"]
        if not starts:
            return self.spark.createDataFrame([], StructType([*schema.fields])).withColumn(name, F.lit(0).cast("long"))
        stored_schema = StructType([*schema.fields]).add("__in", "long")
        rows = self.spark.read.schema(stored_schema).parquet(*(f"{self.path}/{f}" for f, _ in starts))
        folder = F.regexp_extract("_metadata.file_path", r"(ranges-[0-9a-f]+/__range=\d+)/[^/]*$", 1)
        # A row for each range.
        at = self.spark.createDataFrame(starts, "__folder string, __start long")
        return rows.withColumn("__folder", folder).join(F.broadcast(at), "__folder").select(*schema.names, (F.col("__start") + F.col("__in")).alias(name))


class GrowingPairs:
    """:func:`rangeloom.operators.phaselog.pair_phases` over a log that comes in batches, each behind those before it.

    Between batches only two counters a source and the lines without a partner are kept, not the log. A batch's lines are
    numbered among themselves and moved up by the counters, meet the lines that wait by (source, k), and what has both
    phases leaves. A manifest makes pairs, waiting lines and counters of a batch count together; a batch that is added
    again under the same id gives the pairs that it gave.
    """

    _PAIRS, _LINES, _COUNTS = "k long, map double, shuffle double", "phase string, k long, value double", "phase string, n long"

    def __init__(self, spark: SparkSession, path: str, source: str = "long", scale: float = MAP_SCALE) -> None:
        self.spark, self.path, self.scale, self.source = spark, path, scale, source
        self.manifests = Manifests(Storage(path))

    def _read(self, kind: str, folders: list[str]) -> DataFrame:
        schema = f"source {self.source}, {kind}"
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def pairs(self) -> DataFrame:
        """All pairs so far."""
        return self._read(self._PAIRS, [f["name"] for m in self.manifests.commits() for f in m["files"]])

    def add(self, log: DataFrame, batch: str, order_cols: Sequence[str] = ("line_no",)) -> DataFrame:
        """``source, k, map, shuffle`` of the pairs that the batch's lines (``source, phase, value`` and ``order_cols``) complete. Runs jobs."""
        commits = self.manifests.commits()
        if done := [m for m in commits if m["write"] == batch]:
            return self._read(self._PAIRS, [f["name"] for f in done[0]["files"]])
        about = commits[-1]["about"] if commits else {}
        waiting, counts = self._read(self._LINES, about.get("waiting", [])), self._read(self._COUNTS, about.get("counts", []))
        lines = log.where(F.col("phase").isin("MAP", "SHUFFLE")).select(*dict.fromkeys(["source", "phase", "value", *order_cols]))
        numbered = place_in_group(lines, ["source", "phase"], order_cols, "__k")
        same = numbered["source"].eqNullSafe(counts["source"]) & (numbered["phase"] == counts["phase"])
        moved = numbered.join(counts, same, "left").select(numbered["source"], numbered["phase"], (F.coalesce("n", F.lit(0)) + F.col("__k")).alias("k"), F.col("value").cast("double").alias("value"))
        moved, version = stored(moved, "numbered-lines"), uuid.uuid4().hex
        open_ = moved.unionByName(waiting)
        pick = lambda p: F.max(F.when(F.col("phase") == p, F.col("value")))
        met = open_.groupBy("source", "k").agg(pick("MAP").alias("map"), pick("SHUFFLE").alias("shuffle"), F.count(F.lit(1)).alias("c"), F.first("phase").alias("phase"), F.first("value").alias("value"))
        met = stored(met, "met-lines")
        met.where("c = 2").select("source", "k", (F.col("map") * self.scale).alias("map"), "shuffle").write.parquet(f"{self.path}/pairs-{version}")
        met.where("c = 1").select("source", "phase", "k", "value").write.parquet(f"{self.path}/waiting-{version}")
        total = moved.groupBy("source", "phase").agg(F.count(F.lit(1)).alias("n")).unionByName(counts).groupBy("source", "phase").agg(F.sum("n").alias("n"))
        total.write.parquet(f"{self.path}/counts-{version}")
        self.manifests.commit(batch, [{"name": f"pairs-{version}"}], about={"waiting": [f"waiting-{version}"], "counts": [f"counts-{version}"]})
        return self._read(self._PAIRS, [f"pairs-{version}"])

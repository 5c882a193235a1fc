"""Exact deduplication against a persistent digest index; DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm._text import documents
from rangeloom.shared import exists, new_path, stored


def without_white(text: Column) -> Column:
    """The text less every character of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, digest, n_points)`` of every row: SHA-256 of the normalised text, code points of the original."""
    text = docs[text_col].cast("string")
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.unhex(F.sha2(without_white(text), 256)).alias("digest"),
        F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_points"),
    )


class DigestIndex:
    """A Parquet table of digests, bucketed and sorted by digest, that outlives the session.

    ``path`` may hold an index of an earlier session. The number of buckets and the format's version stand beside the
    files and are read from there: another number would look for a digest in the wrong bucket, so it is refused, as are files
    without them; ``compact`` rewrites an index with another number. A batch is
    first reduced to a row per digest, so no shuffle meets a hot digest, then joined to the index bucket by
    bucket: the index itself is never shuffled. ``add`` appends only digests that an anti-join did not find;
    repeating it after a failure adds nothing twice.
    """

    VERSION = 1

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path
        self.buckets = self._settled(buckets)
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, n_points BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def _settled(self, buckets: int | None) -> int:
        """The number of buckets at ``path``; a new index gets ``buckets``, or 64, before any row is added."""
        about = f"{self.path}/_about"  # Spark's readers pass names with an underscore over
        if not exists(self.spark, about):
            if exists(self.spark, self.path, files=True):
                raise ValueError(f"{self.path} has files but does not say how many buckets they are in")
            self.spark.sql(f"SELECT {self.VERSION} AS version, {buckets or 64} AS buckets").write.parquet(about)
            return buckets or 64
        version, there = self.spark.read.parquet(about).select("version", "buckets").first()
        if version != self.VERSION:
            raise ValueError(f"{self.path} is of version {version}, not {self.VERSION}")
        if buckets not in (None, there):
            raise ValueError(f"{self.path} has {there} buckets, not {buckets}; open it without a number and compact it into {buckets}")
        return there

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def missing(self, groups: DataFrame) -> DataFrame:
        """Rows of ``groups`` (a row per digest) whose digest the index lacks: a sort-merge anti-join."""
        return groups.join(self.table().hint("merge"), "digest", "left_anti")

    def add(self, groups: DataFrame) -> None:
        self.missing(groups).select("digest", "keep_id", "n_points").write.insertInto(self.name)

    def compact(self, path: str, buckets: int | None = None) -> DigestIndex:
        """The index rewritten below ``path`` with one sorted file a bucket, as each ``add`` leaves a file in each.

        ``buckets``: their number there, as before if not given. The files are read as plain ones: of a bucketed table Spark takes the
        exchange for done, and reads it unbucketed.
        """
        new = DigestIndex(self.spark, path, buckets or self.buckets)
        files = self.spark.read.schema(self.table().schema).parquet(self.path)
        files.repartition(new.buckets, "digest").write.insertInto(new.name)
        return new

    def lookup(self, groups: DataFrame) -> DataFrame:
        """``groups`` with the ``keep_id`` that the index holds for each digest."""
        return groups.drop("keep_id", "n_points").join(self.table().hint("merge"), "digest")


def groups_of(rows: DataFrame) -> DataFrame:
    """A row per digest: the doc_id that stays (most code points, then smallest doc_id; null only where all are) and the number of rows.

    Partial aggregation before the shuffle leaves a row per digest and task at most.
    """
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), (-F.col("n_points")).alias("fewer"), "doc_id"))
    groups = rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    return groups.select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.fewer")).alias("n_points"), "group_size")


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicate a batch within itself and against ``index``, append what is new, and decide on every row.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``, a row per row of ``docs``; ``group_size`` counts
    the batch. Texts that the index held before give ``kept = false`` with the index's ``keep_id``. Null texts
    count as empty, empty texts are one group; rows that repeat a doc_id and text are all kept or all dropped
    (``keep_rows`` returns one of them); a null doc_id never stays beside others, however long its text, and is kept only alone. An
    empty table adds nothing. Only ``doc_id`` and the text are read.
    """
    rows = stored(digests(docs, id_col, text_col), "digests")
    groups = stored(groups_of(rows), "digest-groups")
    old = stored(index.lookup(groups).select("digest"), "digests-seen")
    index.add(groups)
    # The index's answer for the batch's digests is written, so that the last join shuffles both of its sides
    # and Spark can split the partition of a hot digest.
    known = stored(index.lookup(groups).join(old.withColumn("old", F.lit(True)), "digest", "left"), "digest-answers")
    joined = rows.select("doc_id", "digest").join(known.hint("merge"), "digest")
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("old").isNull() & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_rows(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row for each text.

    The texts cross one exchange, a semi-join by id and digest. Only where rows repeat an id and its text does a
    second one meet, of those rows alone.
    """
    kept = deduplicate(docs, index, id_col, text_col).where("kept").groupBy(F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__digest"))
    stay = stored(kept.agg(F.count(F.lit(1)).alias("__rows")), "digests-kept")
    marked = docs.withColumn("__digest", F.unhex(F.sha2(without_white(F.col(text_col).cast("string")), 256)))
    same = lambda s: marked[id_col].cast("long").eqNullSafe(s["__id"]) & (marked["__digest"] == s["__digest"])
    alone, again = stay.where("__rows = 1"), stay.where("__rows > 1")
    found = marked.join(alone, same(alone), "left_semi")
    if not again.isEmpty():
        found = found.unionByName(marked.join(again, same(again), "left_semi").dropDuplicates([id_col, "__digest"]))
    return found.drop("__digest")


def buckets_for(rows: int, bucket_rows: int = 2_000_000) -> int:
    """A power of two of buckets, 64 at least, with about ``bucket_rows`` digests each."""
    return max(64, 1 << max(0, -(-rows // bucket_rows) - 1).bit_length())


def new_index(spark: SparkSession, buckets: int = 64) -> DigestIndex:
    """An empty index in the shared folder."""
    return DigestIndex(spark, new_path(spark, "digest-index"), buckets)


def op3_digest_index(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return deduplicate(docs, new_index(spark, buckets_for(docs.count())))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS kept,
       text_sha256
FROM d
"""

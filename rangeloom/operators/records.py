"""Row index, systematic sample, splitters, range partitioning and total sort of keyed records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.functions.keys import key_hex
from rangeloom.operators.quantiles import balanced_cuts, sort_key
from rangeloom.operators.ranges import range_assign
from rangeloom.shared import stored

def sorted_ranges(df: DataFrame, order_cols: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``df`` in ``ranges`` partitions that are sorted one after the other, at least 16 or Spark's shuffle partitions by default."""
    ranges = ranges or max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionByRange(ranges, *order_cols).sortWithinPartitions(*order_cols)


def _ranged(df: DataFrame, order_cols: Sequence[str], buckets: int | None) -> DataFrame:
    """``df`` in sorted ranges of ``order_cols``, written, with ``__range`` and the place in it, ``__in``."""
    # The number of a row in its range: the low 33 bits of the id that Spark gives it there.
    numbered = sorted_ranges(df, order_cols, buckets).withColumns({"__range": F.spark_partition_id(), "__in": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    return stored(numbered, "row-index")


def starts_of(df: DataFrame, part: str) -> DataFrame:
    """``part, start``: the rows before each value of the whole number ``part``; its counts come to the driver, one number each."""
    return _starts(df, part)[0]


def _starts(df: DataFrame, part: str) -> tuple[DataFrame, int]:
    starts, total = [], 0
    for i, n in sorted(map(tuple, df.groupBy(part).count().collect())):
        starts.append((i, total))
        total += n
    return df.sparkSession.createDataFrame(starts, f"{part} int, start long"), total


def _indexed(df: DataFrame, order_cols: Sequence[str], name: str, buckets: int | None) -> tuple[DataFrame, int]:
    numbered = _ranged(df, order_cols, buckets)
    starts, total = _starts(numbered, "__range")
    # One row per range.
    out = numbered.join(F.broadcast(starts.withColumnRenamed("start", "__start")), "__range").withColumn(name, F.col("__start") + F.col("__in"))
    return out.select(*df.columns, name), total


def _pieces(numbered: DataFrame, groups: Sequence[str], aggs: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
    """``numbered`` joined with a row for each group in each range: ``aggs`` of its rows there, then ``carried`` over windows.

    A group stands in neighbouring ranges, so there are at most as many pieces as groups and ranges together, and a
    join key, (range, group), has the rows of one range at most however many rows its group has. Null is a group.
    """
    before = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    pieces = numbered.groupBy("__range", *groups).agg(*(a.alias(n) for n, a in aggs.items()))
    pieces = pieces.select(F.col("__range").alias("__piece"), *(F.col(g).alias(f"__of_{g}") for g in groups), *aggs, *(c.over(before).alias(n) for n, c in carried.items()))
    same = F.col("__range") == F.col("__piece")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"__of_{g}"))
    return numbered.join(pieces, same)


def place_in_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], name: str = "place") -> DataFrame:
    """Add the 0-based place of a row among its group's rows, in the order of ``order_cols``. Runs a job that writes the rows.

    What ``row_number`` gives over the group, without one task for each group: rows are sorted in ranges of (group,
    order), and a row's place is that in its range, less the group's first there, and the group's rows in the ranges before.
    Rows that are equal in group and order meet in one range. Null is a group; an empty table gives an empty one.
    """
    numbered = _ranged(df, [*group_cols, *order_cols], None)
    out = _pieces(numbered, group_cols, {"__first": F.min("__in"), "__n": F.count(F.lit(1))}, {"__before": F.sum("__n")})
    return out.withColumn(name, F.col("__in") - F.col("__first") + F.coalesce("__before", F.lit(0))).select(*df.columns, name)


def last_in_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the last ``value`` that is not null among a group's rows up to this one, null before the first. Runs a job that writes the rows.

    As in :func:`place_in_group` a group is spread over ranges: inside a range a window carries the value on, and what the
    ranges before end with comes from a row for each group and range.
    """
    numbered = _ranged(df, [*group_cols, *order_cols], None)
    at_end = F.max_by(value, F.when(F.col(value).isNotNull(), F.col("__in")))
    out = _pieces(numbered, group_cols, {"__end": at_end}, {"__carried": F.last("__end", ignorenulls=True)})
    here = Window.partitionBy("__range", *group_cols).orderBy("__in").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(here), "__carried")).select(*df.columns, name)


def with_row_index(df: DataFrame, order_cols: Sequence[str], name: str = "idx", buckets: int | None = None) -> DataFrame:
    """Add the 0-based position in the total order of ``order_cols``. Runs a job that writes the sorted rows.

    Rows cross one exchange to ranges of ``order_cols``, are sorted and numbered there, and moved up by the rows of the
    ranges before. The numbered rows are written once, so a task that runs again later cannot number them anew. Rows
    that are equal in all ``order_cols`` meet in one range.
    """
    return _indexed(df, order_cols, name, buckets)[0]


def with_scan_place(df: DataFrame, name: str = "place") -> DataFrame:
    """Add a row's 0-based place as the files of ``df`` are read, partition by partition. Runs a job that counts them.

    For frames that read files alone, so that each reading gives the same rows in the same partitions: nothing is sorted,
    moved or written. The order is that of the reading, not one of any column; :func:`with_row_index` gives such a one.
    """
    numbered = df.withColumns({"__range": F.spark_partition_id(), "__in": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    starts = starts_of(numbered, "__range").withColumnRenamed("start", "__start")
    return numbered.join(F.broadcast(starts), "__range").withColumn(name, F.col("__start") + F.col("__in")).select(*df.columns, name)


def split_input(df: DataFrame, n: int, order_cols: Sequence[str], place: str | None = None) -> DataFrame:
    """Add ``split_id``: n runs of ``floor(N / n)`` rows, the last with the remainder; fails if n < 2 or n > N.

    ``place``: a column that has every row's index already; then nothing is sorted or moved.
    """
    indexed, total = _indexed(df, order_cols, "idx", None) if place is None else (df.withColumn("idx", F.col(place)), df.count())
    if not 2 <= n <= total:
        raise ValueError(f"cannot split {total} rows in {n}")
    return indexed.withColumn("split_id", F.least(F.expr(f"idx div {total // n}"), F.lit(n - 1)).cast("int"))


def _sample(df: DataFrame, num_samples: int, order_cols: Sequence[str], place: str | None = None) -> tuple[DataFrame, int]:
    """:func:`systematic_sample`, not yet written, and the number of rows."""
    if place is None:
        indexed, total = _indexed(df, order_cols, "idx", None)
    else:
        indexed, total = df.withColumn("idx", F.col(place)), df.count()
    if not (s := min(num_samples, total)):
        return indexed, 0
    gap = total // s
    return indexed.where((F.col("idx") % gap == 0) & (F.expr(f"idx div {gap}") < s)), total


def systematic_sample(df: DataFrame, num_samples: int, order_cols: Sequence[str], place: str | None = None) -> DataFrame:
    """Rows 0, gap, 2 gap... (``gap = floor(N / S)``, ``S = min(num_samples, N)`` rows) and their ``idx``; an empty table gives none.

    Rows are selected by rank: they are sorted in ranges, the ranges' counts tell at which rank each begins, and the task
    that reads a part of a range picks what falls on a multiple of the gap there. The sample, of at most ``num_samples`` rows, is
    written. ``place``: a column that has every row's index already, as :func:`rangeloom.sources.fixed.read_records` gives
    it; then nothing is sorted or moved.
    """
    sample, total = _sample(df, num_samples, order_cols, place)
    return stored(sample, "sample") if total else sample


def choose_splitters(sample: DataFrame, key: str, p: int) -> DataFrame:
    """``(i, splitter)`` for i = 1..p-1: element ``i * floor(S / p)`` of the sorted sample; duplicates stay.

    A sample is small by construction, so one window sorts it. Fails if it has fewer than p rows.
    """
    return _picked(sample, key, p, sample.count())


def _picked(sample: DataFrame, key: str, p: int, s: int) -> DataFrame:
    if s < p:
        raise ValueError(f"{s} samples are too few for {p} partitions")
    step = s // p
    place = F.row_number().over(Window.orderBy(key)) - 1
    i = F.expr(f"__place div {step}")
    picked = sample.select(key).withColumn("__place", place).where((F.col("__place") % step == 0) & i.between(1, p - 1))
    return picked.select(i.cast("int").alias("i"), F.col(key).alias("splitter"))


def splitter_list(splitters: DataFrame) -> list[bytes]:
    """The p-1 splitters in order; one value for each partition of the sort."""
    return [bytes(r[0]) for r in splitters.orderBy("i").select("splitter").collect()]


def exchange_matrix(df: DataFrame, src: str, dst: str, sources: int, dests: int, record_bytes: int = 100) -> DataFrame:
    """``src, dst, lines, bytes`` for each of ``sources * dests`` pairs, 0 where no line goes."""
    cells = df.sparkSession.range(sources).select(F.col("id").cast("int").alias(src), F.explode(F.sequence(F.lit(0), F.lit(dests - 1))).alias(dst))
    counts = df.groupBy(src, dst).agg(F.count(F.lit(1)).alias("lines"))
    return cells.join(counts, [src, dst], "left").select(src, dst, F.coalesce("lines", F.lit(0)).alias("lines")).withColumn("bytes", F.col("lines") * record_bytes)


def range_partition(df: DataFrame, key: str, splitters: Sequence[bytes]) -> DataFrame:
    """Move every record to Spark partition ``pid``."""
    return range_assign(df, key, splitters).repartitionById(len(splitters) + 1, F.col("pid"))


def sort_partitions(df: DataFrame, key: str, tiebreak: Sequence[str]) -> DataFrame:
    return df.sortWithinPartitions(key, *tiebreak)


def partitions_for(rows: int, record_bytes: int = 100, least: int = 6, target: int = 128 << 20) -> int:
    """Partitions of about ``target`` bytes for so many records, ``least`` at least."""
    return max(least, -(-rows * record_bytes // target))


def total_sort(df: DataFrame, key: str, p: int | None, tiebreak: Sequence[str], num_samples: int = 10_000, method: str = "sampled", place: str | None = None) -> DataFrame:
    """Sort by key and tie-break; partitions, read in order, are the sorted whole. Runs jobs for the splitters.

    ``p``: the number of partitions; None: :func:`partitions_for` the input's rows, with a sample of 16 rows for each at least.

    ``sampled``: systematic sample in the order of the tie-break (or by ``place``, see :func:`systematic_sample`), splitters,
    one exchange of all rows to their range, sort inside; equal keys meet in one partition. ``df`` is read twice: its key and tie-break
    for the sample, and whole for the exchange. ``balanced``: cuts of (key, tie-break) by a quantile summary and exact
    counts, so a key that many records have is spread over partitions, each of about the mean's size; ``pid`` does not
    follow from the key alone then. ``builtin``: Spark's own range sort over (key, tie-break); there is no ``pid``. An empty input gives an empty output.
    """
    if method == "builtin":
        return df.orderBy(key, *tiebreak)
    if method == "balanced":
        keyed = df.withColumn("__key", sort_key(df, [key, *tiebreak]))
        cuts, _ = balanced_cuts(keyed, "__key", p or partitions_for(df.count()))
        return sort_partitions(range_partition(keyed, "__key", cuts), key, tiebreak).drop("__key")
    if method != "sampled":
        raise ValueError(f"no method {method}")
    if p is None:
        rows = df.count()
        p = min(partitions_for(rows), max(rows, 1))
        num_samples = max(num_samples, 16 * p)
    chosen = df.select(*dict.fromkeys([key, *tiebreak, *([place] if place else [])]))
    sample, total = _sample(chosen, num_samples, tiebreak, place)
    if not total:
        return df.withColumn("pid", F.lit(0))
    cuts = splitter_list(_picked(sample, key, p, min(num_samples, total)))
    return sort_partitions(range_partition(df, key, cuts), key, tiebreak)


def list_partitions(df: DataFrame, key: str, tiebreak: Sequence[str]) -> DataFrame:
    """Add ``pos``, the 0-based place in partition ``pid``, and ``key_hex``; uses the partitioning by ``pid``."""
    order = Window.partitionBy("pid").orderBy(key, *tiebreak)
    return df.withColumn("pos", F.row_number().over(order) - 1).withColumn("key_hex", key_hex(F.col(key)))

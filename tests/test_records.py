import bisect
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rangeloom.functions.keys import key_hex, n_choose_r, split_key
from rangeloom.operators import records as R

EDGE = [bytes(10), bytes([0, 1] + [0] * 8), b"\x7f" * 10, b"\x80" * 10, b"\xff" * 10, b"\x80" + b"\x00" * 9]


def frame(spark, keys):
    return spark.createDataFrame([(bytearray(k), i) for i, k in enumerate(keys)], "key binary, id long")


def keys(n, seed=0, distinct=None):
    r = random.Random(seed)
    pool = [r.randbytes(10) for _ in range(distinct or n)] + EDGE
    return [r.choice(pool) for _ in range(n)]


def test_split_key_and_hex(spark):
    df = split_key(spark.createDataFrame([(bytearray(bytes(range(100))),)], "rec binary"), "rec")
    r = df.select(key_hex(F.col("key")).alias("h"), F.octet_length("value").alias("n"), "value").first()
    assert r.h == "00 01 02 03 04 05 06 07 08 09 " and r.n == 90 and r.value[0] == 10


def test_n_choose_r(spark):
    from math import comb

    rows = [(k, r) for k in range(1, 40, 3) for r in range(0, k + 2)]
    got = spark.createDataFrame(rows, "k long, r int").select("k", "r", n_choose_r("k", "r").alias("c")).collect()
    assert all(x.c == (comb(x.k, x.r) if 1 <= x.r <= x.k else None) for x in got)


@pytest.mark.parametrize("n,buckets", [(0, 4), (1, 4), (237, 5), (500, 40)])
def test_row_index(spark, n, buckets):
    df = frame(spark, keys(n, distinct=30)).repartition(3)
    got = [(r.id, r.idx) for r in R.with_row_index(df, ["key", "id"], buckets=buckets).collect()]
    want = [r.id for r in sorted(df.collect(), key=lambda r: (bytes(r.key), r.id))]
    assert sorted(got, key=lambda x: x[1]) == [(i, k) for k, i in enumerate(want)]


def test_row_index_with_nulls(spark):
    df = spark.createDataFrame([(None, 1), (2, 2), (None, 3), (1, 4)], "a long, id long")
    got = {r.id: r.idx for r in R.with_row_index(df, ["a", "id"]).collect()}
    assert got == {1: 0, 3: 1, 4: 2, 2: 3}


@pytest.mark.parametrize("n,parts", [(7, 7), (8, 7), (100, 7), (101, 2)])
def test_split_input(spark, n, parts):
    got = {r.id: r.split_id for r in R.split_input(frame(spark, keys(n)), parts, ["id"]).collect()}
    assert got == {i: min(i // (n // parts), parts - 1) for i in range(n)}


def test_split_input_refuses(spark):
    with pytest.raises(ValueError):
        R.split_input(frame(spark, keys(3)), 4, ["id"])
    with pytest.raises(ValueError):
        R.split_input(frame(spark, keys(3)), 1, ["id"])


@pytest.mark.parametrize("n,s", [(100, 100), (100, 7), (101, 10), (5, 50), (0, 5)])
def test_systematic_sample(spark, n, s):
    got = sorted(r.id for r in R.systematic_sample(frame(spark, keys(n)), s, ["id"]).collect())
    s = min(n, s)
    assert got == ([i * (n // s) for i in range(s)] if n else [])


def test_choose_splitters(spark):
    ks = keys(50, 3, distinct=4)
    got = R.splitter_list(R.choose_splitters(frame(spark, ks), "key", 7))
    assert got == [sorted(ks)[i * (50 // 7)] for i in range(1, 7)]
    with pytest.raises(ValueError):
        R.choose_splitters(frame(spark, ks[:3]), "key", 4)


@pytest.mark.parametrize("p", [1, 2, 10, 65, 90])
def test_range_assign_is_bisect_right(spark, p):
    ks = keys(300, 5)
    cuts = sorted(random.Random(1).choices(ks, k=p - 1))
    got = {r.id: r.pid for r in R.range_assign(frame(spark, ks), "key", cuts).collect()}
    assert got == {i: bisect.bisect_right(cuts, k) for i, k in enumerate(ks)}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.sampled_from(EDGE), min_size=8, max_size=40))
def test_total_sort_is_a_sorted_permutation(spark, ks):
    df = R.total_sort(frame(spark, ks), "key", 4, ["id"], num_samples=8)
    rows = df.withColumn("part", F.spark_partition_id()).collect()
    assert all(r.part == r.pid for r in rows)
    got = [(bytes(r.key), r.id) for r in sorted(rows, key=lambda r: r.pid)]
    assert got == sorted((k, i) for i, k in enumerate(ks))


def test_total_sort_ways_agree(spark):
    ks = keys(400, 9, distinct=60)
    sampled = R.list_partitions(R.total_sort(frame(spark, ks), "key", 6, ["id"], 50), "key", ["id"]).collect()
    sampled.sort(key=lambda r: (r.pid, r.pos))
    builtin = R.total_sort(frame(spark, ks), "key", 6, ["id"], method="builtin").collect()
    assert [r.id for r in sampled] == [r.id for r in builtin]
    assert R.total_sort(frame(spark, []), "key", 3, ["id"]).collect() == []


def test_exchange_matrix(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 0)], "s int, d int")
    want = {(0, 0, 0, 0), (0, 1, 2, 200), (0, 2, 0, 0), (1, 0, 1, 100), (1, 1, 0, 0), (1, 2, 0, 0)}
    assert {tuple(r) for r in R.exchange_matrix(df, "s", "d", 2, 3).collect()} == want


def test_range_assign_with_keys_of_any_length(spark):
    r = random.Random(4)
    ks = [r.randbytes(r.randrange(20)) for _ in range(400)] + [b"", b"\0", b"\0\0", b"a" * 17, b"a" * 16]
    cuts = sorted(r.choices(ks, k=80))
    got = {x.id: x.pid for x in R.range_assign(frame(spark, ks).repartition(3), "key", cuts).collect()}
    assert got == {i: bisect.bisect_right(cuts, k) for i, k in enumerate(ks)}


def test_total_sort_reads_its_input_twice(spark, tmp_path):
    """Once its key and tie-break for the sample, once whole; the splitters come from written tables."""
    frame(spark, keys(200)).write.parquet(str(tmp_path / "t"))
    plan = R.total_sort(spark.read.parquet(str(tmp_path / "t")), "key", 4, ["id"], 40)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Python" not in plan


def test_appended_and_overwritten_files(spark, tmp_path):
    from rangeloom.sources.fixed import read_records, write_records

    rows = [(bytearray(bytes([i]) * 10), bytearray(bytes([i]) * 90)) for i in range(60)]
    part = lambda a, b: spark.createDataFrame(rows[a:b], "key binary, value binary").coalesce(1)
    path = str(tmp_path / "r")
    for a, b in ((0, 20), (20, 40), (40, 60)):
        write_records(part(a, b), path)
    got = [(x.place, bytes(x.key)) for x in read_records(spark, path, places=True, split_bytes=700).orderBy("place").collect()]
    assert got == [(i, bytes([i]) * 10) for i in range(60)]
    write_records(part(5, 9), path, "overwrite")
    assert sorted(bytes(x.key)[0] for x in read_records(spark, path).collect()) == [5, 6, 7, 8]


def test_fixed_width_files(spark, tmp_path):
    from rangeloom.sources.fixed import read_records, write_records

    r = random.Random(6)
    rows = [r.randbytes(100) for _ in range(57)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"".join(rows[:40]) + b"short tail")
    (tmp_path / "in" / "b").write_bytes(b"".join(rows[40:]))
    (tmp_path / "in" / "c").write_bytes(b"")
    df = read_records(spark, str(tmp_path / "in"), split_bytes=1000)
    assert sorted(bytes(x.key) + bytes(x.value) for x in df.collect()) == sorted(rows)
    ordered = R.total_sort(df, "key", 3, ["value"], num_samples=30)
    write_records(ordered, str(tmp_path / "out"))
    out = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert out == b"".join(sorted(rows))
    assert not list((tmp_path / "out").glob(".part*"))


def grouped(n=900, seed=3):
    """Rows of five groups: one holds a third of all rows, one is null, one has a single row."""
    r = random.Random(seed)
    rows = [(r.choice(["hot", "a", "b", None]) if r.random() > 0.33 else "hot", i, r.choice([None, None, float(i)])) for i in range(n)]
    return [*rows, ("one", n, None)]


@pytest.mark.parametrize("n", [0, 900])
def test_place_and_last_in_group(spark, n):
    rows = grouped(n) if n else []
    df = spark.createDataFrame(rows, "g string, at long, x double")
    place, last, want = {}, {}, {}
    for g, at, x in sorted(rows, key=lambda t: t[1]):
        place[g] = place.get(g, -1) + 1
        last[g] = x if x is not None else last.get(g)
        want[at] = (g, place[g], last[g])
    both = R.last_in_group(R.place_in_group(df, ["g"], ["at"]), ["g"], ["at"], "x", "y")
    assert {r.at: (r.g, r.place, r.y) for r in both.collect()} == want
    assert both.columns == ["g", "at", "x", "place", "y"]


def test_a_hot_group_is_spread(spark):
    df = spark.createDataFrame([("hot", i) for i in range(4000)], "g string, at long")
    numbered = R._ranged(df, ["g", "at"], 16)
    most = numbered.groupBy("__range").count().agg(F.max("count")).first()[0]
    assert numbered.count() == 4000 and most < 1000
    plan = R.place_in_group(df, ["g"], ["at"])._jdf.queryExecution().optimizedPlan().toString()
    # The only window is over a row for each group and range.
    assert plan.count("Window") == 1 and "sum(__n" in plan[plan.index("Window") :].split("\n")[0]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sample_is_picked_by_the_tasks_of_the_ranges(spark, tmp_path):
    """Each task that reads a part of the sorted ranges picks its own rows: as many tasks as ranges, and no rows are brought together."""
    df = frame(spark, keys(4000)).repartition(5)
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        sample, total = R._sample(df, 40, ["id"])
        assert total == 4000 and sample.rdd.getNumPartitions() >= 16
        assert "Coalesce" not in plan_of(sample) and "Exchange SinglePartition" not in plan_of(sample)
        assert sorted(r.id for r in sample.collect()) == list(range(0, 4000, 100))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_sample_by_place_moves_nothing(spark):
    df = frame(spark, keys(1000)).withColumn("place", F.col("id")).repartition(4)
    sample, _ = R._sample(df, 10, ["id"], "place")
    assert "rangepartitioning" not in plan_of(sample) and "Sort" not in plan_of(sample)
    assert sorted(r.id for r in R.systematic_sample(df, 10, ["id"], "place").collect()) == list(range(0, 1000, 100))
    rows = R.total_sort(df, "key", 4, ["id"], 200, place="place").collect()
    want = R.total_sort(df, "key", 4, ["id"], 200).collect()
    assert [(r.pid, r.id) for r in rows] == [(r.pid, r.id) for r in want]


def test_partitions_follow_the_size(spark):
    assert [R.partitions_for(n) for n in (0, 1, 10**7, 10**9, 10**12)] == [6, 6, 8, 746, 745059]
    assert R.total_sort(frame(spark, keys(500)), "key", None, ["id"], 50).select("pid").distinct().count() == 6
    assert [r.id for r in R.total_sort(frame(spark, [b"b", b"a"]), "key", None, ["id"]).collect()] == [1, 0]


@pytest.mark.parametrize("name", ["uniform", "skew", "one"])
def test_balanced_sort(spark, name):
    """Sorted as a whole whatever the keys, and no partition above twice the mean, with keys that a third of all or all records have."""
    r = random.Random(2)
    hot = r.randbytes(10)
    ks = {"uniform": keys(6000), "skew": [hot if r.random() < 0.4 else r.randbytes(10) for _ in range(6000)], "one": [hot] * 6000}[name]
    df = R.total_sort(frame(spark, ks).repartition(3), "key", 10, ["id"], method="balanced")
    rows = df.withColumn("part", F.spark_partition_id()).collect()
    assert all(x.part == x.pid for x in rows)
    assert [(bytes(x.key), x.id) for x in rows] == sorted((k, i) for i, k in enumerate(ks))
    sizes = [sum(x.pid == p for x in rows) for p in range(10)]
    assert max(sizes) < 2 * len(ks) / 10


def test_balanced_sort_of_few_and_none(spark):
    assert R.total_sort(frame(spark, []), "key", 4, ["id"], method="balanced").collect() == []
    assert [r.id for r in R.total_sort(frame(spark, [b"b", b"a", b"b"]), "key", 4, ["id"], method="balanced").collect()] == [1, 0, 2]


def test_sort_keys_order_as_their_columns(spark):
    from pyspark.sql import types as T

    from rangeloom.operators.quantiles import sort_key

    r = random.Random(1)
    rows = [(r.choice([None, r.randrange(-(2**63), 2**63), 0, -1]), r.choice([None, "", "a", "a\0", "ab", "é", "a!"]), r.choice([None, bytearray(r.randbytes(2)), bytearray(b"\0"), bytearray(b"")]), r.choice([None, True, False])) for _ in range(400)]
    df = spark.createDataFrame(rows, "a long, b string, c binary, d boolean").withColumn("t", F.timestamp_micros((F.col("a") / 1000000).cast("long"))).withColumn("e", F.date_add(F.lit("2000-01-01").cast("date"), F.length("b"))).withColumn("id", F.monotonically_increasing_id())
    for cols in (["a"], ["b"], ["c", "a"], ["d", "b", "c"], ["t", "id"], ["e", "b"]):
        ties = [*cols, "id"]
        got = [x.id for x in df.orderBy(sort_key(df, ties)).collect()]
        assert got == [x.id for x in df.orderBy(*ties).collect()]
    with pytest.raises(TypeError):
        sort_key(df.withColumn("x", F.lit(1.5).cast(T.DoubleType())), ["x"])


def test_summary_error_is_certain(spark):
    """Ranks of the quantiles are off by no more than the summary says, in sorted, reversed and repeated input, merged or not."""
    from rangeloom.operators.quantiles import quantile_summary

    r = random.Random(3)
    n = 30_000
    for kind, values in {"up": range(n), "down": range(n, 0, -1), "mixed": r.sample(range(n), n), "few": [r.randrange(5) for _ in range(n)]}.items():
        df = spark.createDataFrame([(bytearray(v.to_bytes(4, "big")),) for v in values], "k binary").repartition(9)
        s = quantile_summary(df, "k", size=128, together=3)
        assert s.count == n and 0 < s.error < n / 8
        ordered = sorted(values)
        cuts = [int.from_bytes(q, "big") for q in s.quantiles(10)]
        assert cuts == sorted(set(cuts))
        for i, q in enumerate(s.quantiles(10) if kind != "few" else [], 1):
            v = int.from_bytes(q, "big")
            lo, hi = bisect.bisect_left(ordered, v), bisect.bisect_right(ordered, v)
            assert lo - s.error - 1 <= i * n / 10 <= hi + s.error + 1
    assert quantile_summary(df.where("false"), "k").quantiles(5) == []


def test_balanced_cuts_count_exactly(spark):
    from rangeloom.operators.quantiles import balanced_cuts

    ks = keys(5000, 4, distinct=700)
    cuts, sizes = balanced_cuts(frame(spark, ks).repartition(4), "key", 8, size=64)
    assert len(sizes) == len(cuts) + 1 and cuts == sorted(set(cuts))
    ordered = sorted(ks)
    at = [bisect.bisect_left(ordered, c) for c in cuts]
    assert sizes.tolist() == [b - a for a, b in zip([0, *at], [*at, len(ks)], strict=True)]
    assert max(sizes) < 2 * len(ks) / 8


def test_scan_place(spark, tmp_path):
    """Rows of files are numbered as they are read, without moving any."""
    spark.range(5000).repartition(7).write.parquet(str(tmp_path / "t"))
    df = R.with_scan_place(spark.read.parquet(str(tmp_path / "t")))
    assert sorted(r.place for r in df.collect()) == list(range(5000))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan and "Repartition" not in plan
    sample = R.systematic_sample(df, 100, ["id"], "place").collect()
    assert sorted(r.idx for r in sample) == list(range(0, 5000, 50))


def test_record_files_are_sorted_once(spark, tmp_path, monkeypatch):
    """The splitters' sample neither sorts nor writes the line items."""
    import hashlib

    from rangeloom.jobs import catalog

    rows = [(i // 3, i * 7 % 50, i % 11, i % 3) for i in range(900)]
    li = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").selectExpr("*", "timestamp_seconds(86400 * l_orderkey) AS l_shipdate")
    li.repartition(4).write.parquet(str(tmp_path / "lineitem.parquet"))

    def refuse(*_):
        raise AssertionError("all rows were sorted for a sample")

    monkeypatch.setattr(R, "_ranged", refuse)
    got = [(r.place, r.key_hex, r.value) for r in catalog.record_files(spark, str(tmp_path)).orderBy("place").collect()]
    texts = [f"{o}-{p}-{s}-{n}-{86400 * o}" for o, p, s, n in rows]
    want = sorted((hashlib.md5(t.encode()).hexdigest()[:20], t.ljust(90, ".")) for t in texts)
    assert got == [(i, "".join(k[j : j + 2] + " " for j in range(0, 20, 2)), v) for i, (k, v) in enumerate(want)]

import itertools
import random
from math import comb

import pytest
from pyspark.sql import functions as F

from rangeloom.functions.keys import from_words, to_words
from rangeloom.operators import coded as C

WORDS = ["w0", "w1"]


def masks(k, r):
    return sorted(sum(1 << (i - 1) for i in s) for s in itertools.combinations(range(1, k + 1), r))


def nodes(mask):
    return [i + 1 for i in range(20) if mask >> i & 1]


@pytest.mark.parametrize("k,r", [(3, 1), (6, 3), (6, 6), (5, 2)])
def test_subsets_and_placement(spark, k, r):
    got = [(x.subset_id, x.mask, x.nodes) for x in C.node_subsets(spark, k, r).orderBy("subset_id").collect()]
    assert got == [(i, m, nodes(m)) for i, m in enumerate(masks(k, r))]
    per = C.placement(spark, k, r).groupBy("node").count().collect()
    assert {x["count"] for x in per} == {comb(k - 1, r - 1)} and len(per) == k


def test_subsets_refuse(spark):
    for k, r in ((3, 4), (3, 0), (21, 2)):
        with pytest.raises(ValueError):
            C.node_subsets(spark, k, r)


def test_groups_and_demand(spark):
    assert C.groups_of_node(spark, 6, 3, 2).count() == comb(5, 3)
    for r in (1, 2, 5):
        rows = C.exchange_demand(spark, 6, r).collect()
        assert len(rows) == (6 - r) * comb(6, r) == (r + 1) * comb(6, r + 1)
        assert all(x.dest not in x.nodes and len(x.nodes) == r for x in rows)


def table(spark, k, r, seed, n=300):
    """Records with uneven, short and empty blocks."""
    g = random.Random(seed)
    blocks = [(f, d) for f in range(1, comb(k, r) + 1) for d in range(1, k + 1)]
    weights = [g.choice([0, 0, 1, 5, 20]) for _ in blocks]
    picked = g.choices(blocks, weights=weights, k=n)
    return spark.createDataFrame([(i, f, d, g.randrange(2**62), g.randrange(2**62)) for i, (f, d) in enumerate(picked)], "id long, file_id long, dest int, w0 long, w1 long")


@pytest.mark.parametrize("k,r", [(3, 1), (3, 2), (4, 2), (5, 4), (6, 3)])
def test_decode_gives_back_what_was_encoded(spark, k, r):
    df = table(spark, k, r, 10 * k + r)
    p = {n: t.cache() for n, t in C.coded_parts(df, k, r, ["id"]).items()}
    packets = C.xor_encode(p["chunks"], WORDS)
    back = C.xor_decode(packets, p["meta"], p["chunks"], WORDS)
    whole = C.reassemble(p["local"], back, WORDS)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, df.select("dest", "file_id", *WORDS).collect()))
    meta = p["meta"].collect()
    assert len(meta) == r * (k - r) * comb(k, r)
    check = lambda decoded, local=p["local"]: {x.node: x.ok for x in C.completeness(spark, local, decoded, p["blocks"], k, r).collect()}
    assert check(back) == {i: True for i in range(1, k + 1)}
    # Without one of the chunks, the node that wanted it is not complete, and no other.
    if lost := back.first():
        short = back.where(f"not (dest = {lost.dest} and file_id = {lost.file_id} and part = {lost.part})")
        assert check(short) == {i: i != lost.dest for i in range(1, k + 1)}
    # Nor is a node that has lost lines of its own.
    own = {x.dest for x in p["local"].collect()}
    assert check(back, p["local"].where("false")) == {i: i not in own for i in range(1, k + 1)}
    heads = C.packet_metadata(p["meta"], r).collect()
    assert len(heads) == (r + 1) * comb(k, r + 1) and {x.header_bytes for x in heads} == {4 + 44 * r}
    assert {len(x.chunks) for x in heads} == {r} and all(x.packet_size == max(c["size"] for c in x.chunks) for x in heads)


def test_chunk_sizes(spark):
    df = spark.createDataFrame([(i, 1, 4) for i in range(8)] + [(100 + i, 2, 3) for i in range(2)], "id long, file_id long, dest int")
    rows = C.chunk_blocks(C.remote(df, spark, 4, 3), 3, ["id"]).orderBy("id").collect()
    assert [(x.part, x.offset) for x in rows] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (2, 3), (2, 0), (2, 1)]
    assert [x.sender for x in rows] == [1, 1, 2, 2, 3, 3, 3, 3, 4, 4]


def test_prune(spark):
    placed = C.placement(spark, 4, 2)
    df = table(spark, 4, 2, 3, 80)
    full = C.replicate(df, placed)
    kept = {(x.id, x.node) for x in C.prune_replicas(full, placed).collect()}
    files = {}
    for x in placed.collect():
        files.setdefault(x.file_id, set()).add(x.node)
    assert full.count() == 160
    assert kept == {(x.id, x.node) for x in full.collect() if x.dest == x.node or x.dest not in files[x.file_id]}


def test_coded_sort_equals_total_sort(spark):
    g = random.Random(4)
    rows = [(bytearray(g.randbytes(10)), i) for i in range(240)]
    df = spark.createDataFrame(rows, "key binary, id long").withColumns({f"k{i}": F.conv(F.hex(F.substring("key", 1 + 5 * i, 5)), 16, 10).cast("long") for i in range(2)})
    got = C.coded_sort(df, "key", 4, 2, ["k0", "k1", "id"], ["id"], 100).withColumn("p", F.spark_partition_id()).collect()
    assert [x.id for x in sorted(got, key=lambda x: x.p)] == [i for _, i in sorted((bytes(k), i) for k, i in rows)]
    assert all(x.p == x.dest - 1 for x in got)


def test_coded_sort_by_places(spark):
    """Rows that carry their place are neither sorted nor moved to be dealt to files, and get the same files."""
    g = random.Random(6)
    rows = [(bytearray(g.randbytes(10)), i, i) for i in range(240)]
    df = spark.createDataFrame(rows, "key binary, id long, place long").withColumns({f"k{i}": F.conv(F.hex(F.substring("key", 1 + 5 * i, 5)), 16, 10).cast("long") for i in range(2)})
    placed = C.place_records(df, "key", ["id"], 4, 2, 100, "place")
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan and "Sort" not in plan and "Join" not in plan
    sort = lambda *place: sorted(map(tuple, C.coded_sort(df, "key", 4, 2, ["k0", "k1", "id"], ["id"], 100, *place).collect()))
    assert sort("place") == sort()


def test_lines_stay_where_sizes_are_few(spark):
    """What is known of a block or chunk goes to the lines; no exchange brings lines together by the few blocks there are."""
    df = table(spark, 4, 2, 1, 50)
    p = C.coded_parts(df, 4, 2, ["id"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plans = [x._jdf.queryExecution().sparkPlan().toString() for x in (C.chunk_blocks(C.remote(df, spark, 4, 2), 2, ["id"], 4), C.xor_decode(C.xor_encode(p["chunks"], WORDS), p["meta"], p["chunks"], WORDS, 24))]
        assert plans[0].count("SortMergeJoin") == 0 and plans[1].count("BroadcastHashJoin") >= 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_coded_sort_notices_lost_lines(spark, monkeypatch):
    df = spark.createDataFrame([(bytearray([i % 251, i % 7] + [0] * 8), i) for i in range(200)], "key binary, id long")
    whole = C.xor_decode
    monkeypatch.setattr(C, "xor_decode", lambda *a: whole(*a).where("not (dest = 2 and part = 0)"))
    with pytest.raises(ValueError, match="lacks lines"):
        C.coded_sort(df.withColumn("k", F.col("id")), "key", 4, 2, ["k", "id"], ["id"], 50)


def test_records_as_words(spark):
    r = random.Random(2)
    rows = [(bytearray(b),) for n in (100,) for b in [bytes(n), b"\xff" * n, *(r.randbytes(n) for _ in range(20))]]
    df = spark.createDataFrame(rows, "rec binary")
    for size in (100, 96, 1, 7):
        words = to_words(F.substring("rec", 1, size), size, "w")
        got = df.withColumns(words).select(F.substring("rec", 1, size).alias("a"), from_words(list(words), size).alias("b")).collect()
        assert len(words) == -(-size // 8) and all(bytes(x.a) == bytes(x.b) for x in got)


def test_hot_block_is_chunked_over_ranges(spark):
    """A block that holds nearly all lines is not numbered in one window."""
    df = spark.range(5000).select("id", F.lit(1).cast("long").alias("file_id"), F.lit(4).alias("dest")).unionByName(spark.range(7).select("id", F.lit(2).cast("long").alias("file_id"), F.lit(3).alias("dest")))
    chunks = C.chunk_blocks(C.remote(df, spark, 4, 3), 3, ["id"])
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(file_id" not in plan and plan.count("Window") <= 2
    sizes = {(x.file_id, x.part): x["count"] for x in chunks.groupBy("file_id", "part").count().collect()}
    assert sizes == {(1, 0): 1666, (1, 1): 1666, (1, 2): 1668, (2, 0): 2, (2, 1): 2, (2, 2): 3}


def test_load_report(spark):
    df = table(spark, 6, 3, 8, 600)
    rows = C.load_report(df, 6, 3).collect()
    sizes = {(x.file_id, x.dest): x["count"] for x in df.groupBy("file_id", "dest").count().collect()}
    own = {i + 1: set(nodes(m)) for i, m in enumerate(masks(6, 3))}
    assert {x.node: x.remote_lines for x in rows} == {d: sum(n for (f, e), n in sizes.items() if e == d and d not in own[f]) for d in range(1, 7)}
    assert {x.node: x.lines_mapped for x in rows} == {d: sum(n for (f, _), n in sizes.items() if d in own[f]) for d in range(1, 7)}


def test_no_cross_joins(spark):
    p = C.coded_parts(table(spark, 4, 2, 1, 50), 4, 2, ["id"])
    plan = C.xor_decode(C.xor_encode(p["chunks"], WORDS), p["meta"], p["chunks"], WORDS)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from rangeloom.llm import mixing
from rangeloom.llm.mixing import MixSpec

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    return sorted((dict(sorted(r.items())) for r in rows), key=repr)


def test_query_equals_sql(spark, sf, duck):
    got = mixing.op8_block_mix(spark, sf)
    assert plain(r.asDict() for r in got.collect()) == plain(duck(mixing.OP8_SQL))
    again = mixing.op8_block_mix(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_targets_are_met(spark, sf):
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    taken, targets = defaultdict(int), {}
    for r in mixing.op8_block_mix(spark, sf).collect():
        assert 0 <= r.taken <= 3 * r.size
        taken[docs[r.doc_id]] += r.taken
        targets[docs[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= 1 for s, t in targets.items())


def water_level(sizes, weights):
    """Targets by the words of the contract: share, cut at three times the size, share the excess again."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > 3 * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = 3 * sizes[i]
            left -= target[i]
            open_.remove(i)
    return target


@pytest.mark.parametrize("sizes", [[10, 1000, 50, 3, 70], [5, 5, 5], [0, 0], [1, 100000], [0, 8, 0]])
def test_excess_is_shared_again(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, size long")
    got = [r.target for r in mixing.targets(df).orderBy("source_no").collect()]
    assert got == pytest.approx(water_level(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))]))


def test_sources_by_code_point_null_last(spark):
    df = spark.createDataFrame([("b", 9), (None, 9), ("é", 9), ("B", 9)], "source string, size long")
    assert [r.source for r in mixing.targets(df).orderBy("source_no").collect()] == ["B", "b", "é", None]


def swap_or_not(i, n, key, rounds=24):
    for r in range(1, rounds + 1):
        mirror = (int(hashlib.md5(f"{key}:{r}:k".encode()).hexdigest()[:12], 16) - i) % n
        if int(hashlib.md5(f"{key}:{r}:{max(i, mirror)}".encode()).hexdigest()[0], 16) >= 8:
            i = mirror
    return i


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 166667, 333334, 1000003])
def test_permutation(spark, n):
    """One to one, equal to a plain version, and without a stride, whatever the number of blocks."""
    from pyspark.sql import functions as F

    k = min(n, 20000)
    got = [r.p for r in spark.range(k).select("id", mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("0:1:2"), 24).alias("p")).orderBy("id").collect()]
    assert len(set(got)) == k and 0 <= min(got) and max(got) < n
    assert got[:50] == [swap_or_not(i, n, "0:1:2") for i in range(min(k, 50))]
    if k > 500:
        steps = [(b - a) % n for a, b in zip(got, got[1:])]
        assert len(set(steps)) > 0.6 * min(k, n) and 0.45 < sum(x < y for x, y in zip(got, got[1:])) / k < 0.55
        # Chi-squared of the tenths of the range over the tenths of the places.
        cells = Counter((10 * i // k, 10 * p // n) for i, p in enumerate(got))
        assert sum((cells[i, j] - k / 100) ** 2 / (k / 100) for i in range(10) for j in range(10)) < 180


def test_pieces_fill_slots(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    spec = MixSpec(block=64, shard_slots=16)
    rows, pieces = mixing.mix(docs.select("doc_id", "source", mixing.word_count(docs.text).alias("size")), spec)
    slots = defaultdict(int)
    by_doc = defaultdict(set)
    for p in pieces.collect():
        slots[p.shard, p.shard_slot] += p.n_words
        for w in range(p.word_start, p.word_start + p.n_words):
            assert (p.epoch, w) not in by_doc[p.doc_id]
            by_doc[p.doc_id].add((p.epoch, w))
    assert max(slots.values()) <= 64 and len({s for s, _ in slots}) > 3
    shards = defaultdict(int)
    for s, i in slots:
        assert 0 <= i < 16
        shards[s] += 1
    assert sorted(shards.values())[1:] == [16] * (len(shards) - 1)


def test_odd_rows_equal_sql(spark, odd, odd_rows, duck, empty):
    assert plain(r.asDict() for r in mixing.taken(odd).collect()) == plain(duck(mixing.OP8_SQL, odd_rows))
    assert mixing.taken(empty).collect() == []


def test_mixed_documents(spark, sf, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r for r in docs.collect()}
    out = mixing.mixed_documents(docs, MixSpec(block=64))
    assert out.columns == docs.columns and mixing.mixed_documents(empty).count() == 0
    words, total = defaultdict(int), 0
    for r in out.collect():
        own = WORD.findall(r.text)
        assert r.n_chars == len(r.text) and r.source == texts[r.doc_id].source
        whole = WORD.findall(texts[r.doc_id].text)
        assert own == whole if len(own) == len(whole) else set(own) <= set(whole)
        words[r.source] += len(own)
    sizes = docs.select("source", mixing.word_count(docs.text).alias("size"))
    for t in mixing.targets(sizes, MixSpec(block=64)).collect():
        assert abs(words[t.source] - t.target) <= 1


def test_no_python_in_plan(spark, sf):
    plan = mixing.op8_block_mix(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_repeated_rows_count_once(spark, odd):
    docs = odd.where("doc_id in (4, 9, 12)").selectExpr("*", "1 AS tag", "2 AS epoch", "3 AS block")
    out = mixing.mixed_documents(docs.unionByName(docs), MixSpec(block=64)).collect()
    once = mixing.mixed_documents(docs.dropDuplicates(), MixSpec(block=64)).collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted((r.doc_id, r.text) for r in once)


def test_shards_are_drawn(spark):
    """Source counts by shard vary as a draw's do, and the draw is that of a plain version."""
    sizes = spark.createDataFrame([(f"s{i}", 20000 * 512) for i in range(5)], "source string, size long")

    def deal(seed):
        spec = MixSpec(weights=(1,), seed=seed)
        return sorted((r.source_no, r.slot, r.shard, r.shard_slot) for r in mixing.slots(mixing.targets(sizes, spec), spec).collect())

    got = deal(0)
    assert sorted(h * 2048 + i for _, _, h, i in got) == list(range(100000))
    counts = defaultdict(int)
    for source, _, shard, _ in got:
        counts[source, shard] += 1
    var = 2048 * 0.2 * 0.8 * (100000 - 2048) / (100000 - 1)
    ratios = [(counts[s, h] - 2048 * 0.2) ** 2 / var for s in range(5) for h in range(100000 // 2048)]
    assert 0.6 < sum(ratios) / len(ratios) < 1.5
    order = sorted((int(hashlib.md5(f"0:{s}:{i}".encode()).hexdigest()[:15], 16) % 1024, int(hashlib.md5(f"0:{s}:{i}".encode()).hexdigest()[:15], 16), s, i) for s in range(5) for i in range(20000))
    want = defaultdict(int)
    for place, (_, _, s, _) in enumerate(order):
        want[s, place // 2048] += 1
    assert counts == want
    assert deal(0) == got != deal(1)


def test_shards_are_in_the_plan(spark, sf):
    plan = mixing.op8_block_mix(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "shard" in plan


def test_hot_and_null_ids_are_chunked(spark):
    """Ids in steps of 256 and null ids of one source do not meet in one chunk."""
    from pyspark.sql import functions as F

    sizes = spark.range(20000).select(F.when(F.col("id") % 2 == 0, F.col("id") * 256).alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 997 + 1).alias("size"))
    rows = mixing.packed(sizes, mixing.targets(sizes))
    assert rows.groupBy("chunk").count().agg(F.max("count")).first()[0] < 400
    assert rows.agg(F.max(F.col("at") + F.col("size"))).first()[0] == sizes.agg(F.sum("size")).first()[0]


def test_the_draw_of_mixed_documents(spark, sf):
    """Where a document's first words were drawn to, under a name of the caller's: slots of shards, each used once by words that begin there."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    spec = MixSpec(block=64, shard_slots=16)
    out = mixing.mixed_documents(docs, spec, draw="drawn")
    rows = out.select("doc_id", "source", "drawn.*").collect()
    assert out.columns == [*docs.columns, "drawn"] and len({r.shard for r in rows}) > 5
    assert all(0 <= r.slot < spec.shard_slots and 0 <= r.epoch <= spec.max_epochs for r in rows)
    by_slot = {}
    for r in rows:
        by_slot.setdefault((r.shard, r.slot), set()).add((r.source, r.epoch))
    assert all(len(v) == 1 for v in by_slot.values())

import hashlib
import re

import pytest

from rangeloom.llm import exact
from rangeloom.shared import new_path


def rows_of(df):
    return sorted((r.asDict() for r in df.collect()), key=repr)


def plain(rows):
    return sorted((dict(sorted(r.items())) for r in rows), key=repr)


def test_query_equals_sql(spark, sf, duck):
    assert plain(rows_of(exact.op3_digest_index(spark, sf))) == plain(duck(exact.OP3_SQL))


def test_odd_rows_equal_sql(spark, odd, odd_rows, duck):
    got = rows_of(exact.deduplicate(odd, exact.new_index(spark, 4)))
    assert plain(got) == plain(duck(exact.OP3_SQL, odd_rows))


def test_longest_then_smallest_stays(spark):
    df = spark.createDataFrame([(3, "a b"), (1, "ab"), (2, "a b"), (4, "a  b ")], "doc_id long, text string")
    got = {r.doc_id: r for r in exact.deduplicate(df, exact.new_index(spark, 4)).collect()}
    assert {r.keep_id for r in got.values()} == {4} and [got[i].kept for i in (1, 2, 3, 4)] == [False, False, False, True]
    assert got[1].text_sha256 == hashlib.sha256(b"ab").hexdigest() and got[1].group_size == 4


def test_index_outlives_a_batch(spark):
    index = exact.new_index(spark, 4)
    one = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    two = spark.createDataFrame([(3, " x "), (4, "z"), (5, "z")], "doc_id long, text string")
    assert [r.kept for r in exact.deduplicate(one, index).orderBy("doc_id").collect()] == [True, True]
    again = exact.DigestIndex(spark, index.path, 4)
    got = [(r.doc_id, r.keep_id, r.kept) for r in exact.deduplicate(two, again).orderBy("doc_id").collect()]
    assert got == [(3, 1, False), (4, 4, True), (5, 4, False)]
    assert again.table().count() == 3


def test_add_twice_adds_once(spark):
    index = exact.new_index(spark, 4)
    groups = exact.groups_of(exact.digests(spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")))
    index.add(groups)
    index.add(groups)
    assert index.table().count() == 2


def test_anti_join_does_not_shuffle_the_index(spark):
    index = exact.new_index(spark, 4)
    groups = exact.groups_of(exact.digests(spark.createDataFrame([(1, "x")], "doc_id long, text string")))
    plan = index.missing(groups)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    physical = plan[plan.index("== Physical Plan ==") :]
    assert len(re.findall(r"Exchange hashpartitioning", physical)) == 1


def test_keep_rows(spark, odd, empty):
    kept = exact.keep_rows(odd, exact.new_index(spark, 4))
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == [3, 4, 5, 7, 8, 9, 10, 11, 13, 14] and exact.keep_rows(empty, exact.new_index(spark, 4)).count() == 0


def test_empty_table(spark, empty):
    assert exact.deduplicate(empty, exact.new_index(spark, 4)).collect() == []


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact.deduplicate(df, exact.new_index(spark, 4)).collect()}
    assert got == {(None, 1, False), (1, 1, True), (None, None, True)}


def test_a_null_id_does_not_win_by_length(spark):
    df = spark.createDataFrame([(None, "a  b"), (1, "ab"), (2, "ab"), (2, "a b"), (None, "c"), (None, "c ")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact.deduplicate(df, exact.new_index(spark, 4)).collect()}
    assert got == {(None, 2, False), (1, 2, False), (2, 2, True), (None, None, True)}


def many(spark, n, first=0):
    return spark.createDataFrame([(first + i, f"text {i}") for i in range(n)], "doc_id long, text string")


def test_another_number_of_buckets_is_refused(spark):
    """It would look for digests in wrong buckets and keep texts again."""
    index = exact.new_index(spark, 4)
    exact.deduplicate(many(spark, 100), index).count()
    with pytest.raises(ValueError, match="4 buckets, not 8"):
        exact.DigestIndex(spark, index.path, 8)
    again = exact.DigestIndex(spark, index.path)
    assert again.buckets == 4 and not exact.deduplicate(many(spark, 100, 1000), again).where("kept").count()


def test_an_index_is_rebucketed(spark):
    index = exact.new_index(spark, 4)
    exact.deduplicate(many(spark, 100), index).count()
    wider = index.compact(new_path(spark, "wider"), 16)
    assert exact.DigestIndex(spark, wider.path).buckets == 16
    assert {(r.keep_id, r.kept) for r in exact.deduplicate(many(spark, 120, 1000), wider).collect()} == {(i, False) for i in range(100)} | {(1000 + i, True) for i in range(100, 120)}


def test_files_without_a_number_of_buckets_are_refused(spark):
    path = new_path(spark, "bare")
    spark.sql("SELECT unhex('00') AS digest, 1L AS keep_id, 1L AS n_points").write.parquet(path)
    with pytest.raises(ValueError, match="how many buckets"):
        exact.DigestIndex(spark, path, 4)
    assert exact.DigestIndex(spark, new_path(spark, "fresh")).buckets == 64


@pytest.mark.parametrize("text,want", [(" a\tb\n", "ab"), ("a b", "a b"), ("\x1c", "\x1c")])
def test_white_space(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(exact.without_white(df.t)).first()[0] == want


def test_buckets_follow_the_rows():
    assert [exact.buckets_for(n) for n in (0, 1, 128_000_000, 128_000_001, 10**11)] == [64, 64, 64, 128, 65536]


def test_compacted_index_has_a_file_a_bucket(spark):
    index = exact.new_index(spark, 4)
    for i in range(3):
        df = spark.createDataFrame([(100 * i + j, f"text {i} {j}") for j in range(50)], "doc_id long, text string")
        exact.deduplicate(df, index).count()
    new = index.compact(new_path(spark, "compacted"))
    assert sorted(map(tuple, new.table().collect())) == sorted(map(tuple, index.table().collect())) and new.table().count() == 150
    assert len(new.table().inputFiles()) == 4 < len(index.table().inputFiles())
    again = exact.deduplicate(spark.createDataFrame([(1, "text 0 1"), (900, "new")], "doc_id long, text string"), new)
    assert {(r.doc_id, r.keep_id, r.kept) for r in again.collect()} == {(1, 1, False), (900, 900, True)}

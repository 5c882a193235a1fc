import json
import random

import pytest
from pyspark.sql import functions as F

from rangeloom.sources import fixed
from rangeloom.sources.fixed import FixedWidthSource, clear_replaced, read_records, read_records_by_hadoop, write_records
from rangeloom.sources.storage import Manifests, Storage


def records(n, seed=1):
    r = random.Random(seed)
    return [r.randbytes(100) for _ in range(n)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(bytearray(x[:10]), bytearray(x[10:])) for x in rows], "key binary, value binary").repartition(parts)


def read(df):
    return sorted(bytes(r.key) + bytes(r.value) for r in df.collect())


@pytest.fixture()
def elsewhere(spark, tmp_path):
    """A path of a file system that only Hadoop knows, with files of whole records, one with a tail, short and empty ones."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    name = "t" + tmp_path.name.replace("_", "").lower()
    conf.set(f"fs.viewfs.mounttable.{name}.link./in", f"file://{tmp_path}")
    rows = records(230)
    (tmp_path / "d").mkdir()
    for f, data in {"a": b"".join(rows[:100]), "b,x": b"".join(rows[100:150]) + b"tail", "c": b"".join(rows[150:]), "short": b"z" * 99, "empty": b""}.items():
        (tmp_path / "d" / f).write_bytes(data)
    return f"viewfs://{name}/in/d", rows


def test_read_by_hadoop(spark, elsewhere):
    path, rows = elsewhere
    df = read_records(spark, path)
    assert read(df) == sorted(rows)
    assert "Python" not in df._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="places"):
        read_records(spark, path, places=True)


def test_read_by_hadoop_cuts_files(spark, tmp_path):
    """A file of whole records is read by several tasks, cut at records."""
    rows = records(5000)
    (tmp_path / "one").write_bytes(b"".join(rows))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("mapreduce.input.fileinputformat.split.maxsize", "123456")
    try:
        df = read_records_by_hadoop(spark, f"file://{tmp_path}/one")
        parts = df.withColumn("p", F.spark_partition_id()).agg(F.count_distinct("p")).first()[0]
        assert parts >= 4 and read(df) == sorted(rows)
    finally:
        conf.unset("mapreduce.input.fileinputformat.split.maxsize")


def test_read_by_hadoop_of_only_short_files(spark, tmp_path):
    (tmp_path / "short").write_bytes(b"z" * 99)
    assert read_records_by_hadoop(spark, str(tmp_path)).collect() == []


def test_both_readers_agree(spark, tmp_path):
    rows = records(57)
    (tmp_path / "a").write_bytes(b"".join(rows) + b"12")
    assert read(read_records(spark, str(tmp_path), split_bytes=700)) == read(read_records_by_hadoop(spark, str(tmp_path))) == sorted(rows)


def test_a_killed_write_is_not_seen(spark, tmp_path):
    """Files that tasks left without a commit do not count, and can be cleared."""
    path = str(tmp_path / "r")
    rows = records(40)
    write_records(frame(spark, rows), path)
    writer = FixedWidthSource({"path": path}).writer(None, False)
    with writer.storage.create("part-000001-000000-dead") as f:
        f.write(b"q" * 300)
    assert read(read_records(spark, path)) == sorted(rows)
    assert clear_replaced(path) == 1 and read(read_records(spark, path)) == sorted(rows)


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = records(40)
    write_records(frame(spark, rows), path)
    bad = frame(spark, rows).withColumn("value", F.when(F.col("key") == bytearray(rows[7][:10]), F.raise_error(F.lit("stop"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="stop"):
        write_records(bad, path)
    assert read(read_records(spark, path)) == sorted(rows)


def test_a_write_is_committed_once(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = records(40)
    for _ in range(2):
        write_records(frame(spark, rows), path, write_id="batch-7")
    assert read(read_records(spark, path)) == sorted(rows)
    write_records(frame(spark, rows[:5]), path, write_id="batch-8")
    assert read(read_records(spark, path)) == sorted(rows + rows[:5])
    assert len(list((tmp_path / "r" / "_manifest").iterdir())) == 2


def test_an_overwrite_appears_at_once(spark, tmp_path):
    """A reader that listed before an overwrite still finds its files; later ones see the new ones alone."""
    path = str(tmp_path / "r")
    old, new = records(40), records(25, 2)
    write_records(frame(spark, old), path)
    before = read_records(spark, path)
    assert read(before) == sorted(old)
    write_records(frame(spark, new), path, "overwrite")
    assert read(before) == sorted(old) or read(before) == sorted(new)
    assert read(read_records(spark, path)) == sorted(new)
    assert clear_replaced(path) == 3 and read(read_records(spark, path)) == sorted(new)


def test_manifests_meet(tmp_path):
    """Of two commits that want the same number one gets the next."""
    m = Manifests(Storage(str(tmp_path)))
    put, taken = m.storage.put_new, []

    def late(name, data):
        if not taken:
            taken.append(put(name, json.dumps({"write": "other", "replaces": False, "files": [], "about": {}}).encode()))
        return put(name, data)

    m.storage.put_new = late
    assert m.commit("own", [{"name": "x", "bytes": 1}])
    assert [c["write"] for c in m.commits()] == ["other", "own"] and not m.commit("own", [])


def test_a_store_that_is_no_local_mount(tmp_path):
    """The same files through an address that is resolved by the file system library."""
    from pyarrow import fs

    storage = Storage(str(tmp_path))
    storage.fs, storage.root = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), "bucket"
    (tmp_path / "bucket").mkdir()
    (tmp_path / "bucket" / "_manifest").mkdir()
    with storage.create("part-0") as f:
        f.write(b"x" * 200)
    assert Manifests(storage).commit("w", [{"name": "part-0", "bytes": 200}]) and not Manifests(storage).commit("w", [])
    assert storage.list() == [("part-0", 200)] and not storage.put_new("_manifest/0000000000.json", b"{}")
    reader = fixed._Reader({"path": str(tmp_path), "keysize": 10, "valuesize": 90})
    reader.storage = storage
    assert [(p.start, p.stop, p.place) for p in reader.partitions()] == [(0, 200, 0)]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2

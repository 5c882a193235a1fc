import json
import random

import pytest
from pyspark.sql import functions as F

from rangeloom.sources.storage import Manifests, Storage
from rangeloom.streaming.controller import closing, start, tune_stream
from rangeloom.streaming.queue import _QueueReader, enqueue, read_queue
from tests.test_logs_and_tuning import outcome_rows, simulate

SECOND = 1_000_000
#: Spark's watermark begins at 1970 and takes what is not after it for late.
DAY = 86_400 * SECOND
OUT = "key long, seq long, cycle int, slot int, r_used int"


def jobs_of(spark, rows):
    return spark.createDataFrame(rows, "key long, order long, tie long, cost double").repartition(3)


def run(spark, tmp_path, jobs, name="q", most=1_000_000, **how):
    query = start(tune_stream(read_queue(spark, jobs, most), 1, 5, **how), str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-state"))
    try:
        query.processAllAvailable()
        return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]], query.recentProgress
    finally:
        query.stop()


def results(spark, tmp_path, name="q"):
    return {(r.key, r.seq): r.r_used for r in spark.read.schema(OUT).parquet(str(tmp_path / f"{name}-out")).collect()}


def wanted(rows):
    return {(k, i): u for k in {r[0] for r in rows} for i, u in enumerate(simulate([c for kk, _, _, c in sorted(set(rows)) if kk == k], 1, 5))}


def ties(seed=8):
    """Jobs of equal times, told apart by their ties."""
    r = random.Random(seed)
    return [(k, DAY + i // 6 * SECOND, 100 * (i % 6) + (50 if i % 2 else 0), float(r.randrange(100))) for k, n in ((1, 400), (2, 90), (3, 1)) for i in range(n)]


def test_stream_equals_batch(spark, tmp_path):
    """Jobs out of order within the delay, some of them twice, in bounded micro-batches."""
    rows = [(k, DAY + at * SECOND, 0, c) for k, at, c in outcome_rows(1)]
    rows.sort(key=lambda r: r[1])
    queue = str(tmp_path / "in")
    for i in range(0, len(rows), 200):
        part = rows[i : i + 200] + rows[max(0, i - 20) : i]
        random.Random(i).shuffle(part)
        enqueue(jobs_of(spark, part).withColumn("place", F.xxhash64("order", "key")), queue, ["place"], ranges=3)
    enqueue(closing(jobs_of(spark, rows), "3000 seconds").withColumn("place", F.lit(0).cast("long")), queue, ["place"], ranges=1)
    sizes, _ = run(spark, tmp_path, queue, most=150, delay="3000 seconds")
    assert max(sizes) <= 150 and results(spark, tmp_path) == wanted(rows)


def test_ties_and_late_jobs(spark, tmp_path):
    """Equal times are taken by the tie; a job that comes later than the delay allows is dropped."""
    rows = ties()
    queue = str(tmp_path / "in")
    enqueue(jobs_of(spark, rows), queue, ["order", "tie"], ranges=4)
    sizes, _ = run(spark, tmp_path, queue, most=64)
    assert sum(sizes) == len(rows) and max(sizes) <= 64
    enqueue(closing(jobs_of(spark, rows)), queue, ["order"], ranges=1)
    run(spark, tmp_path, queue, most=64)
    enqueue(jobs_of(spark, [(1, DAY + 5 * SECOND, 7, 1.0)]), queue, ["order"], ranges=1)
    run(spark, tmp_path, queue)
    assert results(spark, tmp_path) == wanted(rows)


def test_a_restart_goes_on(spark, tmp_path):
    """A query that is stopped between micro-batches and started anew takes each job once, with the state that it had."""
    rows = ties(3)
    queue = str(tmp_path / "in")
    enqueue(jobs_of(spark, [r for r in rows if r[1] < DAY + 20 * SECOND]), queue, ["order", "tie"], ranges=2)
    first, _ = run(spark, tmp_path, queue, most=50)
    enqueue(jobs_of(spark, [r for r in rows if r[1] >= DAY + 20 * SECOND]), queue, ["order", "tie"], ranges=2)
    enqueue(closing(jobs_of(spark, rows)), queue, ["order"], ranges=1)
    second, _ = run(spark, tmp_path, queue, most=50)
    assert sum(first) + sum(second) == len(rows) + 1 and max(first + second) <= 50
    assert results(spark, tmp_path) == wanted(rows)


def test_state_holds_the_delay_alone(spark, tmp_path):
    """What waits does not grow with the jobs that went by: a value and at most a list entry a key."""
    rows = [(k, DAY + i * SECOND, 0, float(i % 5)) for i in range(400) for k in range(3)]
    queue = str(tmp_path / "in")
    enqueue(jobs_of(spark, rows), queue, ["order", "key"], ranges=4)
    _, progress = run(spark, tmp_path, queue, most=120)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"] and p["numInputRows"]]
    assert len(held) >= 10 and max(held[5:]) <= max(held[:5]) + 6
    got = results(spark, tmp_path)
    assert 3 * 380 <= len(got) < len(rows) and got.items() <= wanted(rows).items()


def test_many_keys_share_a_state(spark, tmp_path):
    """Keys are kept together by buckets, so calls to the state store do not grow with them; cycles go on between micro-batches."""
    r = random.Random(5)
    rows = [(k - 300, DAY + (i * 600 + k) * SECOND // 200, 0, float(r.randrange(9))) for i in range(31) for k in range(600)]
    queue = str(tmp_path / "in")
    enqueue(jobs_of(spark, rows), queue, ["order", "tie"], ranges=2)
    enqueue(closing(jobs_of(spark, rows)), queue, ["order"], ranges=1)
    sizes, progress = run(spark, tmp_path, queue, most=5000, buckets=4)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert len(sizes) >= 4 and max(held) <= 32 and results(spark, tmp_path) == wanted(rows)


def test_segments_are_cut_in_files(spark, tmp_path):
    """A part of a long segment is read without the jobs before it."""
    queue = str(tmp_path / "in")
    enqueue(jobs_of(spark, [(1, i, 0, float(i)) for i in range(1500)]), queue, ["order"], ranges=1, file_jobs=1)
    reader = _QueueReader({"path": queue})
    names, ends = reader._files()
    assert ends == list(range(1501))
    assert [x["order"] for p in reader.partitions({"jobs": 990}, {"jobs": 1010}) for b in reader.read(p) for x in b.to_pylist()] == list(range(990, 1010))


def test_idle_keys_are_forgotten(spark, tmp_path):
    rows = [(1, DAY + i * SECOND, 0, 1.0) for i in range(5)] + [(2, DAY + i * 30 * SECOND, 0, 1.0) for i in range(21)] + [(1, DAY + 600 * SECOND, 0, 1.0)]
    queue = str(tmp_path / "in")
    for lo, hi in ((0, 200), (200, 500), (500, 700)):
        enqueue(jobs_of(spark, [r for r in rows if lo <= (r[1] - DAY) // SECOND < hi]), queue, ["order"], ranges=1)
        run(spark, tmp_path, queue, idle="100 seconds", delay="1 second")
    enqueue(closing(jobs_of(spark, rows)), queue, ["order"], ranges=1)
    run(spark, tmp_path, queue, idle="100 seconds", delay="1 second")
    got = sorted((r.key, r.seq) for r in spark.read.schema(OUT).parquet(str(tmp_path / "q-out")).collect())
    assert got == sorted([(1, i) for i in range(5)] + [(1, 0)] + [(2, i) for i in range(21)])


def test_queue_offsets(spark, tmp_path):
    """Any range of offsets gives the same jobs whatever is put behind it; batches are bounded; a restart sets the place."""
    queue = str(tmp_path / "in")
    rows = [(i % 3, i, 0, float(i)) for i in range(100)]
    assert enqueue(jobs_of(spark, rows[:60]), queue, ["order"], ranges=4, write_id="one")
    assert not enqueue(jobs_of(spark, rows[:60]), queue, ["order"], ranges=4, write_id="one")
    reader = _QueueReader({"path": queue, "maxjobs": "25", "splitjobs": "7"})
    assert reader.initialOffset() == {"jobs": 0} and reader.latestOffset() == {"jobs": 25}
    taken = lambda a, b: [x["order"] for p in reader.partitions({"jobs": a}, {"jobs": b}) for batch in reader.read(p) for x in batch.to_pylist()]
    assert taken(0, 25) == list(range(25)) and reader.latestOffset() == {"jobs": 50}
    assert all(p.stop - p.first <= 7 for p in reader.partitions({"jobs": 25}, {"jobs": 50}))
    again = _QueueReader({"path": queue, "maxjobs": "25"})
    assert again.partitions({"jobs": 50}, {"jobs": 50}) == [] and again.latestOffset() == {"jobs": 60}
    enqueue(jobs_of(spark, rows[60:]), queue, ["order"], ranges=2)
    assert taken(50, 75) == list(range(50, 75)) and taken(0, 100) == list(range(100)) and again.latestOffset() == {"jobs": 75}
    assert [len(m["files"]) > 0 for m in Manifests(Storage(queue)).commits()] == [True, True]
    assert json.loads(json.dumps(again.latestOffset())) == {"jobs": 75}


def test_an_empty_queue(spark, tmp_path):
    with pytest.raises(Exception, match="nothing was ever put"):
        read_queue(spark, str(tmp_path / "none"))
    enqueue(jobs_of(spark, [(1, 1, 0, 1.0)]).where("false"), str(tmp_path / "in"), ["order"])
    assert run(spark, tmp_path, str(tmp_path / "in"))[0] == []

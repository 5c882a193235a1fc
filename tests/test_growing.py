import random

import pytest
from pyspark.sql import functions as F

from rangeloom.operators import phaselog
from rangeloom.operators.growing import GrowingPairs, RankDirectory
from rangeloom.operators.records import with_row_index


def rows(spark, n, seed, low=0, high=1000):
    r = random.Random(seed)
    return spark.createDataFrame([(r.choice([None, *range(low, high)]) if low == 0 else r.randrange(low, high), f"{seed}-{i}", float(i)) for i in range(n)], "a long, b string, x double").repartition(3)


def test_added_batches_give_the_index_of_all(spark, tmp_path):
    d = RankDirectory(spark, str(tmp_path / "d"), ["a", "b"], range_rows=40)
    whole = None
    for i, n in enumerate([70, 0, 1, 300, 33]):
        batch = rows(spark, n, i)
        assert d.add(batch, f"batch-{i}") and not d.add(batch, f"batch-{i}")
        whole = batch if whole is None else whole.unionByName(batch)
        got = sorted((r.a is not None, r.a or 0, r.b, r.x, r.idx) for r in d.index().collect())
        want = sorted((r.a is not None, r.a or 0, r.b, r.x, r.idx) for r in with_row_index(whole, ["a", "b"]).collect())
        assert got == want and d.index().columns == ["a", "b", "x", "idx"]
    sizes = [r["rows"] for r in d.ranges()]
    assert sum(sizes) == 404 and len(sizes) >= 5 and max(sizes) <= 80


def test_ranges_without_new_rows_are_not_written(spark, tmp_path):
    d = RankDirectory(spark, str(tmp_path / "d"), ["a", "b"], range_rows=50)
    d.add(rows(spark, 400, 1))
    before = d.ranges()
    d.add(rows(spark, 5, 2, 990, 1000))
    after = d.ranges()
    assert len(before) >= 4 and before[:-1] == after[:-1] and before[-1]["folder"] != after[-1]["folder"]
    assert after[-1]["rows"] == before[-1]["rows"] + 5


def test_an_equal_key_is_one_range(spark, tmp_path):
    d = RankDirectory(spark, str(tmp_path / "d"), ["a"], range_rows=10)
    for i in range(2):
        d.add(spark.createDataFrame([(7, i)] * 60, "a long, b long"))
    assert sorted(r.idx for r in d.index().collect()) == list(range(120))


def test_nothing_added(spark, tmp_path):
    d = RankDirectory(spark, str(tmp_path / "d"), ["a", "b"])
    with pytest.raises(ValueError):
        d.index()
    d.add(rows(spark, 0, 0))
    assert d.index().collect() == [] and d.add(rows(spark, 3, 1)) and d.index().count() == 3


def log_lines(n=400, seed=4):
    """Lines of five sources, one null and one with a third of all lines; some sources have far more of one phase."""
    r = random.Random(seed)
    return [(r.choice([0, 0, 0, 1, 2, 3, None]), r.choice(["MAP", "SHUFFLE", "SORT"] if i % 3 else ["MAP"]), float(i), i) for i in range(n)]


@pytest.mark.parametrize("cuts", [[400], [1, 2, 200, 200, 399, 400], [100, 250, 400]])
def test_any_cut_of_a_log(spark, tmp_path, cuts):
    lines = log_lines()
    frame = lambda x: spark.createDataFrame(x, "source long, phase string, value double, line_no long").repartition(3)
    p = GrowingPairs(spark, str(tmp_path / "p"))
    given = []
    for i, (lo, hi) in enumerate(zip([0, *cuts], cuts)):
        got = [tuple(r) for r in p.add(frame(lines[lo:hi]), str(i)).collect()]
        assert sorted(map(tuple, p.add(frame(lines[lo:hi]), str(i)).collect()), key=repr) == sorted(got, key=repr)
        given += got
    want = sorted((tuple(r) for r in phaselog.pair_phases(frame(lines)).select("source", "k", "map", "shuffle").collect()), key=repr)
    assert sorted(given, key=repr) == want == sorted(map(tuple, p.pairs().collect()), key=repr)


def test_kept_between_batches(spark, tmp_path):
    """The lines that wait and two counters a source: nothing of the lines that were paired."""
    p = GrowingPairs(spark, str(tmp_path / "p"))
    for b in range(3):
        lines = [(s, phase, 1.0, i) for s in range(4) for i, phase in enumerate(["MAP", "SHUFFLE"] * 20 + ["MAP"])]
        p.add(spark.createDataFrame(lines, "source long, phase string, value double, line_no long"), str(b))
        about = p.manifests.commits()[-1]["about"]
        assert p._read(p._COUNTS, about["counts"]).count() == 8 and p._read(p._LINES, about["waiting"]).count() == 4 * (b + 1)
    assert p.pairs().agg(F.count("*")).first()[0] == 4 * 60

import random

import pytest
from pyspark.sql import functions as F

from rangeloom.operators import jobspec, phaselog, transfer, tuning
from rangeloom.sources.text import read_jobs, read_phase_log


def test_read_jobs(spark, tmp_path):
    (tmp_path / "jobs").write_text("TeraSort -1 6 2 ./in  \n\nCodedTeraSort   15 6 2 x\nbad line\n")
    got = [tuple(r) for r in read_jobs(spark, str(tmp_path / "jobs")).collect()]
    assert got == [("TeraSort", -1, 6, 2, "./in"), ("CodedTeraSort", 15, 6, 2, "x")]
    rejected = read_jobs(spark, str(tmp_path / "jobs"), rejects=True).where("rejected is not null").collect()
    assert [tuple(r) for r in rejected] == [(None,) * 5 + ("bad line",)]


def test_phase_log_files(spark, tmp_path):
    lines = [f"{'MAP' if i % 2 == 0 else 'SHUFFLE'} {i}.5" for i in range(2000)]
    (tmp_path / "one.txt").write_bytes("\r\n".join(["note 1", *lines]).encode())
    (tmp_path / "two.txt").write_text("MAP 1\nMAP 2\nSHUFFLE 4\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        log = read_phase_log(spark, str(tmp_path))
        rows = log.where("source = 'one.txt'").orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.line_no, r.value) for r in rows] == [(i + 1, i + 0.5) for i in range(2000)]
    pairs = phaselog.pair_phases(log).where("source = 'two.txt'").collect()
    assert [(r.k, r.map, r.shuffle) for r in pairs] == [(0, 5e6, 4.0)]
    total = phaselog.total_time(phaselog.pair_phases(log)).where("source = 'one.txt'").first().total
    assert total == sum(5e6 * (i + 0.5) if i % 2 == 0 else i + 0.5 for i in range(2000))


def test_logs_share_files(spark, tmp_path, monkeypatch):
    """The logs of many users, one without a number, in a few files that are read in many ranges."""
    from rangeloom.jobs import catalog

    kinds = ("click", "purchase", "view", None)
    events = [(i, i // 7, None if i % 60 == 59 else i % 60, kinds[i * i // 3 % 4]) for i in range(6000)]
    spark.createDataFrame(events, "event_id long, t long, user_id long, event_type string").selectExpr("*", "timestamp_seconds(t) AS ts", "0D AS value").repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(catalog, "new_path", lambda spark, name: str(tmp_path / name))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = catalog.phase_log_files(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert 1 <= len(list((tmp_path / "phase-log").rglob("part-*"))) <= 4
    seen, want = {}, []
    for e, _, user, kind in events:
        seen[user] = seen.get(user, -1) + 1
        if kind in ("click", "purchase"):
            want.append((user, seen[user], "MAP" if kind == "click" else "SHUFFLE", float(e)))
    assert sorted(map(tuple, got), key=lambda r: r[3]) == want


def test_ratios(spark):
    pairs = spark.createDataFrame([("a", 0, 4.0, 2.0), ("a", 1, 3.0, 0.0), ("a", 2, 1.0, 2.0), ("b", 0, 0.0, 1.0)], "source string, k int, map double, shuffle double")
    got = phaselog.phase_ratios(pairs).orderBy("source", "k").collect()
    assert [r.map_over_shuffle for r in got] == [2.0, None, 0.5, 0.0] and [r.shuffle_over_map for r in got] == [0.5, 0.0, 2.0, None]
    stats = {r.source: (r.n, r.mean_ratio, r.var_ratio) for r in phaselog.ratio_stats(pairs).collect()}
    assert stats["a"] == (2, 1.25, 1.125) and stats["b"] == (1, 0.0, None)


def test_published_comparison(spark):
    """Published totals and the changes that follow from them (public results, fixed values)."""
    totals = [("uniform", "plain", 4669495.685), ("uniform", "fixed", 2910585.020), ("uniform", "tuned", 2038825.0), ("pareto", "plain", 2898367.315), ("pareto", "fixed", 2439630.280), ("pareto", "tuned", 1637348.660)]
    df = spark.createDataFrame(totals, "distribution string, scheme string, total double")
    got = {(r.distribution, r.baseline): round(100 * r.change, 1) for r in phaselog.compare_schemes(df, "tuned", ["plain", "fixed"]).collect()}
    assert got == {("uniform", "plain"): -56.3, ("uniform", "fixed"): -30.0, ("pareto", "plain"): -43.5, ("pareto", "fixed"): -32.9}


def test_phase_summary(spark):
    df = spark.createDataFrame([(1, "MAP", 2.0), (1, "MAP", 4.0), (1, "SORT", 1.0)], "job int, phase string, seconds double")
    assert {tuple(r) for r in phaselog.phase_summary(df).collect()} == {(1, "MAP", 3.0, 4.0), (1, "SORT", 1.0, 1.0)}


def test_job_text(spark):
    df = spark.createDataFrame([(3, jobspec.TYPES[0], -1, 6, 2, "a/b")], "master_id int, type string, input_file_num int, reducer_num int, r int, prefix string")
    text = jobspec.format_job(df).first().job
    assert text == f"3:{jobspec.TYPES[0]}:-1:6:2:a/b"
    rows = spark.createDataFrame([(text,), ("1:2:3:4:5",), (text + ":7",), ("x:t:1:2:3:p",), (None,)], "t string")
    got = jobspec.parse_job(rows, "t").collect()
    assert [r.job_ok for r in got] == [True, False, False, False, False] and got[0].prefix == "a/b" and got[3].r is None


def test_validate_jobs(spark):
    rows = [(jobspec.TYPES[0], 0), (jobspec.TYPES[1], 1), (jobspec.TYPES[1], 5), (jobspec.TYPES[0], 6), ("other", 2), (None, 2), (jobspec.TYPES[0], None)]
    got = [r.error for r in jobspec.validate_jobs(spark.createDataFrame(rows, "type string, r int"), 6).collect()]
    assert got == ["r out of range", None, None, "r out of range", "unknown type", "unknown type", "r out of range"]


def simulate(costs, r0, max_r, interval=10):
    """The controller in plain Python: r used by each job."""
    r, used, trials = r0, [], []
    for i, c in enumerate(costs):
        slot = i % (interval + 4)
        used.append(r if slot < interval else min(max_r, r + 1) if (slot - interval) % 2 == 0 else max(1, r - 1))
        if slot >= interval:
            trials.append(c)
        if slot == interval + 3:
            a1, b1, a2, b2 = trials
            r = max(1, min(max_r, r + (1 if a1 < b1 and a2 < b2 else -1 if b1 < a1 and b2 < a2 else 0)))
            trials = []
    return used


def outcome_rows(seed=0):
    g = random.Random(seed)
    rows = []
    for key, n in enumerate([0, 13, 14, 28, 141, 500]):
        lean = g.choice([-0.3, 0.0, 0.4])
        for i in range(n):
            slot = i % 14
            c = g.choice([1.0, 2.0, 3.0]) - (lean if slot in (10, 12) else 0)
            rows.append((key, i * 7, c))
    return rows


@pytest.mark.parametrize("max_r,block", [(5, 4096), (2, 3), (1, 2)])
def test_trajectory(spark, max_r, block):
    rows = outcome_rows()
    df = spark.createDataFrame(rows, "key long, at long, cost double").repartition(3)
    slots = tuning.cycle_slots(df, "key", ["at"])
    path = tuning.r_trajectory(tuning.trial_decisions(slots, "key"), "key", 1, max_r, block=block)
    got = {(r.key, r.at): r.r_used for r in tuning.assign_r(slots, path, "key", 1, max_r).collect()}
    want = {}
    for key in {k for k, _, _ in rows}:
        own = [(at, c) for k, at, c in rows if k == key]
        want |= {(key, at): u for (at, _), u in zip(own, simulate([c for _, c in own], 1, max_r), strict=True)}
    assert got == want


def test_cost_and_arms(spark):
    r = spark.createDataFrame([(1, 0.5, 2.0), (5, 0.0, 1.0)], "r int, comp double, net double").select(tuning.cost(F.col("comp"), F.col("net")).alias("c"), *(x.alias(n) for n, x in zip("ab", tuning.arms(F.col("r"), 5), strict=True))).collect()
    assert [tuple(x) for x in r] == [(2500002.0, 2, 1), (1.0, 5, 4)]


def test_bandwidth(spark):
    from math import log

    b = spark.createDataFrame([(0, 0.5), (1, 0.25), (2, 0.9)], "bucket long, u double")
    p = transfer.Bandwidth(low=1, high=10, base=100, rate=0.5, scale=8, shape=2)
    get = lambda d: [(r.rate, r.broadcast) for r in transfer.bandwidth_series(b, d, p).orderBy("bucket").collect()]
    assert get("uniform") == [(1, 1), (10, 10), (1, 1)]
    assert [r for r, _ in get("exponential")] == pytest.approx([100 - log(0.5) / 0.5, 100 - 10 * log(0.75) / 0.5, 100 - 10 * log(0.1) / 0.5])
    assert get("pareto")[1] == pytest.approx((16, 96))
    with pytest.raises(ValueError):
        transfer.bandwidth_series(b, "normal")


def test_rates_and_costs(spark):
    series = spark.createDataFrame([(0, 10.0), (1, 20.0)], "bucket long, rate double")
    moves = spark.createDataFrame([(0, 1, 100, 5), (0, 1, 100, 15), (1, 0, 50, 19)], "src int, dst int, bytes long, t long")
    got = {(r.src, r.dst): (r.bytes, r.seconds) for r in transfer.transfer_cost(transfer.rate_at(moves, series, 10)).collect()}
    assert got == {(0, 1): (200, 15.0), (1, 0): (50, 2.5)}
    uneven = spark.createDataFrame([(1, 3, 7.0), (1, 10, 8.0)], "k int, valid_from long, rate double")
    at = spark.createDataFrame([(1, 2), (1, 3), (1, 9), (1, 10), (2, 5)], "k int, t long")
    assert {(r.k, r.t): r.rate for r in transfer.rate_as_of(at, uneven, "k").collect()} == {(1, 2): None, (1, 3): 7.0, (1, 9): 7.0, (1, 10): 8.0, (2, 5): None}


@pytest.mark.parametrize("block", [2, 5, 256])
def test_trajectory_in_levels(spark, block):
    r = random.Random(5)
    moves = {k: [r.choice([-1, 0, 1, 1]) for _ in range(n)] for k, n in [(1, 90), (2, 1), (3, 4), (4, 32)]}
    rows = [(k, c, d) for k, ds in moves.items() for c, d in enumerate(ds)]
    got = tuning.r_trajectory(spark.createDataFrame(rows, "key long, cycle int, decision int"), "key", 2, 5, block=block)
    want = set()
    for k, ds in moves.items():
        at = 2
        for c, d in enumerate([*ds, 0]):
            want.add((k, c, at))
            at = min(max(at + d, 1), 5)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
    assert not tuning.r_trajectory(spark.createDataFrame([], "key long, cycle int, decision int"), "key", 2, 5, block=block).collect()

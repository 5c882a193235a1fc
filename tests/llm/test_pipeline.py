import re
from collections import defaultdict

import pytest

import corpus_pipeline
from rangeloom.llm import bpe, mixing, quality
from tests.llm.test_neardup import shingles
from tests.llm.test_quality import brute as base_rules


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Rows after each stage, by stage."""
    from rangeloom.shared import stored

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"documents": docs}
    for name, f in corpus_pipeline.STAGES:
        docs = stored(f(spark, docs, sf), name.replace(" ", "-"))
        out[name] = docs
    return {k: v.collect() for k, v in out.items()}, {k: v.columns for k, v in out.items()}


def test_names_and_columns(stages):
    _, columns = stages
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "exact dedup", "near dedup", "source mix", "tokens"]
    assert all(columns[n] == columns["documents"] for n in names[:-1])


def test_quality(stages):
    rows, _ = stages
    kept = {r.doc_id for r in rows["quality rules"]}
    for r in rows["documents"]:
        assert not (base_rules(r.text)[-1] and r.doc_id in kept)
    assert len(kept) > 0.5 * len(rows["documents"])


def test_exact(stages):
    rows, _ = stages
    groups = defaultdict(list)
    for r in rows["quality rules"]:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text)].append(r)
    want = {min(g, key=lambda r: (-len(r.text), r.doc_id)).doc_id for g in groups.values()}
    assert sorted(r.doc_id for r in rows["exact dedup"]) == sorted(want)


def test_near(stages):
    rows, _ = stages
    sets = {r.doc_id: shingles(r.text, 5) for r in rows["exact dedup"]}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in rows["near dedup"]) == [i for i in ids if root(i) == i]


def test_mix(spark, stages):
    rows, _ = stages
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    before, after = defaultdict(int), defaultdict(int)
    per_doc = defaultdict(int)
    for r in rows["near dedup"]:
        before[r.source] += count(r.text)
    for r in rows["source mix"]:
        after[r.source] += count(r.text)
        per_doc[r.doc_id] += count(r.text)
    targets = mixing.targets(spark.createDataFrame(list(before.items()), "source string, size long")).collect()
    assert all(abs(after[t.source] - t.target) <= 1 for t in targets)
    sizes = {r.doc_id: count(r.text) for r in rows["near dedup"]}
    assert all(n <= 3 * sizes[i] for i, n in per_doc.items())


def test_tokens(stages):
    tokenizers = pytest.importorskip("tokenizers")
    rows, _ = stages
    lib = tokenizers.Tokenizer.from_file(bpe.vocabulary())
    want = sorted((r.doc_id, lib.encode(r.text, add_special_tokens=False).ids) for r in rows["source mix"])
    assert sorted((r.doc_id, list(r.ids)) for r in rows["tokens"]) == want


def test_run_is_the_stages(spark, sf, stages):
    rows, _ = stages
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in got) == sorted((r.doc_id, list(r.ids)) for r in rows["tokens"])


def test_run_removes_its_tables(spark, sf):
    """Of a run only the mix, which the last stage reads, and the digest index's catalog entries are left."""
    import os

    from rangeloom.shared import shared_dir

    before = set(os.listdir(shared_dir(spark)))
    corpus_pipeline.run(spark, sf).count()
    assert [x.rpartition("-")[0] for x in set(os.listdir(shared_dir(spark))) - before] == ["source-mix"]


def test_stages_on_odd_rows(spark, odd, odd_rows):
    """Nulls, empty and long texts, ties, repeated rows, several texts of one id and a null id, with clashing columns."""
    long = " ".join(f"w{i}" for i in range(400))
    extra = [(20, long, "en", "s1", 9, True, "y"), (20, long + " end", "en", "s1", 9, True, "y"), (21, long + "\n", "en", None, 9, True, "y"), (None, long, "en", "s1", 9, True, "y"), (None, None, None, None, None, None, None)]
    docs = odd.unionByName(spark.createDataFrame(extra, odd.schema))
    rows = [*odd_rows, *extra]
    stage = dict(corpus_pipeline.STAGES)
    run = lambda name: stage[name](spark, docs, "")
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert run(name).columns == docs.columns

    kept = run("quality rules").collect()
    assert len(kept) == sum(quality.measurer()(r[1]).kept for r in rows) > 0

    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[plain(r[1])].append(r)
    want = [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]
    got = run("exact dedup").collect()
    assert sorted((r.doc_id, plain(r.text)) for r in got) == sorted((r[0], plain(r[1])) for r in want)

    stays = [r.doc_id for r in run("near dedup").collect()]
    assert 21 not in stays and stays.count(20) == 2 and stays.count(None) == 2
    assert {7, 9} <= set(stays) and not {8, 10, 12} & set(stays)

    mix = run("source mix").collect()
    assert mix and all((r.text or "").split() and r.n_chars == len(r.text) for r in mix) and not {1, 2, 3} & {r.doc_id for r in mix}

    made = run("tokens").collect()
    assert len(made) == len(rows) and all((r.n_tokens == 0) == (not r.ids) for r in made)
    assert sum(r.n_tokens == 0 for r in made) == sum(not r[1] for r in rows)


def test_stages_on_an_empty_table(spark, empty):
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty, "").collect() == [], name

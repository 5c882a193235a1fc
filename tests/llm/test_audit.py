from itertools import permutations

import pytest

from rangeloom.llm import audit

LABELS = [(1, 1, 0), (2, 0, 1), (4, 1, 1), (6, 1, None), (6, 0, 1), (12, None, 1), (99, 1, 1), (None, 1, 1)]
WHITE = " \t\n\x0b\x0c\r"


def failing(rows):
    """``(part, set of letters)`` of each ``(doc_id, text, ..., source)`` row."""
    out, first = [], {}
    for i, text, part in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, text, part in rows:
        text = text or ""
        for w in WHITE:
            words = text.replace(w, " ") if w == WHITE[0] else words.replace(w, " ")
        words = [w for w in words.split(" ") if w]
        own = {"A"} if len(words) < 200 else set()
        own |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        own |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text) else set()
        own |= {"D"} if set(text) & set("#$%&*|") else set()
        if text in first and (i is None or i > first[text]):
            own.add("E")
        out.append((i, part or "", own))
    return out


def brute(rows, labels):
    good, bad = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    failed, out = failing(rows), []
    for part in sorted({p for _, p, _ in failed}):
        own, removed = [(i, f) for i, p, f in failed if p == part], {}
        lines = []
        for order in map("".join, permutations("ABCDE")):
            left = list(own)
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                removed[x] = removed.get(x, 0) + len(gone)
                lines.append((part, order, step, len(left), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == {x} for _, f in own), sum(i in good for i, _ in gone), sum(i in bad for i, _ in gone), x))
        out += [(*line[:-1], removed[line[-1]]) for line in lines]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    out = audit.audited(docs, labels)
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()))


def test_query_equals_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = c.sql(audit.OP11_SQL).select(*COLUMNS).fetchall()
    assert sorted(map(tuple, audit.op11_refined_audit(spark, sf).select(*COLUMNS).collect())) == sorted(want)


def test_odd_rows(spark, odd, odd_rows):
    """Null and empty texts, null parts, a very long text, repeated rows, clashing columns; labels that repeat, lack a value or a document."""
    assert audited(spark, odd) == brute([(r[0], r[1], r[3]) for r in odd_rows], LABELS)


def test_null_ids(spark):
    rows = [(None, "a b", "s"), (5, "a b", "s"), (None, "c", "s"), (None, "c", None), (5, "a b", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert audited(spark, docs) == brute(rows, LABELS)


def test_empty(spark, empty):
    assert audited(spark, empty) == []


def texts_of_one_length():
    """Copies, and texts that part only in their first, a middle or their last block."""
    base = "".join(chr(97 + i * 7 % 26) for i in range(1500))
    change = lambda at: base[:at] + "é" + base[at + 1 :]
    texts = [base, change(0), change(63), change(64), change(700), change(1499), base, change(1499), change(700), base, "", "", base[:64], base[:64], base[:63], base[:192], base[:193], base[:192]]
    return [(i, t, f"s{i % 2}") for i, t in enumerate(texts)] + [(3, change(64), "s0")]


@pytest.mark.parametrize("bits", [64, 1])
def test_duplicates_part_at_any_block(spark, bits):
    """With hashes of one bit classes hold different texts, which the comparison of full texts must part."""
    rows = texts_of_one_length()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r.doc_id, r.part, {x for i, x in enumerate("ABCDE") if r.mask >> i & 1}) for r in audit.failures(docs, bits=bits).collect()]
    assert sorted(got, key=repr) == sorted(failing(rows), key=repr)


def test_singletons_leave(spark):
    """What is refined is classes of copies alone."""
    docs = spark.createDataFrame(texts_of_one_length(), "doc_id long, text string, source string")
    rows = audit._texts(docs, "doc_id", "text", "source", 64)
    got = {(r.length, r.first) for r in audit.refined(rows).collect()}
    assert got == {(1500, 0), (1500, 5), (1500, 4), (1500, 3), (0, 10), (64, 12), (192, 15)}

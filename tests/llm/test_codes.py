import hashlib
import math
import random

import numpy as np
import pytest

from rangeloom.llm import codes
from rangeloom.llm.codes import CodeSpec


def brute(rows, spec=CodeSpec()):
    """Plain integers of Python throughout; ``rows`` are ``(vec_id, vector, label)``."""
    kept = [(i, [math.floor(spec.scale * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    w = len(kept[0][1]) // spec.parts
    cut = lambda q, p: q[p * w : (p + 1) * w]
    books = [[cut(q, p) for _, q, _ in kept[: spec.entries]] for p in range(spec.parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(spec.rounds):
        new = []
        for p, book in enumerate(books):
            own = [[] for _ in book]
            for _, q, _ in kept:
                own[best(cut(q, p), book)[1]].append(cut(q, p))
            new.append([[sum(c) // len(xs) for c in zip(*xs, strict=True)] if xs else old for xs, old in zip(own, book, strict=True)])
        books = new
    out, by = [], {}
    for i, q, y in kept:
        found = [best(cut(q, p), books[p]) for p in range(spec.parts)]
        error = sum(d for d, _ in found)
        by[y] = by.get(y, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, y))
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, code, e, by[y], digest) for i, code, e, y in out), key=repr)


def compressed(spark, rows, spec=CodeSpec()):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, q string, code string")
    out = codes.compressed(df, spec=spec).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted(map(tuple, out.collect()), key=repr)


def vectors(n, d, seed=3, coarse=False):
    r = random.Random(seed)
    one = lambda: float(np.float32(r.choice([-0.5, 0.25, 1.0]) if coarse else r.gauss(0, 0.2)))
    return [(i, [one() for _ in range(d)], r.choice([None, 0, 1, 2])) for i in range(n)]


def test_query_equals_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = c.sql(codes.OP13_SQL)
    got = codes.op13_screened_codes(spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("coarse", [False, True])
def test_equals_brute_force(spark, coarse):
    """With coarse values most distances are ties."""
    rows = vectors(150, 16, coarse=coarse)
    assert compressed(spark, [(*r, "x", "y") for r in rows]) == brute(rows)


def test_odd_rows(spark):
    """Null, empty components, infinities, repeated rows, null ids; columns that clash with those of the result."""
    rows = vectors(40, 8)
    rows += [(41, None, 1), (42, [None] + [0.0] * 7, 1), (43, [float("nan")] * 8, 0), (44, [float("inf")] + [0.0] * 7, 0), (44, [float("-inf")] + [0.0] * 7, 0), (3, rows[3][1], 2), (3, rows[3][1], 2), (None, [9.0] * 8, None), (-7, [-0.00001] * 8, None)]
    assert compressed(spark, [(*r, "x", "y") for r in rows]) == brute(rows)


def test_few_vectors_and_none(spark):
    rows = vectors(3, 8)
    assert compressed(spark, [(*r, "x", "y") for r in rows]) == brute(rows)
    assert compressed(spark, []) == []
    assert compressed(spark, [(1, None, 1, "x", "y")]) == []


@pytest.mark.parametrize("rows", [[(1, [1e9] * 8, 0)], [(1, [0.0] * 7, 0)], [(1, [0.0] * 8, 0), (2, [0.0] * 16, 0)]])
def test_vectors_that_are_refused(spark, rows):
    """Too large for 64 bits, not cut in equal parts, of several lengths: an error, never a wrong distance."""
    with pytest.raises(Exception, match="64 bits|equal parts|lengths"):
        compressed(spark, [(*r, "x", "y") for r in rows])


@pytest.mark.parametrize("top", [4, 3000, 1 << 26])
def test_screening_is_exact(top):
    """Against int64 alone: values where float32 cannot tell entries apart, and exact ties."""
    rng = np.random.default_rng(top)
    c = rng.integers(-top, top + 1, (16, 8))
    c[5], c[9] = c[2], c[2] + np.array([1, 0, 0, 0, 0, 0, 0, -1])
    x = np.concatenate([rng.integers(-top, top + 1, (400, 8)), c[rng.integers(0, 16, 200)] + rng.integers(-1, 2, (200, 8))])
    exact = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (codes.nearest(x, c) == exact.argmin(1)).all()

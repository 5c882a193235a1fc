import os
import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture(scope="session")
def corpus(spark, sf):
    """``{doc_id: text}`` of the small table."""
    return {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_words string"


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, white space, a very long text, ties, repeated rows; columns that clash with results."""
    r = random.Random(7)
    vocab = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 8))) for _ in range(400)]
    long = " ".join(r.choice(vocab) for _ in range(20000))
    near = [r.choice(vocab) for _ in range(120)]
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, long), (5, "one"), (6, "one"), (7, "one two"), (8, "ONE  two"), (9, " ".join(near)), (10, " ".join(near[:-2] + ["x", "y"])), (11, "a b \x1c c\n\nx\nx"), (12, "one two"), (12, "one two"), (13, "###" * 2000), (14, " ".join(near) + "\n" + " ".join(near))]
    return [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", len(t or ""), False, "x") for i, t in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def duck(sf):
    """Run DuckDB SQL over the small tables, or over ``documents`` given as rows."""
    import duckdb

    def run(sql, rows=None):
        c = duckdb.connect()
        for t in ("documents", "pages"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        if rows is not None:
            c.sql("CREATE OR REPLACE TABLE given (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
            if rows:
                c.executemany("INSERT INTO given VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
            c.sql("CREATE OR REPLACE VIEW documents AS SELECT * FROM given")
        got = c.sql(sql)
        return sorted((dict(zip(got.columns, r, strict=True)) for r in got.fetchall()), key=repr)

    return run

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["pid", "pos", "key_hex", "id"] and df.count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_llm_folder(tmp_path):
    """The rest imports where the subpackage, its tests and the pipeline have been removed."""
    shutil.copytree(f"{ROOT}/rangeloom", tmp_path / "rangeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'total_sort' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


@pytest.mark.parametrize("name", ["total_sort_skew", "coded_sort", "r_trajectory", "tune_stream_files", "load_report"])
@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_equal_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    c = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(e.oracle_sql()[name])
    df = e.queries()[name](spark, SF)
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(want.select(*(f'"{x}"' for x in cols)).fetchall())

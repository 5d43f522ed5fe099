"""Driver contract: every registered query runs on the smallest tables,
and where oracle SQL exists, DuckDB gives the same rows."""

import os
import sys

import duckdb
import pytest

from data_paths import SF001

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import rows_of  # noqa: E402
from normsmith.sources.tables import TABLES  # noqa: E402


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["exp", "n_raters", "n_stimuli", "icc2k"]
    assert df.count() >= 0


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_against_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert len(df.columns) > 0
        return
    res = duck.execute(sql)
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, rows) == rows_of(cols, res.fetchall())


def test_udf_queries_from_another_directory(tmp_path):
    """Python workers must not need the package on their path: run the
    UDF-backed queries in a fresh process whose working directory is not
    the repository."""
    import subprocess

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "import __spark_entry__ as E\n"
        "for n in ['icc2k_bounds', 'omega_total', 'paired_t_p', 'point_of_stability_arrow']:\n"
        "    print(n, E.queries()[n](spark, %r).count())\n"
    ) % (repo, SF001)
    out = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "omega_total 3" in out.stdout and "paired_t_p 1" in out.stdout

"""Every registered query with SQL against DuckDB on the smallest tables, and the driver's contract."""

import datetime
import glob
import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from quern.plans import suite

SMALL = "/root/testdata/sf0.001"
ORACLE = suite.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf":
        return f"{float(v):.12g}"
    return v.isoformat() if isinstance(v, (datetime.date, pd.Timestamp)) else str(v)


def rows(df):
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, duck, name):
    want = duck.execute(ORACLE[name]).df()
    got = suite.queries()[name](spark, SMALL).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_without_sql_run(spark):
    for name in suite.queries().keys() - ORACLE.keys():
        assert suite.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 6
    assert ORACLE.keys() <= __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_entry_without_the_training_data_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    os.symlink(os.path.join(root, "__spark_entry__.py"), tmp_path / "__spark_entry__.py")
    os.mkdir(tmp_path / "quern")
    for part in os.listdir(os.path.join(root, "quern")):
        if part != "llm":
            os.symlink(os.path.join(root, "quern", part), tmp_path / "quern" / part)
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-P", "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env=env)
    assert done.stdout.split() == [str(len(suite.queries())), "False"]

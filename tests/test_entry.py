"""The driver contract, and every oracle against its query on the smallest tables."""

import glob
import math
import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["lecture_id", "para_no", "start_s", "text", "suspect"] and df.count() > 0


def _rows(df):
    cell = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else repr(float(x)) if isinstance(x, float) else str(x)
    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).values.tolist()), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(DATA + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = entry.queries()[name](spark, DATA).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_imports_without_the_training_data_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "r")})
    n, some = out.stdout.split()
    assert int(n) >= 46 and some == "False"

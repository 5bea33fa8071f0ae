"""Every catalogue query against its SQL in DuckDB, and the import guard."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidewire.plans.catalogue import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
REPO = Path(__file__).resolve().parent.parent
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    plain = lambda v: "" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    return sorted(tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False))


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys() and len(QUERIES) > 50


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@needs_data
def test_keyset_bounds_reach_the_scan(spark):
    plan = QUERIES["poll_tie_page"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan


def test_the_rest_works_without_the_llm_folders(tmp_path):
    """The folders deleted in a copy: the entry imports and registers the rest, and the rest's tests are collected and work."""
    gone = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache")
    shutil.copytree(REPO, tmp_path / "repo", ignore=gone)
    code = "import __spark_entry__ as e; names = {*e.queries()}; assert names == {*e.oracle_sql()} and 'flagship' in names and 'pipeline' not in names and 'op1_packing' not in names"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "tests/test_keyring.py"], cwd=tmp_path / "repo", check=True, capture_output=True)
    found = subprocess.run([sys.executable, "-m", "pytest", "-q", "--collect-only", "tests"], cwd=tmp_path / "repo", check=True, capture_output=True, text=True).stdout
    assert "test_engine.py" in found and "tests/llm" not in found

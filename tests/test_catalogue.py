"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from graphloom.queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return f"{float(v):.9g}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted([plain(r[c]) for c in cols] for r in got.collect()) == sorted([plain(r[i]) for i in at] for r in want.fetchall())


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_llm(tmp_path, pipeline):
    """With the training-data folders deleted (and corpus_pipeline.py, or not) everything else is still registered."""
    away = shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "repo", ignore=away)
    code = "import __spark_entry__ as e, bench; q = e.queries(); assert 'blast_score' in q and set(e.oracle_sql()) <= set(q); assert not [n for n in q if n == 'pipeline' or n.startswith('op')]"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, check=True)


def test_entry_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

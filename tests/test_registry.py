"""Every registered query with SQL gives DuckDB's rows; the entry works without the corpus package."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from leafwork.plans import registry

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parent.parent

pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    return round(float(v), 9)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([plain(r[k]) for k in order] for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, str(SF))
    want = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_the_rest_runs(spark, name):
    assert registry.QUERIES[name](spark, str(SF)).count() > 0


def test_recovery_falls_with_the_cut(spark):
    got = {(r["mode"], r.form, r.cut): r for r in registry.QUERIES["recovery_curve"](spark, str(SF)).collect()}
    for mode in ("normal", "adversarial"):
        for form in ("canonical", "generation", "json"):
            curve = [got[mode, form, c].recovery for c in range(1, 10)]
            assert curve[0] < curve[4] < curve[8] and curve[-1] > 0.5
            assert {got[mode, form, c].documents for c in range(1, 10)} == {66}


def test_entry_without_the_corpus_package(tmp_path):
    for name in ("__spark_entry__.py", "leafwork"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "leafwork" / "llm", ignore_errors=True)
    script = "import __spark_entry__ as e; q = e.queries(); assert 'encode_flat_events' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", script], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})

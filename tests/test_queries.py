"""Every query with SQL gives DuckDB's rows on the small tables; the others run with a stable schema."""

import datetime
import glob
import json
import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
CORE = [n for n in QUERIES if n != "pipeline" and not (n.startswith("op") and n[2].isdigit())]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return f"{round(x, 5) + 0.0:.6g}"
    return str(x) if isinstance(x, datetime.datetime | bool) else x if isinstance(x, str) else f"{x:.6g}" if abs(x) < 1 << 50 and not isinstance(x, int) else str(int(x)) if not isinstance(x, int) else str(x)


def rows(names, table):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(cell(r[k]) for k in order) for r in table), key=str)


@pytest.mark.parametrize("name", [n for n in CORE if n in ORACLES])
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    a, b = rows(df.columns, df.collect()), rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            assert p == q or abs(float(p) - float(q)) <= 2e-5 * max(1.0, abs(float(q)))


@pytest.mark.parametrize("name", [n for n in CORE if n not in ORACLES])
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.columns == df.select("*").columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_subpackage(tmp_path):
    """The entry imports, and the other queries are there, in a copy without the llm folders; whether or not the pipeline's module is left."""
    top = Path(entry.__file__).resolve().parent
    for k, left_out in enumerate((("llm",), ("llm", "corpus_pipeline.py"))):
        copy = tmp_path / str(k)
        shutil.copytree(top, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *left_out))
        code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True).stdout
        assert json.loads(out.splitlines()[-1]) == [sorted(CORE), sorted(set(CORE) & set(ORACLES))]

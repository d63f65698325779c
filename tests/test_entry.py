"""The registered queries over the smallest data, against DuckDB where there is SQL."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in found.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_subpackage(tmp_path):
    """The entry imports where the training-data subpackage and the pipeline are gone."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys, os
for name in ("__spark_entry__.py", "tessera"):
    os.symlink(os.path.join({root!r}, name), os.path.join({str(tmp_path)!r}, name)) if name.endswith(".py") else None
import shutil
shutil.copytree(os.path.join({root!r}, "tessera"), os.path.join({str(tmp_path)!r}, "tessera"), ignore=lambda d, n: ["llm", "__pycache__"])
sys.path[:0] = [{str(tmp_path)!r}]
sys.path = [p for p in sys.path if os.path.abspath(p or ".") != {root!r}]
import importlib.util
shutil.copy(os.path.join({root!r}, "__spark_entry__.py"), os.path.join({str(tmp_path)!r}, "entry_alone.py"))
import entry_alone
assert entry_alone.queries() and not [q for q in entry_alone.queries() if q.startswith("op")]
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)

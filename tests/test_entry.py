"""The driver's contract: entry, queries with their SQL on the same tables, and independence of the llm subpackage."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from webloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    return repr(round(v, 9)) if isinstance(v, float) else repr(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else repr(v)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    rows = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name in registry.ORACLES:
        found = duck.sql(registry.ORACLES[name])
        assert sorted(found.columns) == sorted(df.columns)
        at = [found.columns.index(c) for c in sorted(df.columns)]
        assert sorted(rows) == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_imports_without_the_llm_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "webloom").mkdir()
    for name in os.listdir(f"{root}/webloom"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{root}/webloom/{name}", tmp_path / "webloom" / name)
    os.symlink(f"{root}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    code = "import __spark_entry__ as e; assert set(e.queries()) >= set(e.oracle_sql()) and 'pipeline' not in e.queries() and len(e.queries()) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})

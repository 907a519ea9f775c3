"""The driver's contract: every query against its SQL on the smallest tables, and the repository without the llm folders."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from sparkann.plans import queries as plans

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v.item() if hasattr(v, "item") else v


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    r = duck.execute(plans.SQL[name])
    names = [d[0] for d in r.description]
    want = sorted((tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=repr)
    assert sorted(names) == cols
    assert sorted((tuple(plain(row[c]) for c in cols) for row in got.collect()), key=repr) == want


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 100
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_llm_folders(tmp_path):
    """The rest imports and has its queries."""
    for p in ("sparkann", "__spark_entry__.py"):
        src = ROOT / p
        shutil.copytree(src, tmp_path / p, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path / p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'k9_knn_l2_top10' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)

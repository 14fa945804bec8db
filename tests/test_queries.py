"""Every registered query of the engine against its SQL, on the smallest tables; the others give sound rows."""

import os
from decimal import Decimal
from pathlib import Path

import duckdb
import numpy as np
import pytest

from strataframe import catalogue

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = DATA / f"{t}.parquet"
        con.sql(f"create view {t} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return None if v != v else repr(float(v))
    return str(v) if v is not None else None


@pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, str(DATA))
    want = duck.sql(catalogue.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a = sorted([tuple(plain(r[c]) for c in cols) for r in got.collect()], key=str)
    at = [want.columns.index(c) for c in cols]
    b = sorted([tuple(plain(r[i]) for i in at) for r in want.fetchall()], key=str)
    assert a == b


@pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    """Queries without SQL: rows with distinct keys and finite numbers."""
    got = catalogue.QUERIES[name](spark, str(DATA)).toPandas()
    assert name == "dark_features" or len(got)
    key = [c for c in ("row", "col", "label", "fold", "guard", "psid") if c in got.columns]
    assert not key or not got.duplicated(key).any()
    assert all(np.isfinite(got[c]).all() for c in got.select_dtypes("floating").columns if c != "variance")


def test_entry_imports_without_corpus_folder(tmp_path):
    """The entry module works when the corpus folders are gone."""
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "strataframe", tmp_path / "strataframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)

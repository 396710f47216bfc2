"""Every registered query against its DuckDB oracle on the small tables."""
from __future__ import annotations

import pytest
from conftest import SF_SMALL

from stockgrid.plans import catalog
from compare import compare, duck

NAMES = sorted(catalog.REGISTRY)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, SF_SMALL)
    assert r["status"] == "match", r


def test_every_query_has_oracle():
    assert set(catalog.oracle_sql()) == set(catalog.queries())


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0 and "Risk_Status" in df.columns
    assert set(catalog.queries()) <= set(e.oracle_sql()) <= set(e.queries())


def test_entry_imports_without_a_session():
    """The driver may import the contract before creating a session: no
    module may build Spark columns at import time."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); "
            "assert set(o) <= set(q); print(len(q))")
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.strip()) >= len(NAMES)

"""Every registered query against its DuckDB oracle SQL on the sf0.001
tables (the driver runs the same comparison at sf0.01)."""

import os

import duckdb
import pytest

from tests.conftest import SF_SMALL
from tools.oracle_check import TABLES, digest

import __spark_entry__ as E
from stockflow.plans.catalog import load_all

NAMES = sorted(load_all())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"create view {t} as select * from read_parquet('{p}')")
    return c


def test_every_query_has_oracle_sql():
    assert set(NAMES) <= set(E.oracle_sql()) and set(NAMES) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["product_id", "on_hand_qty", "reserved_qty", "free_qty", "open_lines", "shortage_lines"]
    assert df.count() > 0


def test_every_query_is_documented():
    from stockflow.plans.catalog import load_all
    missing = [n for n, q in load_all().items() if not q.doc.strip()]
    assert missing == []

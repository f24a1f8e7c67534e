"""Every query of the engine's own operators against its SQL."""

from __future__ import annotations

import math

import duckdb
import pytest

from duskveil.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FLOOR = 169  # queries; operators may be added, not lost


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    rows, sql = [tuple(r) for r in df.collect()], registry.oracle_sql().get(name)
    assert len(set(df.columns)) == len(df.columns)
    if not sql:
        assert rows
        return
    want = con.sql(sql)
    cols, other, found = sorted(df.columns), list(want.columns), want.fetchall()
    assert cols == sorted(other)
    made = sorted(str([plain(r[df.columns.index(c)]) for c in cols]) for r in rows)
    assert made == sorted(str([plain(r[other.index(c)]) for c in cols]) for r in found)


def test_floor():
    assert len(registry.queries()) >= FLOOR
    assert len(registry.oracle_sql()) >= FLOOR - 3

"""Registered queries against their SQL on the smallest tables."""

import math
import os

import pytest

from basinflow.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(rows):
    key = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(key(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(registry.SQL[name])
    assert columns == sorted(rel.columns)
    assert plain(df.select(*columns).collect()) == plain(rel.select(*columns).fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0

"""Every query of the catalogue against the same query as SQL on the same tables."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

from cairn import catalog

SF = os.environ.get("CATALOG_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents".split():
        path = f"{SF}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, sql, name):
    df = catalog.QUERIES[name](spark, SF)
    want = sql.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = Counter(tuple(r[c] for c in order) for r in df.collect())
    rows = Counter(tuple(row[columns.index(c)] for c in order) for row in want.fetchall())
    assert got == rows and rows


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)

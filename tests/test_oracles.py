"""Every registered imaging query against its SQL in DuckDB, over the small tables."""

import math

import duckdb
import pytest

from voxlake.plans import registry

SF = "/root/testdata/sf0.001"
registry.load()


def plain(value):
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, str | bytes):
        return value
    number = float(value)
    return "nan" if math.isnan(number) else round(number, 6) + 0.0


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, tables, name):
    found = registry.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    got = sorted((tuple(plain(row[c]) for c in columns) for row in found.collect()), key=str)
    cursor = tables.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(dict(zip(names, row))[c]) for c in columns) for row in cursor.fetchall()), key=str)
    assert got == expected
    assert got

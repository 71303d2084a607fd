import glob
import os

import duckdb
import pytest

from tessela import catalog


def cell(x):
    if x is None or x != x:
        return None
    try:
        return round(float(x), 6)
    except (TypeError, ValueError):
        return str(x)


def values(rows):
    return sorted((tuple(map(cell, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, data, name):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in con.description]
    expected = con.fetchall()
    df = catalog.queries()[name](spark, data)
    assert sorted(df.columns) == sorted(columns)
    assert values(df.select(*[f"`{c}`" for c in columns]).collect()) == values(expected)


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())

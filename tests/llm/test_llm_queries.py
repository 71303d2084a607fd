import glob
import os

import duckdb
import pytest

from tessela.llm import queries as llm


def values(rows):
    return sorted((tuple(str(round(float(x), 6)) if isinstance(x, (int, float)) else str(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_its_sql(spark, data, name):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    con.execute(llm.oracle_sql()[name])
    columns = [c[0] for c in con.description]
    expected = con.fetchall()
    df = llm.queries()[name](spark, data)
    assert sorted(df.columns) == sorted(columns)
    assert values(df.select(*columns).collect()) == values(expected)


@pytest.mark.parametrize(
    ("name", "columns"),
    [("p2_found", ["name_a", "name_b"]), ("p5_found", ["product_id_a", "product_id_b"]), ("p7_found", ["doc_id", "item_id"]), ("p8_found", ["source"]), ("p9_found", ["doc_id"])],
)
def test_columns_and_repeats(spark, data, name, columns):
    df = llm.queries()[name](spark, data)
    assert df.columns == columns
    rows = [tuple(r) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))

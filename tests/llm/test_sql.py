"""The corpus queries that SQL can express, against DuckDB on whole tables."""

import duckdb
import pytest

from weir.llm import queries

from ..test_oracles import TABLES, rows_of


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    d = sf.replace("sf0.001", "sf0.01")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    cur = c.execute(queries.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    want = rows_of(names, cur.fetchall())
    df = queries.queries()[name](spark, d)
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want

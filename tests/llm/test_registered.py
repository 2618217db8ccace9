"""The registered corpus queries: names, and the DuckDB forms where SQL can express them."""

import duckdb
import pytest

import __spark_entry__ as entry
from drainrules.llm import queries

SF01 = "/root/testdata/sf0.01"


def test_names():
    found = entry.queries()
    assert "pipeline" in found and set(queries.QUERIES) <= set(found)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF01)
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want.fetchall())

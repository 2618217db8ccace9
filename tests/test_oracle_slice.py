"""A slice of the Spark-vs-DuckDB comparison at sf0.001 (the full run is tools/check_oracle.py)."""

import math

import duckdb
import pytest

import __spark_entry__ as se

from conftest import SF001

KEYS = ["filter_android", "pair_samples", "asof_registration", "feature_bins", "transactions",
        "pruned_rules", "rule_labels", "app_counts_by_name"]


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in rows:
        out.append(tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["part", "lineitem", "events"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = se.queries()[key](spark, SF001)
    got = _norm([tuple(r) for r in df.collect()], df.columns)
    rel = con.execute(se.oracle_sql()[key])
    cols = [d[0] for d in rel.description]
    want = _norm(rel.fetchall(), cols)
    assert sorted(df.columns) == sorted(cols)
    assert got == want

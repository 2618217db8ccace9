"""Driver contract: entry runs, every query of the inventory has an oracle."""

import __spark_entry__ as se
from drainrules.plans import catalog


def test_entry_runs(spark):
    df = se.entry(spark)
    assert set(df.columns) == {"antecedent", "consequent", "confidence", "n_antecedent"}
    assert df.count() > 0


def test_every_query_of_the_inventory_has_an_oracle():
    q, o = se.queries(), se.oracle_sql()
    assert set(catalog.QUERIES) <= set(q) and set(catalog.QUERIES) <= set(o) <= set(q)
    assert len(catalog.QUERIES) == 52

"""Driver contract: entry smoke run, registry and oracle keys agree."""

import __spark_entry__ as se


def test_entry_runs(spark):
    df = se.entry(spark)
    assert df.count() > 0
    assert "item_no" in df.columns


def test_registry_consistent():
    qs, sqls = se.queries(), se.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 50

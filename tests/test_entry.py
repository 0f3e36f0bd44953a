"""Driver contract: entry runs, every oracle key is a registered query."""

import __spark_entry__ as E


def test_entry_runs_on_smoke_data(spark):
    df = E.entry(spark)
    assert "PM2_5_lag_24h" in df.columns
    assert df.count() >= 0


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 60

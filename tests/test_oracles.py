"""Every registered query against its DuckDB oracle on the sf0.001 tables
(row count, column names and order-insensitive values)."""
import pytest

import __spark_entry__ as entry_mod
from conftest import SF_SMALL
from vacanta.plans import catalog
from vacanta.plans.compare import compare

QUERIES = catalog.queries()
ORACLES = catalog.oracle_sql()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF_SMALL)
    if key not in ORACLES:
        assert df.count() >= 0
        return
    r = compare(df, duck, ORACLES[key])
    assert r["match"], r


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["n_segments"] == 18

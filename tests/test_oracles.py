"""Every query with SQL text agrees with DuckDB; the driver contract holds."""

import pytest
from compare import SMALL

from foreslate.catalog import REGISTRY

WITH_SQL = [k for k, q in REGISTRY.items() if q.sql is not None]


@pytest.mark.parametrize("key", WITH_SQL)
def test_query_matches_sql(key, spark, con):
    from compare import compare

    assert compare(REGISTRY[key], spark, con, SMALL) is None


def test_driver_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).limit(1).count() == 1


def test_every_inventory_row_has_a_query():
    sizes = {"s": 15, "p": 24, "j": 21, "a": 27, "w": 21, "t": 6, "u": 7, "f": 23, "m": 18, "r": 17}
    for letter, n in sizes.items():
        for i in range(1, n + 1):
            assert any(k.startswith(f"{letter}{i}_") for k in REGISTRY), f"{letter}{i}"

"""Every key-value query against its SQL oracle, and the entry point."""

import pytest

from keyloom.plans import registry

from .conftest import DATA, same


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(name, spark, duck):
    assert same(registry.queries()[name](spark, DATA), duck, registry.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_bounds_reach_the_scan(spark):
    plan = registry.queries()["kv_range_scan_stop"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(c_name" in plan and "LessThan(c_name" in plan
    plan = registry.queries()["kv_prefix_keys_only"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(url" in plan and "html" not in plan
    assert "NestedLoop" not in registry.queries()["route_range"](spark, DATA)._jdf.queryExecution().executedPlan().toString()

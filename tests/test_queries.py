"""Every registered query of the tree operators against its SQL."""

import importlib

import pytest

from boughs import queries as own

from oracle import difference

NAMES = list(own.queries())


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, sf_dir, name):
    assert difference(own.queries()[name](spark, sf_dir), sf_dir, own.oracle_sql()[name]) == ""


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).columns == ["tag", "created"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_paths_run_no_python(spark, sf_dir):
    for name in ("project_depth", "filter_native", "map_value", "flagship", "group_chain", "group_nested", "explode_lists", "assign_nested", "deep_map"):
        assert "Python" not in plan(own.queries()[name](spark, sf_dir)) and "Arrow" not in plan(own.queries()[name](spark, sf_dir))


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    found = plan(own.filter_native(spark, sf_dir))
    assert "GreaterThan(l_quantity,45.0)" in found
    assert "l_comment" not in found and "l_shipdate" not in found


def test_sizes_of_groups_collect_no_records(spark, sf_dir):
    found = plan(own.mixed_group(spark, sf_dir))
    assert "partial_count" in found and "collect_list" not in found and found.count("MapInArrow") == 1

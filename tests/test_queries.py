"""Every query of the sequence engine against its SQL, or for rows."""

import pytest

from helixframe.plans import catalogue

SLOW = {"rule_levels"}


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, sf_dir, same, name):
    same(catalogue.QUERIES[name](spark, sf_dir), catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) - SLOW))
def test_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_levels_by_joins_equal_those_in_tasks(spark, sf_dir):
    columns = ["seq_id", "rule_id", "depth", "expanded_length", "assembly_index"]
    in_tasks = catalogue.QUERIES["rule_analysis"](spark, sf_dir).select(columns).collect()
    by_joins = catalogue.QUERIES["rule_levels"](spark, sf_dir).select(columns).collect()
    assert sorted(map(tuple, in_tasks)) == sorted(map(tuple, by_joins))
    assert all(r["assembly_index"] == r["expanded_length"] - 1 for r in in_tasks)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

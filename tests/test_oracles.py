"""Every registered analytics query against its DuckDB form; those without one must run and keep a stable schema."""

from __future__ import annotations

import pytest
from conftest import DATA
from oracle import connect, rows_of, rows_of_sql

from tessitura.plans import registry

FOLDER = f"{DATA}/sf0.001"
#: Run in test_trees.py, on more rows.
ELSEWHERE = ("udf_03_pair_classifiers", "udf_04_query_classifiers")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    names, want = rows_of_sql(duck, registry.ORACLES[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == want


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if n not in registry.ORACLES and n not in ELSEWHERE))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, FOLDER)
    assert df.columns and df.count() >= 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())

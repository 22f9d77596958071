"""Every query runs on the smallest tables; those with SQL agree with it."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from graphloom.plans.verify import duck, normal

QUERIES, SQL = entry.queries(), entry.oracle_sql()
CORE = [k for k, f in QUERIES.items() if not f.__module__.startswith("graphloom.llm")]


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_entry(spark):
    assert entry.entry(spark).columns == ["ref_table", "ref_id", "ref_field", "reason", "ref_month"]


@pytest.mark.parametrize("name", CORE)
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        want = con.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)

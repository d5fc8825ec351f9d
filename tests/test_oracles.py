"""Every registered query against its SQL counterpart on the same tables."""

from __future__ import annotations

import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries

from talentmill.plans.oracles import ORACLES
from talentmill.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, small_dir, con, name):
    assert differences(QUERIES[name](spark, small_dir), con, ORACLES[name]) == []


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() == 200

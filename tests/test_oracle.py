"""Every registered query of the retrieval engine agrees with its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import connect, rows_of, sql_rows

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert rows_of(catalogue.queries()[name](spark, SF)) == sql_rows(con, catalogue.oracle_sql()[name])

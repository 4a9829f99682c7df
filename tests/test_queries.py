"""Every core query against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from oracle import check
from tonewell.plans import catalog

FOLDER = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


def test_every_statement_has_a_query():
    assert set(SQL) <= set(catalog.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    check(spark, FOLDER, catalog.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_other_queries_give_rows(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0

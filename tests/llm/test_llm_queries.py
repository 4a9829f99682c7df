"""Queries of the subpackage against their SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from oracle import check
from tonewell.llm import catalog

FOLDER = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    check(spark, FOLDER, catalog.queries()[name], SQL[name])


COLUMNS = {
    "p1_found": [("id_a", "bigint"), ("id_b", "bigint")],
    "p2_found": [("query_id", "bigint"), ("defect", "string")],
    "p3_found": [("anchor_id", "string"), ("audio_id", "string"), ("rnk", "int")],
    "p4_found": [("field_name", "string"), ("term", "string"), ("mark", "string")],
    "p5_found": [("id_a", "bigint"), ("id_b", "bigint")],
    "p6_found": [("table_name", "string"), ("id_a", "bigint"), ("id_b", "bigint")],
    "p8_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p10_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert catalog.queries()[name](spark, FOLDER).dtypes == COLUMNS[name]


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_other_queries_give_rows(spark, name):
    df = catalog.queries()[name](spark, FOLDER)
    assert df.distinct().count() == df.count() > 0

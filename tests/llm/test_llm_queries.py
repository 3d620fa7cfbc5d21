"""Queries of the subpackage against their SQL on whole tables."""

from __future__ import annotations

import pytest
from oracle import rows_of, sql_rows

from cresset.llm import oracle, queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    columns, got = rows_of(queries.QUERIES[name](spark, data))
    if name in oracle.ORACLE:
        assert (columns, got) == sql_rows(data, oracle.ORACLE[name])
    else:
        assert columns


COLUMNS = {
    "p1_found": ["target_set", "category"],
    "p3_found": ["row_id", "item_id"],
    "p4_found": ["table_name", "row_id"],
    "p5_found": ["table_name", "field_name", "row_id"],
    "p6_found": ["keep_id", "copy_id"],
    "p7_ids": ["doc_id", "ids"],
    "p8_found": ["doc_id", "item_id"],
    "p9_found": ["doc_id_a", "doc_id_b"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, data, name):
    assert queries.QUERIES[name](spark, data).columns == COLUMNS[name]

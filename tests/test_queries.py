"""Every registered query against its SQL on whole tables."""

from __future__ import annotations

import pytest
from oracle import rows_of, sql_rows

from cresset.plans import catalog_queries


@pytest.mark.parametrize("name", sorted(catalog_queries.QUERIES))
def test_query(spark, data, name):
    columns, got = rows_of(catalog_queries.QUERIES[name](spark, data))
    if name in catalog_queries.ORACLE:
        assert (columns, got) == sql_rows(data, catalog_queries.ORACLE[name])
    else:
        assert columns


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["catalog", "item_id", "interaction_count", "popularity_quartile"]
    assert set(e.oracle_sql()) <= set(e.queries())

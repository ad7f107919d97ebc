"""Every registered query that no SQL checks runs over the smallest tables; SQL has the same keys."""

import pytest

from revdelta.plans import catalog
from revdelta.sources.scratch import scratch

FOLDER = "/root/testdata/sf0.001"
ALONE = sorted(set(catalog.queries()) - set(catalog.oracle_sql()))


def test_sql_belongs_to_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize("name", ALONE)
def test_query_runs(spark, name):
    with scratch(spark):
        rows = catalog.queries()[name](spark, FOLDER)
        assert rows.columns and rows.count() >= 0

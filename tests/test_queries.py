"""Every registered query of the core runs on the smallest tables, on empty ones and on odd ones."""

import pytest

from gnomon.plans import core_queries, hierarchy_queries
from tests.odd_tables import SF, build

QUERIES = {**core_queries.QUERIES, **hierarchy_queries.QUERIES}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    return build(spark, str(tmp_path_factory.mktemp("tables")))


@pytest.mark.parametrize("name", QUERIES)
def test_runs(spark, folders, name):
    plain = QUERIES[name](spark, SF)
    assert len(set(plain.columns)) == len(plain.columns)
    plain.count()
    assert QUERIES[name](spark, folders[0]).count() == 0
    assert QUERIES[name](spark, folders[1]).columns == plain.columns
    QUERIES[name](spark, folders[1]).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

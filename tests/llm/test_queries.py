"""Every registered query of the corpus operators runs on the smallest tables, on empty ones and on odd ones."""

import pytest

from gnomon.llm.queries import QUERIES
from tests.odd_tables import SF, build


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    return build(spark, str(tmp_path_factory.mktemp("tables")))


@pytest.mark.parametrize("name", QUERIES)
def test_runs(spark, folders, name):
    plain = QUERIES[name](spark, SF)
    n = plain.count()
    assert QUERIES[name](spark, folders[0]).count() == 0
    rows = QUERIES[name](spark, folders[1]).collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows)) and {tuple(r) for r in plain.collect()} <= {tuple(r) for r in rows} and len(rows) - n <= 1

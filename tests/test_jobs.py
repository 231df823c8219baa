"""Task queries against their oracles."""

import pytest

from facetta.plans import catalog, jobs
from tests.compare import compare, connect


@pytest.mark.parametrize("name", sorted(jobs.QUERIES))
def test_queries_match_their_oracles(spark, sf, name):
    assert compare(spark, connect(sf), sf, catalog.queries()[name], jobs.ORACLES[name]) == ""


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_a_query_far_from_all_is_rejected(spark):
    """The fused retrieval has accepted and rejected queries."""
    found = {r.query_id: r.db_id for r in jobs.task_retrieval_distcomb(spark, "/root/testdata/sf0.01").where("rnk = 1").collect()}
    assert len(found) == 5 and found[400] == -1 and all(found[i] > 0 for i in (0, 100, 200, 300))

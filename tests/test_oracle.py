"""Registered queries with a check statement, at the smallest scale."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect

SF = "/root/testdata/sf0.001"
ORACLES = oracle_sql()
# The loops of these take long; their parts are covered by the other queries.
SLOW = {"m02_choose_kind", "m27_repair_faces", "m29_face_values", "m29_per_face", "j06_transfer_labels", "m25_section_stack", "m01_fit_own_kind", "m28_import", "g18_closed_chains", "g16_filled_loops", "m29_deviation_stats", "m29_deviation_summary"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_query_matches_sql(spark, con, name):
    # A few fixtures are empty at this scale; both engines then agree on no rows.
    assert compare(spark, con, name, queries()[name], ORACLES[name], SF) in (None, "no rows")


def test_entry(spark):
    assert entry(spark).count() == 5

"""Every query of the core at the smallest scale; those with SQL must equal it."""

import pytest
from compare import compare, duck

from orrery import plans

SF = "/root/testdata/sf0.001"
QUERIES, SQLS = plans.queries(), plans.oracles()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, said = compare(spark, con, SF, name, QUERIES[name], SQLS.get(name))
    assert ok, said


#: Queries without SQL, and the query with SQL or the test that holds the same operator to something.
WITHOUT_SQL = {
    "g13_region_growing": "g13_checks",
    "a31_segment_merge": "a31_checks",
    "a12_oriented_box": "a12_checks",
    "a13_principal_axes": "a13_checks",
    "a19_mean_rotation": "a19_checks",
    "a20_rig_rotation": "a20_checks",
    "a22_ground_plane": "a22_checks",
    "o04_auto_views": "o04_checks",
    "o05_quality_views": "o05_first_choice",
    "g08_shape_class": "g08_checks",
    "pol_01_demosaic": "pol_checks",
    "pol_13_edges": "pol_checks",
    "pol_14_segments": "pol_checks",
    "pol_15_outline": "pol_checks",
    "pol_16_integrate": "pol_checks",
    "extra_approx_distinct": "built in",
}


def test_every_query_has_sql_or_another_check():
    assert set(QUERIES) - set(SQLS) == set(WITHOUT_SQL)


def test_names_match():
    assert set(SQLS) <= set(QUERIES)

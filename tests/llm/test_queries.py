"""The queries of the subpackage at the smallest scale; those with SQL must equal it."""

import pytest
from compare import compare, duck

from orrery.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    ok, said = compare(spark, duck(SF), SF, name, QUERIES[name], ORACLES.get(name))
    assert ok, said

"""Every registered query equals its DuckDB oracle on the smallest scale factor."""

import pytest

from tenderlake.plans.registry import ORACLE, QUERIES, load_all

load_all()

SF = "/root/testdata/sf0.001"


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck_small, name):
    from tenderlake.plans.check import compare
    r = compare(spark, duck_small, name, SF)
    assert r["status"] == "match", r

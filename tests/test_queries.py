"""Each registered query beside its SQL."""

import pytest

from claimspark.plans import registry

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    compare(registry.queries()[name](spark, SF), duck.sql(registry.oracle_sql()[name]))


def test_roster():
    """Queries without SQL are those that SQL can't express; each has a test of its own."""
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"bound_quantity", "attribution_tags", "max_matching", "family_reuse", "top1_without_replacement"}

"""Every registered query with SQL against that SQL, on the smallest tables."""

import compare
import pytest

from quarry.plans import catalog
from quarry.plans.registry import TABLES

SF = "/root/testdata/sf0.001"
ORACLES = catalog.oracle_sql()
#: Inputs that are empty or one-sided on so few rows.
MAY_BE_EMPTY = {"M18_common_subset", "T35_needle_contexts", "F10_semantic_inclusion"}


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF, TABLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    found = compare.differ(catalog.queries()[name](spark, SF), con, ORACLES[name])
    assert found is None or (found == "no rows" and name in MAY_BE_EMPTY), found


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0

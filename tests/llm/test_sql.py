"""Operators that SQL expresses against that SQL."""

import compare
import pytest

from quarry.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "benchmark", "sale_lines", "sales", "items", "vendors", "clients"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert compare.differ(queries.queries()[name](spark, SF), compare.duck(SF, TABLES), queries.oracle_sql()[name]) is None

"""Queries against their SQL where numbers grow past a million, lines share their number or titles hold references."""

import shutil

import compare
import duckdb
import pytest

from quarry.plans import catalog
from quarry.plans.registry import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def copied(tmp_path):
    """A copy of the smallest tables, and a writer of one of them anew."""
    for t in TABLES:
        (shutil.copytree if (source := tmp_path.__class__(f"{SF}/{t}.parquet")).is_dir() else shutil.copy)(source, tmp_path / f"{t}.parquet")

    def write(name: str, sql: str) -> None:
        (tmp_path / f"{name}.parquet").unlink()
        duckdb.connect().execute(f"COPY ({sql.format(f'{chr(39)}{SF}/{name}.parquet{chr(39)}')}) TO '{tmp_path}/{name}.parquet'")

    return str(tmp_path), write


@pytest.mark.parametrize("name", ["M19_date_counterfactual", "M20_conservative_dates", "P15_usage_prior_rerank"])
def test_the_last_line_with_part_keys_past_a_million(spark, copied, name):
    sf, write = copied
    write("part", "SELECT * REPLACE (p_partkey + CASE WHEN p_partkey % 2 = 0 THEN 3000000 ELSE 0 END AS p_partkey) FROM {}")
    write("lineitem", "SELECT * REPLACE (l_partkey + CASE WHEN l_partkey % 2 = 0 THEN 3000000 ELSE 0 END AS l_partkey) FROM {}")
    assert compare.differ(catalog.queries()[name](spark, sf), compare.duck(sf, TABLES), catalog.oracle_sql()[name]) is None


def test_conditions_of_one_line_number_stand_in_the_order_of_their_text(spark, copied):
    sf, write = copied
    write("lineitem", "(SELECT * REPLACE ('Z' AS l_returnflag) FROM {0}) UNION ALL (SELECT * REPLACE ('C' AS l_returnflag) FROM {0}) UNION ALL (SELECT * REPLACE ('M' AS l_returnflag) FROM {0})")
    for r in catalog.queries()["T33_eligibility_excerpt"](spark, sf).collect():
        flags = [w for w in r["long"].split() if w in ("Z", "C", "M")]
        assert flags == (["C", "M", "Z"] * 4)[: len(flags)]


def test_titles_decode_the_references_that_the_sql_decodes(spark, copied):
    sf, write = copied
    write("pages", "SELECT * REPLACE (replace(html, '<article><h1>', '<article><h1>&quot;A&quot; &#65; &middot; &amp;middot; &amp;quot; R&amp ') AS html) FROM {}")
    assert compare.differ(catalog.queries()["S27_detail_pages"](spark, sf), compare.duck(sf, TABLES), catalog.oracle_sql()["S27_detail_pages"]) is None

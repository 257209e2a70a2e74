"""Filters and keyword features on odd rows."""

import datetime

import pytest

from quarry.operators import filters

FEATURES = "text string, code string, scale string, scope string, technology string, gases array<string>"


def test_matches_of_known_unknown_and_missing_features(spark):
    rows = [
        ("A WIND farm, CO₂ and nf3", "AMS-I.D.", "large", "01-energy-industries", "wind", ["SF6", "CO2"]),
        ("Small-Scale tidal plant", "VM0001", "small", "06-construction", "Tidal", ["NF3", None]),
        (None, "AMS-I.D.", "small", "", "", []),
        ("", None, None, None, None, None),
        ("wind", "VM0001", "large", "02-energy-distribution", "solar-PV", ["HFC"]),
    ]
    got = filters.matched(spark.createDataFrame(rows, FEATURES)).select("matched", "match_count", "excluded", "reasons").collect()
    assert [tuple(r) for r in got] == [
        (["scope", "technology", "ghg"], 3, True, ["scale=large but code is AMS-* (small-only)"]),
        (["scale", "technology"], 2, False, []),
        (["scale"], 1, False, []),
        ([], 0, False, []),
        (["scale"], 1, False, []),
    ]
    assert filters.matched(spark.createDataFrame([], FEATURES)).count() == 0


def test_stages_of_the_allow_list(spark, monkeypatch):
    day = datetime.date
    space = spark.createDataFrame(
        [("ACM0001", ["CDM"], "Active", day(2015, 1, 1), ["1"]), ("AMS-I.D.", [], "Active", None, ["1", "13"]), ("VM0001", ["GS"], "Withdrawn", day(9999, 12, 31), None), ("VM0002", None, None, None, ["3"])],
        "code string, standards array<string>, status string, last date, scopes array<string>",
    )
    projects = spark.createDataFrame(
        [(1, "GS", day(2020, 1, 1), "LARGE", "01-energy"), (2, "VCS", None, None, " 13 waste"), (3, None, day(2014, 1, 1), "small", ""), (3, None, day(2014, 1, 1), "small", ""), (4, "Plan", day(2020, 1, 1), "large", None)],
        "project long, registry string, start date, scale string, scope string",
    )
    keys = ("n_all", "n_registry", "n_date", "n_scale", "n_boosted")
    counts = lambda **how: sorted((r.project, *(r[k] for k in keys)) for r in filters.staged(projects, space, **how).collect())
    assert counts(dated=True) == [(1, 4, 3, 1, 0, 0), (2, 4, 4, 4, 4, 1), (3, 4, 4, 3, 4 - 1, 0), (3, 4, 4, 3, 3, 0), (4, 4, 4, 2, 1, 0)]
    assert counts() == [(1, 4, 3, 3, 2, 1), (2, 4, 4, 4, 4, 1), (3, 4, 4, 4, 4, 0), (3, 4, 4, 4, 4, 0), (4, 4, 4, 4, 3, 0)]
    assert {r.n_all for r in filters.staged(projects, space.limit(0)).collect()} == {0}
    assert filters.staged(projects.limit(0), space).count() == 0
    monkeypatch.setattr(filters, "MOST_CODES", 3)
    with pytest.raises(ValueError):
        filters.staged(projects, space)

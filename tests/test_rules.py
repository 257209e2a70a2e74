"""Rules of headings, choices and gaps against plain Python written from the rule."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import evaluate, fusion, sampling, sections

LABELS = "Applicability|Eligibility|Baseline scenario|Monitoring|Project boundary|Boundaries|Definitions".split("|")


def category(title):
    low = title.lower()
    if re.search(r"\b(applicability|eligibility|eligible\s+activit)", low):
        return "applicability"
    rules = {
        "baseline_scenario": r"\bbaseline\b|calculation\s+of\s+(?:baseline\s+)?emission\s+reduction", "project_scenario": r"\b(project\s+boundar|boundar(?:y|ies)|project\s+scenario)\b",
        "parameters_monitored": r"\bmonitoring\b|\bparameters\s+(?:to\s+be\s+)?monitored\b", "typical_projects": r"\bscope\b",
    }
    found = [(m.start(), k) for k, p in rules.items() if (m := re.search(p, low))]
    if "monitor" not in low and (m := re.search(r"\bdefinition", low)):
        found.append((m.start(), "definitions"))
    return min(found)[1] if found else None


def split(text):
    """Bodies by category: lines of contents out, every heading with a category ends the body before it."""
    lines = re.sub(r"^[^\n]*?\.{8,}\s*\d+\s*$\n?", "", text, flags=re.M).split("\n")
    out, heads = {}, []
    k = 0
    while k < len(lines):
        m = re.match(sections.NUMBERED_HEADING[1:].replace(r"\s+([^\n]{2,200})", r"(?:\s+(.{2,200}))?$"), lines[k])
        title = None
        if m:
            title = m[1]
            later = [j for j in range(k + 1, len(lines)) if lines[j].strip()]
            if title is None and later and len(lines[later[0]].lstrip()) >= 2:
                title = lines[later[0]].lstrip()[:200]
        else:
            rest = "\n".join(lines[k:])
            b = re.match(sections.BARE_HEADING, rest, re.I)
            title = b and b[1]
        if title and category(title):
            heads.append((k, category(title)))
        k += 1
    for i, (k, c) in enumerate(heads):
        end = heads[i + 1][0] if i + 1 < len(heads) else len(lines)
        body = "\n".join(lines[k + 1 : end]).strip()[:8000] if k + 1 < len(lines) else None
        if body is not None:
            out.setdefault(c, []).append(body)
    return {c: "\n\n".join(v) for c, v in out.items()}


def texts():
    r = random.Random(4)
    bits = [
        lambda: f"{r.randint(1, 9)}. {r.choice(LABELS)} of it", lambda: f"{r.randint(1, 9)}.{r.randint(1, 9)} | Sources and sinks", lambda: f"Section {r.randint(1, 9)}: Scope", lambda: f"{r.choice(LABELS)} The rest of it",
        lambda: f"{r.choice(LABELS).upper()}\nthe next line", lambda: "plain words here.", lambda: "Baseline emissions ........ 12", lambda: "", lambda: "\tindented \t", lambda: "x" * 5000, lambda: "III. Calculation of emission reductions",
    ]
    return ["\n".join(r.choice(bits)() for _ in range(r.randint(0, 14))) + "\nlast" for _ in range(200)] + [None, "", "no heading"]


def test_bodies_by_heading(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "i long, text string")
    got = {}
    for r in sections.by_heading(df, "i", "text").collect():
        got.setdefault(r.i, {})[r.category] = r.body
    for i, t in rows:
        assert got.get(i, {}) == split(t or ""), (i, t)


def test_text_after_a_heading_without_category_stays(spark):
    t = "1. Applicability\n first \n2. Sources and sinks\nmore applicability text\n3. Monitoring"
    got = {r.category: r.body for r in sections.by_heading(spark.createDataFrame([(1, t)], "i int, text string"), "i", "text").collect()}
    assert got == {"applicability": "first \n2. Sources and sinks\nmore applicability text", "parameters_monitored": ""}


def test_choice(spark):
    said = {"CHOICE: VM0001 because it fits": "VM0001", "choice :VM0001;": "VM0001", "I prefer VM0001": "VM0001", "CHOICE: other, AMS-I.D. it is": "AMS-I.D.", "AMS-I.D. or VM0001": None, "CHOICE: VM00011": "VM0001", "": None, None: None}
    df = spark.createDataFrame([(t,) for t in said], "t string").select("t", T.choice(F.col("t"), F.lit("AMS-I.D."), F.lit("VM0001")).alias("c"))
    assert {r.t: r.c for r in df.collect()} == said


def test_gap_and_backoff(spark):
    x = spark.createDataFrame(
        [("a", "b", 1, 1, "f", "g", None, None), ("a", "b", 1, 1, "f", "f", "s", "l"), ("a", "b", 1, 1, "f", "f", None, "l"), ("a", "a", 1, 1, "f", "f", "s", "s"), ("a", "b", 1, 2, "f", "g", "s", "l")],
        "pred string, gt string, pred_group int, gt_group int, pred_family string, gt_family string, pred_scale string, gt_scale string",
    )
    assert {r.part: r.n for r in evaluate.gap(x).collect()} == {"registry_variant": 1, "scale_tier": 1, "fine_applicability": 1}
    prior = spark.createDataFrame([("c", "r", "p", 5), ("d", "r", "q", 2)], "country string, region string, code string, n long")
    wanted = spark.createDataFrame([(1, "c", "r", "p"), (1, "c", "r", "q"), (2, "e", "r", "q"), (3, "e", "s", "q"), (4, "e", "s", "z")], "qid int, country string, region string, code string")
    got = evaluate.backoff(prior, wanted, [["country", "code"], ["region", "code"], ["code"]], ["qid"])
    assert sorted((r.qid, r.code, r.n) for r in got.collect()) == [(1, "p", 5), (1, "q", 0), (2, "q", 2), (3, "q", 2), (4, "z", 0)]


def test_lists_without_any_valid_code_and_judged_lists(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "x", 1)], "qid int, code string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (2, "x", 1), (3, "z", 1)], "qid int, code string, rank int")
    routed = spark.createDataFrame([(1, "y", 1)], "qid int, code string, rank int")
    assert sorted(tuple(r) for r in fusion.or_unrouted(routed, a, b, 5).collect()) == [(1, "y", 1), (2, "x", 1), (3, "z", 1)]
    said = spark.createDataFrame([(1, "y"), (2, "q")], "qid int, choice string")
    assert sorted(tuple(r) for r in fusion.judged(a, b, said, 5).collect()) == [(1, "x", 2), (1, "y", 1), (2, "x", 1), (3, "z", 1)]


def test_pilot_takes_all_leaked_first(spark):
    d = spark.range(60).selectExpr("id", "id % 3 AS cell", "id % 10 = 0 AS leaked")
    got = [r.id for r in sampling.round_robin(d, ["cell"], "id", 20, "leaked").collect()]
    assert len(got) == 20 and {0, 10, 20, 30, 40, 50} <= set(got)
    assert sampling.round_robin(d, ["cell"], "id", 3, "leaked").count() == 6


def test_lookups_and_invariants_fail_with_their_counts(spark, tmp_path):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "gid int, x string")
    right = spark.createDataFrame([(1, "p")], "gid int, y string")
    found = evaluate.looked_up(left, right, "gid")
    found.rows.write.parquet(str(tmp_path / "out"))  # the same job counts
    with pytest.raises(ValueError, match="2 rows: no right row of gid"):
        found.demand()
    whole = evaluate.looked_up(left.where("gid = 1"), right, "gid")
    assert whole.rows.collect() == [(1, "a", "p")] and whole.demand() is None
    lists = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "z", 1)], "qid int, code string, rank int")
    truth = spark.createDataFrame([(1, "b"), (2, "y"), (3, "a")], "qid int, gt string")
    groups = spark.createDataFrame([("a", "g"), ("b", "g")], "code string, grp string")
    ranks = evaluate.group_ranks(lists, truth, groups)
    assert {r.qid: (r.exact_rank, r.group_rank) for r in ranks.rows.collect()} == {1: (2, 1), 2: (None, None), 3: (None, None)}
    ranks.demand()
    broken = evaluate.Checked(lists, {"first": F.col("rank") == 1})
    broken.rows.count()
    with pytest.raises(ValueError, match="2 rows: first"):
        broken.demand()

"""Micro-fixtures: ties, empty inputs and the other traps of each operator."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import codes, stats, text
from quarry.operators import catalogue, evaluate, filters, fusion, index, retrieve, sampling, sections
from quarry.sources import landed


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).collect()[0].x


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("t")), t="CO2 a1 x9z The été day solar SOLAR") == ["co2", "x9z", "solar", "solar"]
    assert one(spark, text.tokens(F.col("t")), t=None) == []


def test_bm25_counts_repeats_and_empty_documents(spark):
    docs = spark.createDataFrame([(1, "solar wind wind"), (2, ""), (3, "hydro plant")], "doc long, text string")
    ix = index.build(docs, "doc", "text")
    n, avgdl = ix.totals.collect()[0]
    assert (n, round(avgdl, 6)) == (3, round(5 / 3, 6))
    q = spark.createDataFrame([(1, "solar"), (2, "solar solar solar"), (3, "absent")], "q long, text string")
    s = {(r.qid, r.doc): r.score for r in retrieve.bm25(q, ix, "q", "text").collect()}
    assert set(s) == {(1, 1), (2, 1)}
    assert math.isclose(s[2, 1], 3 * s[1, 1])
    idf = math.log((3 - 1 + 0.5) / 1.5 + 1)
    assert math.isclose(s[1, 1], idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / (5 / 3))))


def test_rank_of_counts_documents_without_score(spark):
    scored = spark.createDataFrame([(1, "b", 2.0), (1, "c", 2.0)], "qid long, doc string, score double")
    targets = spark.createDataFrame([(1, "c"), (2, "b")], "qid long, target string")
    size = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "doc string")
    got = {r.qid: r.rank for r in retrieve.rank_of(scored, targets, size).collect()}
    assert got == {1: 2, 2: 2}
    got = retrieve.rank_of(scored, spark.createDataFrame([(1, "d")], "qid long, target string"), size).collect()[0]
    assert got["rank"] == 4


def test_min_max_and_fuse(spark):
    ch = spark.createDataFrame([(1, "a", 3.0), (2, "a", 1.0), (2, "b", 1.0), (3, "a", 0.0), (3, "b", 4.0)], "qid long, code string, score double")
    got = {(r.qid, r.code): r.x for r in ch.select("qid", "code", fusion.min_max("score").alias("x")).collect()}
    assert got == {(1, "a"): 0, (2, "a"): 0, (2, "b"): 0, (3, "a"): 0, (3, "b"): 1}
    three = spark.createDataFrame([(1, "a", 10.0), (1, "b", 5.0), (1, "c", 0.0)], "qid long, code string, score double")
    out = fusion.fuse([(three, 1.0)], 5, spark.createDataFrame([("a",)], "code string")).collect()
    assert {(r.code, r.score) for r in out} == {("b", 0.5), ("c", 0.0)}


def test_rolled_up_is_never_negative(spark):
    s = spark.createDataFrame([(1, 1, -0.3)], "qid long, doc long, score double")
    assert fusion.rolled_up(s, spark.createDataFrame([(1, "a")], "doc long, code string")).collect()[0].score == 0.0


def test_weighted_rrf_absent_rank(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "qid long, code string, rank int")
    b = spark.createDataFrame([(1, "y", 1)], "qid long, code string, rank int")
    got = {r.code: r.score for r in fusion.weighted_rrf(a, b, 0.6, 0.4, 5).collect()}
    assert math.isclose(got["x"], 0.6 / 61 + 0.4 / 62) and math.isclose(got["y"], 0.6 / 62 + 0.4 / 61)


def test_slot_rerank_moves_only_members(spark):
    r = spark.createDataFrame([(1, "a", 1, True, 0.1), (1, "b", 2, False, 9.0), (1, "c", 3, True, 0.9), (1, "d", 4, True, 0.5)], "qid long, code string, rank int, member boolean, new_score double")
    assert {x.code: x["rank"] for x in fusion.slot_rerank(r).collect()} == {"c": 1, "b": 2, "d": 3, "a": 4}


def test_budget_stops_at_the_first_overflow(spark):
    lines = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "b" * 50), (1, 3, "c")], "id long, pos int, line string")
    assert fusion.budgeted(lines, "id", "pos", "line", 20).collect()[0].block == "aaaa"


def test_dense_matches_brute_force(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(50)] + [(50, [0.0] * 8), (51, None)]
    v = spark.createDataFrame(rows, "id long, e array<double>")
    got = retrieve.dense(v.where("id < 5"), v, 7, "id", "id", "e").collect()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    cos = lambda a, b: dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))) if any(b) else 0.0
    for q, e in rows[:5]:
        want = sorted(((-round(cos(e, x), 9), i) for i, x in rows[:51]))[:7]
        assert [(x.doc, x["rank"]) for x in sorted((x for x in got if x.qid == q), key=lambda x: x["rank"])] == [(i, k + 1) for k, (_, i) in enumerate(want)]
    assert retrieve.dense(v.where("id > 99"), v, 7, "id", "id", "e").count() == 0


def test_codes(spark):
    fam = {c: one(spark, codes.family(F.col("c")), c=c) for c in ("AM0001", "AMS-I.D.", "GCCM001", "402-1", "TPDDTEC")}
    assert fam == {"AM0001": "CDM", "AMS-I.D.": "CDM", "GCCM001": "VCS", "402-1": "GS", "TPDDTEC": "OTHER"}
    dates = {s: one(spark, codes.parse_date(F.col("s")), s=s) for s in ("2020-04-06", "2020-04-06T00:00:00Z", "2020-4-6", "2020", "", "2020-13-01")}
    assert [str(v) for v in dates.values()] == ["2020-04-06"] * 3 + ["None"] * 3
    assert one(spark, codes.version_key(F.col("v")), v="1.10") == [1, 10] and one(spark, codes.version_key(F.col("v")), v="draft") == [0]
    assert one(spark, codes.name_rank(F.col("n")), n="x_PDD_v2.pdf") == 1 and one(spark, codes.name_rank(F.col("n")), n="PDD Monitoring Report.pdf") is None


def test_allow_list_unknown_registry_keeps_all(spark):
    p = spark.createDataFrame([("p", None, "small"), ("q", "GS", "large")], "project string, registry string, scale string")
    s = spark.createDataFrame([("VM0001", "VCS"), ("AMS-I.D.", "CDM"), ("GS-EN-1", None)], "code string, standard string")
    got = {r.project: (r.n_all, r.n_registry, r.n_scale) for r in filters.allow_list(p, s).collect()}
    assert got == {"p": (3, 3, 3), "q": (3, 2, 1)}


def test_validity(spark):
    v = spark.sql("SELECT * FROM VALUES (1, date'2000-01-01', date'2001-01-01', 'Active'), (2, date'2000-01-01', null, 'Active'), (3, date'2000-01-01', null, 'Withdrawn') t(code, ef, et, status)")
    d = spark.sql("SELECT * FROM VALUES (1, date'2005-01-01', 1), (2, date'2005-01-01', 2), (3, date'2005-01-01', 3), (4, date'2005-01-01', 4), (5, null, 3) t(gid, d, code)")
    assert {r.gid: r.invalid for r in filters.invalid_at(d, v).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_sentence_mask_against_plain_python(spark):
    r = random.Random(5)
    parts = ["ACM0002", "AMS-I.D.", "word", "Next one. ", "End! ", "\n\n", "</tr>", "Tx ", " ", "TPDDTEC", "VM0007 ", "x? Y"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(200)] + [None, "", "two ACM0001 and AM0002 here. Then more."]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", sections.mask_sentences("t").alias("m")).collect()
    for row in got:
        t, m = texts[row.i] or "", row.m
        rebuilt, at = "", 0
        for s in m.spans:
            rebuilt, at = rebuilt + t[at : s.start] + text.MASK, s.end
        assert rebuilt + t[at:] == m.text
        assert all(a.end < b.start for a, b in zip(m.spans, m.spans[1:], strict=False))
        for _, p in text.REDACTION:
            for x in re.finditer(p, t):
                assert any(s.start <= x.start() and x.end() <= s.end or s.start <= x.start() < s.end for s in m.spans)
    last = next(r for r in got if r.i == len(texts) - 1)
    assert last.m.text == text.MASK + " Then more." or last.m.text.count(text.MASK) == 1


def test_max_gap(spark):
    a, b = sections.SECTION_A, sections.SECTION_B
    t = "SECTION A. x\nSECTION B. y\nSECTION A. z\nSECTION B. w"
    got = one(spark, sections.max_gap(F.col("t"), a, b), t=t)
    assert (got.start, t[got.end :].strip()) == (0, "SECTION B. w")
    assert one(spark, sections.max_gap(F.col("t"), a, b), t="SECTION B. y\nSECTION A. x") is None


def test_balanced_json(spark):
    got = [one(spark, sections.json_part("t"), t=t) for t in ('say {"a": {"b": 1}} x {"c": 2}', "```json\n{\"k\": 1}\n```", "none", None)]
    assert got == ['{"a": {"b": 1}}', '{"k": 1}', None, None]


def test_statistics(spark):
    c = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (10.0, 2.0)], "b double, c double").select(stats.mcnemar(F.col("b"), F.col("c")).alias("x")).withColumn("p", stats.chi_p("x")).collect()
    assert [round(r.x, 6) for r in c] == [0, 0, round(49 / 12, 6)] and c[0].p == 1.0 and 0.04 < c[2].p < 0.05
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    w = spark.createDataFrame([(0.0, 0.0), (0.0, 5.0), (5.0, 5.0)], "k double, n double").select(lo.alias("lo"), hi.alias("hi")).collect()
    assert (w[0].lo, w[0].hi) == (0, 0) and w[1].lo == 0 and w[2].hi == 1


def test_order_statistics_upper_median(spark):
    d = spark.createDataFrame([("a", float(x)) for x in (4, 1, 3, 2)], "k string, x double")
    r = evaluate.order_statistics(d, "k", "x").collect()[0]
    assert (r.upper_median, r.p90, r.least, r.most) == (3, 4, 1, 4)


def test_bootstrap(spark):
    d = spark.createDataFrame([(1,)] * 30 + [(-1,)] * 10 + [(0,)] * 60, "d int")
    r = evaluate.bootstrap(d).collect()[0]
    assert r.n == 100 and math.isclose(r.delta, 0.2) and 0.05 < r.low < 0.1 < 0.3 < r.high < 0.35


def test_program_dedupe_and_split(spark):
    d = spark.createDataFrame([(1, "p", "2020"), (2, "p", "2020"), (3, None, None), (4, None, None), (5, "q", None)], "gid long, p string, d string")
    assert {r.gid for r in sampling.one_per_program(d, "p", "d", "gid").collect()} == {1, 3, 4, 5}
    s = spark.range(100).withColumn("s", F.col("id") % 2)
    got = sampling.split(s, "s", "id", 15)
    assert {r.s: r.n for r in got.where("split = 'val'").groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()} == {0: 8, 1: 7}  # 7.5 to even, the rest to the last
    assert got.repartition(7).where("split = 'val'").exceptAll(got.where("split = 'val'")).count() == 0


@pytest.mark.parametrize(
    ("name", "body", "kind"),
    [
        ("VPA-DD of PoA-DD.pdf", "x", "GS-PoA-DD"),
        ("SD VISTA PoA-DD.pdf", "x", "SD-VISta"),
        ("x_CCB-PDD.pdf", "x", "unknown"),  # no word begins after an underscore
        ("x CCB-PDD.pdf", "x", "SD-VISta"),
        ("CPA-12.pdf", "VCS Project Description Template", "VCS-CPA-component"),
        ("CPA-12.pdf", "CDM-PDD-FORM", "CDM-CPA-DD"),
        ("1234-VCS-Project.pdf", "x", "VCS-PD"),
        (None, "CPA-W-015 of it. Document Prepared by Z", "VCS-CPA-component"),
        (None, "Document Prepared by Z", "VCS-PD"),
        ("rvpa.pdf", "Grouped Project", "GS-VPA-DD"),
        ("a.pdf", "Grouped Project", "VCS-Grouped"),
        ("VPA-DD", "\t\n\u00a0", "empty"),
        ("VPA-DD", None, "empty"),
    ],
)
def test_document_types(spark, name, body, kind):
    df = spark.createDataFrame([(name, body)], "n string, t string")
    assert df.select(sections.doc_type(F.col("n"), F.col("t"))).first()[0] == kind


def test_an_empty_allow_list_masks_nothing(spark):
    from quarry.operators import index, retrieve

    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "gamma alpha"), (3, "beta gamma")], "d long, t string")
    asked = spark.createDataFrame([(7, "alpha gamma")], "q long, t string")
    built = index.build(docs, "d", "t")
    score = lambda allowed: {r.doc: round(r.score, 9) for r in retrieve.bm25(asked, built, "q", "t", allowed).collect()}
    ids = docs.select(F.col("d").alias("doc"))
    assert score(ids.limit(0)) == score(None) and set(score(None)) == {1, 2, 3} and set(score(ids.where("doc > 1"))) == {2, 3}


def test_a_reference_that_opens_a_sentence_takes_the_one_before(spark):
    cases = {
        "One here. Two there. ACM0002 is it. Three.": "One here. [REDACTED:METHODOLOGY_REF] Three.",
        "One here. See ACM0002 now. Three.": "One here. [REDACTED:METHODOLOGY_REF] Three.",
        "A.\n\nACM0002.\n\nB": "A.\n\n[REDACTED:METHODOLOGY_REF]\n\nB",
        'Say "use VM0007." Then on': "[REDACTED:METHODOLOGY_REF] Then on",
    }
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", sections.mask_sentences("t")["text"].alias("m")).collect()
    assert {r.t: r.m for r in got} == cases


def test_rich_text_tiers_against_plain_python(spark):
    fact = r"(?im)^" + sections.KEEP_B
    after = r"(?im)^" + sections.NEXT_B
    base = "Gold Standard for the Global Goals\nSECTION A. Description\nwhat it is\nSECTION B. Application\n"
    texts = [
        base + "B.1 x\nB.3 Project Boundary\ninside\nMonitoring\ndaily 5 kW\nB.4 Baseline\nParameters Monitored\n" + "z" * 5000,
        base + "the parameter list <table>1</table> and monitoring: <TABLE>2\n</TABLE>",
        base + "a plant of 12.5 MWe stands",
        base,
        "no section at all, 3 MW " + "y" * 7000,
        "nothing",
        "",
        None,
    ]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    own = {r.k: r for r in sections.extract_section_a(df, "t").collect()}
    assert [own[k].status == "ok" for k in range(8)] == [True] * 4 + [False] * 4
    for r in sections.rich_text(df, "t").collect():
        t, s = texts[r.k] or "", own[r.k]
        capacity = re.search(text.CAPACITY, t)
        window = t[max(0, capacity.start() - 600) : capacity.end() + 600] if capacity else None
        if s.status != "ok":
            assert (r.tier, r.rich_text) == (3, "\n\n".join(x for x in (t[:6000], window) if x is not None).strip())
            continue
        facts = []
        for m in re.finditer(fact, t):
            if m.start() >= s.end:
                stop = re.search(after, t[m.end() :])
                facts.append(t[m.start() : m.end() + stop.start() if stop else m.start() + 4000].strip())
        tables = [m[1] for m in re.finditer(sections.MONITORED_TABLE, t)]
        want = facts or tables or ([window.strip()] if window else [])
        assert (r.tier, r.n_facts) == (1 if facts else 2 if tables else 3, len(facts))
        assert r.rich_text == "\n\n".join([s.section_text, *want])


def test_json_parts(spark):
    cases = [("a {x} {\"k\": 1}", None, None), ("```json\n{bad}\n``` {\"k\": {\"z\": [1]}} {}", None, "[1]"), ("t {\"k\": {\"z\": [1]}} u", '{"k": {"z": [1]}}', "[1]"), ("```\n[1, 2]\n``` [3]", None, "[1, 2]"), ("[1", None, None), (None, None, None)]
    got = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k long, t string").select("k", sections.json_part("t").alias("o"), sections.json_list("t").alias("l")).collect()
    assert {r.k: (r.o, r.l) for r in got} == {k: c[1:] for k, c in enumerate(cases)}


def test_parts_of_a_document_score_as_their_joined_text(spark):
    docs = spark.createDataFrame([("a", 1, "solar wind wind"), ("a", 2, None), ("a", 3, "hydro solar"), ("b", 1, "plant"), ("c", 1, "")], "code string, pos long, text string")
    q = spark.createDataFrame([(1, "solar wind"), (2, "plant plant hydro"), (3, "absent")], "q long, text string")
    whole = index.build(index.joined_text(docs, "code", "pos", "text"), "code", "text")
    parts = index.build(docs, "code", "text", parts=True)
    score = lambda ix: sorted((r.qid, r.doc, round(r.score, 9)) for r in retrieve.bm25(q, ix, "q", "text").collect())
    assert score(parts) == score(whole) and parts.totals.collect() == whole.totals.collect()


def test_two_forms_of_a_text_are_scored_and_ranked_at_once(spark):
    docs = spark.createDataFrame([("a", "solar wind"), ("b", "solar hydro"), ("c", "plant")], "doc string, text string")
    q = spark.createDataFrame([(1, "solar wind", "solar"), (2, "plant", "nothing")], "q long, x string, y string")
    ix = index.build(docs, "doc", "text")
    both = retrieve.scores(retrieve.query_terms(q, "q", {"x": F.col("x"), "y": F.col("y")}), ix, ["x", "y"])
    for name in "xy":
        alone = {(r.qid, r.doc): r.score for r in retrieve.bm25(q, ix, "q", name).collect()}
        assert {(r.qid, r.doc): r[name] for r in both.collect() if r[name]} == pytest.approx(alone)
    targets = spark.createDataFrame([(1, "b"), (2, "c"), (3, "b")], "qid long, target string")
    got = {r.qid: (r.x_rank, r.y_rank) for r in retrieve.ranks_of(both, targets, ix.stats, ["x", "y"]).collect()}
    assert got == {1: (2, 2), 2: (1, 3), 3: (2, 2)}


def test_reconcile_by_kind_and_dimension(spark):
    m = spark.createDataFrame(
        [("p", "I", " Installed Capacity ", 15.0, True), ("q", "I", "capacity", 14.0, True), ("r", "II", "capacity", 15.0, True), ("s", "I", "capacity", 15.0, False), ("t", "III", None, 60.0, True), ("u", "I", "savings", 1.0, None)],
        "code string, kind string, dimension string, cap double, verify boolean",
    )
    h = spark.createDataFrame([(0, "I", "installed capacity", 15.0), (1, "I", "capacity", 14.0), (2, "III", "reductions", 60.0)], "pos int, kind string, dimension string, cap double")
    got = {r.code: (r.state, r.harvested_cap) for r in catalogue.reconcile(m, h).collect()}
    assert got == {"p": ("confirmed", 15.0), "q": ("conflict", 15.0), "r": ("unconfirmed", None), "t": ("confirmed", 60.0)}


def test_diagnose_counts_what_the_filter_costs(spark):
    c = spark.createDataFrame(
        [(1, "AMS-I.A.", 1, 4, True), (1, "AM0001", 2, 3, False), (2, "AM0002", 1, 4, False), (2, "AM0003", 2, 0, False)], "gid long, code string, rank int, matches int, excluded boolean"
    )
    t = spark.createDataFrame([(1, "AMS-I.A.", True), (2, "AM0003", False), (3, "AM0009", False)], "gid long, gt string, small boolean")
    r = evaluate.diagnose(c, t).collect()[0].asDict()
    want = dict(n=3, ceiling=0.333333, n_small=1, n_small_excluded=1, small_excluded=1.0, full=0.333333, high=0.666667, n_plain=1, n_plain_lost=1, plain_lost=1.0, in_raw=0.666667, plain_top1=0.333333, first_top1=0.0)
    assert r == pytest.approx(want)


def test_condition_report_against_the_baseline(spark):
    rows = [("baseline", 1, 1, False, None, True), ("baseline", 2, None, True, 5.0, False), ("all", 1, 2, False, None, True), ("all", 2, 1, False, 5.0, False), ("all", 9, 1, False, None, True)]
    both = evaluate.against(spark.createDataFrame(rows, "condition string, qid long, rank int, empty boolean, capacity double, grouped boolean"), "baseline")
    got = {r.condition: r for r in evaluate.condition_report(both, "baseline", {"absent": F.col("capacity").isNull()}).collect()}
    assert (got["baseline"].top1, got["baseline"].delta_top1, got["baseline"].n_empty) == (0.5, None, 1)
    assert (got["all"].top1, got["all"].delta_top1, got["all"].chi2, got["all"].delta_top5, got["all"].delta_absent) == (0.5, 0.0, 0.5, 0.5, -1.0)
    lines = {r.subset: (r.n, r.b, r.c) for r in evaluate.by_subset(both.where("condition = 'all'"), {"overall": F.lit(True), "stated": F.col("capacity").isNotNull(), "none": F.lit(False)}).collect()}
    assert lines == {"overall": (2, 1, 1), "stated": (1, 0, 1)}


def test_manifest_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("ACM0001", "a: b # c\n- d", None), ("VM0007", None, 3)], "code string, title string, n int")
    landed.save_manifest(rows, f"{tmp_path}/m")
    assert sorted(landed.load_manifest(spark, f"{tmp_path}/m", rows.schema).collect()) == sorted(rows.collect())
    head = [r.value for r in spark.read.text(f"{tmp_path}/m").collect()][:4]
    assert head[0] == 'version: "0.1"' and head[1].startswith('generated_at: "20') and head[1].endswith('Z"') and head[2:] == ["count: 2", "entries:"]
    landed.save_manifest(rows.limit(0), f"{tmp_path}/none")
    assert landed.load_manifest(spark, f"{tmp_path}/none", rows.schema).count() == 0


def test_components_equal_plain_ones(spark):
    x = np.random.default_rng(1).normal(size=(90, 6)) * np.array([9, 5, 3, 2, 1, 0.5])
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)] + [(90, None)], "k long, e array<double>")
    got = index.reduced(v, index.fit_pca(v, "k", "e", 2), "e").orderBy("k").collect()
    centred = x - x.mean(0)
    want = centred @ np.linalg.svd(centred)[2][:2].T
    assert np.allclose(np.abs([r.reduced for r in got]), np.abs(want))


def test_programme_of_a_component(spark):
    cases = [
        ("GS-VPA-DD", "GS1 GS5658 VPA-37.pdf", "", "GS11044", "GS5658"), ("GS-VPA-DD", "GS11044_GS5658-VPA.pdf", "GS 4321", "GS11044", "GS4321"), ("GS-VPA-DD", None, None, "GS1000", None),
        ("CDM-CPA-DD", "PoA 7_x", "in PoA-12.1", "g", "PoA-12.1"), ("CDM-CPA-DD", "Poa 7", "", "g", "Poa7"), ("CDM-CPA-DD", "x", None, "g", None),
        ("VCS-CPA-component", "cpa-w-015.pdf", "", "g", "CPA-w"), ("VCS-CPA-component", "x", "z" * 490 + " CPA 15", "g", "CPA"), ("VCS-CPA-component", "x", "z" * 500 + "CPA 15", "g", None), ("VCS-PD", "GS7777", "PoA-1", "g", None), (None, "GS7777", "x", "g", None),
    ]
    df = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(cases)], "k long, kind string, name string, text string, gid string")
    got = {r.k: r.p for r in df.select("k", sections.program_id(F.col("kind"), F.col("name"), F.col("text"), F.col("gid")).alias("p")).collect()}
    assert got == {k: c[4] for k, c in enumerate(cases)}


def test_booklet_pages_and_items(spark):
    page = "AM0001 t\nTypical project(s)\na\nBASELINE SCENARIO\nfirst\nBASELINE SCENARIO\n last AM0001 tail\nImportant parameters\nMonitored:\n• m\nAt validation:\n• v;"
    df = spark.createDataFrame([(1, page, "AM0001"), (2, "Typical project(s) only", "AM2"), (3, None, None), (4, "PROJECT SCENARIO and Important conditions", "X")], "k long, text string, code string")
    got = {r.k: r for r in sections.booklet(df).collect()}
    assert set(got) == {1, 4} and (got[1].baseline_scenario, got[1].typical_projects) == ("last", "a")
    assert (got[1].parameters_at_validation, got[1].parameters_monitored) == ([], ["m At validation:", "v"])
    assert (got[4].project_scenario, got[4].applicability) == ("and Important conditions", [])
    items = {"intro\n• a;\n b.,\n•\nc\n  •  d": ["intro", "a; b", "c", "d"], "": [], "•\n•\n;": [], "• x • y": ["x • y"]}
    assert {t: one(spark, sections.booklet_items(F.col("t")), t=t) for t in items} == items


def test_index_rows_and_plans_on_nulls(spark):
    html = 'V x VM0042 y <a class="b" href="https://v.example/1">An\n other</a> VM0042 <a href="https://v.example/2">no</a> VT0001 <a href="https://v.example/3">T --- version 1.0</a>'
    rows = catalogue.index_rows(spark.createDataFrame([(1, html), (2, None), (3, "")], "k long, html string"), "html", catalogue.INDEX_ROWS["Verra"]).collect()
    assert sorted((r.k, r.code, r.url, r.title) for r in rows) == [(1, "VM0042", "https://v.example/1", "An other"), (1, "VT0001", "https://v.example/3", "T")]
    schema = "code string, registry string, documents array<struct<version:string,url:string>>, made_url string, made_version string"
    plans = spark.createDataFrame([("a", None, [("1", None), ("2", "u/x%zz")], "m/1", "9"), ("b", "R", None, "m/b%2Fc", "9"), ("c", "R", [], "", "9"), ("d", "R", None, None, None)], schema)
    assert {(r.code, r.version, r.target) for r in catalogue.download_plan(plans).collect()} == {("a", "2", "_UNKNOWN/a/x%zz"), ("b", "9", "R/b/b/c")}


def test_draws_without_replacement(spark):
    space = spark.createDataFrame([(f"c{k}",) for k in range(7)] + [("c0",)], "code string")
    q = spark.range(300).withColumnRenamed("id", "qid")
    got = {}
    for r in sampling.without_replacement(q, space, 3, 1).collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.code
    assert len(got) == 300 and all(sorted(x) == [1, 2, 3] and len(set(x.values())) == 3 for x in got.values())
    counts = {c: sum(c in x.values() for x in got.values()) for c in {c for x in got.values() for c in x.values()}}
    assert len(counts) == 7 and 90 < min(counts.values()) and max(counts.values()) < 170
    assert sampling.without_replacement(q.limit(2), space.limit(2), 5, 1).count() == 4 and sampling.without_replacement(q, space.limit(0), 5, 1).count() == 0


def test_postings_count_each_word(spark):
    from quarry.streaming import incremental

    docs = spark.createDataFrame([(1, "wind solar wind day hydro wind"), (2, None), (3, "a"), (4, "solo")], "d long, t string")
    got = {r.doc: ({t.term: t.tf for t in r.terms}, r.dl) for r in incremental.postings(docs, "d", "t").collect()}
    assert got == {1: ({"wind": 3, "solar": 1, "hydro": 1}, 5), 2: ({}, 0), 3: ({}, 0), 4: ({"solo": 1}, 1)}

"""Paths through typed edges."""

from quarry.operators import graph
from quarry.operators.graph import Step

EDGES = [("b", "r", "a"), ("a", "r", "c"), ("c", "r", "b"), ("c", "r", "d"), ("c", "r", "d"), ("e", "r", "e"), (None, "r", "a"), ("a", "r", None), ("x", "t", "d"), ("y", "t", "a"), ("y", "t", "a"), ("z", "t", "none")]


def plain_reach(starts):
    out = {}
    for s in starts:
        level, depth, seen = {s}, 0, set()
        while level:
            out |= {(s, n): depth for n in level}
            seen |= level
            level = {d for a, k, d in EDGES if k == "r" and a in level and d is not None} - seen
            depth += 1
    return out


def test_reach_ends_on_cycles_and_finds_the_fewest_hops(spark):
    edges = spark.createDataFrame(EDGES, "src string, kind string, dst string")
    starts = ["a", "b", "e", "lonely", "a", None]
    hops = edges.where("kind = 'r'").selectExpr("src AS _from", "dst AS _to")
    got = graph.reach(spark.createDataFrame([(s,) for s in starts], "code string"), hops).collect()
    assert len(got) == len({(r.start, r.node) for r in got})
    assert {(r.start, r.node): r.depth for r in got} == plain_reach({s for s in starts if s})


def test_match_follows_every_path_once(spark):
    edges = spark.createDataFrame(EDGES, "src string, kind string, dst string")
    starts = spark.createDataFrame([("a",), ("e",), ("d",), (None,), ("a",)], "code string")
    got = graph.match(starts, edges, [Step("r", "via", any=True), Step("t", "text", back=True)]).collect()
    assert sorted(map(tuple, got)) == [("a", "a", "y"), ("a", "d", "x"), ("d", "d", "x")]
    assert sorted(map(tuple, graph.match(starts, edges, [Step("r", "next")]).collect())) == [("a", "c"), ("e", "e")]
    assert graph.match(starts.limit(0), edges, [Step("r", "via", any=True)]).count() == 0
    assert graph.match(starts, edges.limit(0), [Step("r", "via", any=True)]).count() == 3
    facts = spark.createDataFrame([("x", 3), ("w", 1)], "id string, cap int")
    told = graph.described(graph.match(starts, edges, [Step("r", "via", any=True), Step("t", "text", back=True)]), "text", facts, "id")
    assert graph.first_of(told, "code", ["cap", "text"]).select("code", "cap", "text", "via").orderBy("code").collect() == [("a", 3, "x", "d"), ("d", 3, "x", "d")]


def test_a_step_to_the_least_node_goes_on_once(spark):
    edges = spark.createDataFrame([*EDGES, *[(f"s{k}", "states", "hub") for k in range(9, 1, -1)], *[("hub", "applies", f"c{k}") for k in range(5)]], "src string, kind string, dst string")
    starts = spark.createDataFrame([(f"c{k}",) for k in range(5)], "code string")
    steps = lambda **x: [Step("applies", "threshold", back=True), Step("states", "document", back=True, **x)]
    least = graph.match(starts, edges, steps(least=True))
    assert sorted(map(tuple, least.collect())) == [(f"c{k}", "hub", "s2") for k in range(5)]
    every = graph.match(starts, edges, steps())
    assert every.count() == 40 and sorted(graph.first_of(every, "code", ["document"]).collect()) == sorted(graph.first_of(least, "code", ["document"]).collect())

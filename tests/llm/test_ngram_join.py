import re
import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import ngram_join as J
from quarry.llm.tables import components

WORD, LOW = re.compile(rb"[^\x20\x09-\x0D]+"), bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def brute(rows, n, percent):
    sets = {}
    for k, t in rows:
        w = WORD.findall((t or "").encode().translate(LOW))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * x >= percent * (len(sets[a]) + len(sets[b]) - x):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: (len(s), find(k)) for k, s in sets.items()}


@pytest.mark.parametrize("small,block", [(32, 512), (2, 3)])
def test_components_equal_brute_force(spark, tables, corpus, documents, monkeypatch, small, block):
    monkeypatch.setattr(J, "SMALL_BUCKET", small)
    monkeypatch.setattr(J, "BLOCK", block)
    folder = tables("join", documents=documents)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.op1_ngram_join(spark, folder).collect()}
    assert got == brute(corpus, 4, 85)


def test_five_words_at_eighty(spark, corpus, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(documents.repartition(7)).collect()}
    assert got == brute(corpus, 5, 80)


@pytest.mark.parametrize("bits", [1, 5])
def test_sets_that_share_a_name_stay_apart(spark, corpus, documents, bits):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(documents, name_bits=bits).collect()}
    assert got == brute(corpus, 5, 80)


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert J.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "q r s t u v")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(None, 2, 4), (4, 2, 4), (4, 2, 4), (None, 2, None)], key=str)


def test_tree_links_equal_plain_intersections():
    r = random.Random(3)
    for _ in range(200):
        probe = np.unique(np.array([r.randrange(60) for _ in range(30)], np.uint64))
        sets = [np.unique(np.array([r.randrange(60) for _ in range(r.randint(1, 40))] + probe[: r.randint(0, len(probe))].tolist(), np.uint64)) for _ in range(20)]
        want = []
        for k, s in enumerate(sets):
            x = len(np.intersect1d(probe, s))
            if 100 * x >= 60 * (len(probe) + len(s) - x):
                want.append(k)
        assert sorted(J.tree_links(probe, sets, 60)) == want


def test_parity_bitmaps_bound_the_difference():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 1 << 63, 700).astype(np.uint64))
    b = np.unique(np.concatenate([a[:650], r.integers(0, 1 << 63, 40).astype(np.uint64)]))
    x, y = (np.array(v.as_py(), np.int64) for v in J._parity(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])))
    assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))


def test_a_bucket_with_a_much_repeated_node_is_large_to_its_end():
    nodes = np.concatenate([np.arange(300), np.full((1 << 18) + 5, 300), np.arange(301, 306)])
    names = ["token", "n", "node", "leads"]
    parts = (nodes[: (1 << 18) + 303], nodes[(1 << 18) + 303 :])
    batches = [pa.RecordBatch.from_arrays([pa.array(np.full(len(x), 9)), pa.array(np.full(len(x), 40, np.int32)), pa.array(x), pa.array(np.ones(len(x), bool))], names=names) for x in parts]
    out = pa.Table.from_batches(list(J._Bucketed(85)(iter(batches)))).to_pydict()
    assert sorted(a for k, a in zip(out["kind"], out["a"], strict=True) if k == 1) == list(range(306))


def test_components_of_chains(spark):
    rows = [(k, k + 1) for k in range(40)] + [(100, 102), (102, 101), (None, 5), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}


def _joined_rows(spark, since):
    """Rows that the joins of the queries from number ``since`` on have made."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    for k in range(since, store.executionsCount()):
        run = store.executionsList().apply(k).executionId()
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (nodes.apply(j) for j in range(nodes.size())):
            for m in (node.metrics().apply(j) for j in range(node.metrics().size())):
                if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return total


def _group(size, seed):
    """A group as a large bucket gives it: a pivot, a chain and some pairs more."""
    r = random.Random(seed)
    ids = r.sample(range(10 * size), size)
    return [(ids[0], x) for x in ids[1:]] + list(zip(ids, ids[1:], strict=False)) + [tuple(r.sample(ids, 2)) for _ in range(size)], min(ids)


def test_components_meet_settled_edges_no_more(spark):
    for size in (400, 1600):
        edges, least = _group(size, size)
        frame = spark.createDataFrame(edges, "a long, b long")
        count = spark._jsparkSession.sharedState().statusStore().executionsCount
        before = count()
        known = components(frame)
        assert {r.component for r in known.collect()} == {least}
        assert _joined_rows(spark, before) < 5 * len(edges)
        before = count()
        more = components(spark.createDataFrame([(edges[0][0], 10 * size), (10 * size, 10 * size + 1)], "a long, b long"), known)
        assert {r.component for r in more.collect()} == {least}
        assert _joined_rows(spark, before) < 2 * size


def test_components_go_on_from_known_ones(spark):
    r = random.Random(5)
    for _ in range(3):
        one, two = ([(r.randrange(120), r.randrange(120)) for _ in range(n)] for n in (60, 40))
        first, more = (spark.createDataFrame([*x, (None, 3), (4, 4)], "a long, b long") for x in (one, two))
        want = {x.node: x.component for x in components(first.union(more)).collect()}
        assert {x.node: x.component for x in components(more, components(first)).collect()} == want
        assert all(want[a] == want[b] for a, b in one + two if a != b) and all(c <= n for n, c in want.items())


@pytest.mark.parametrize("percent", [70, 80])
def test_large_buckets_of_many_sizes(spark, monkeypatch, percent):
    r, used = random.Random(11), []
    across = J._across
    monkeypatch.setattr(J, "BLOCK", 5)
    monkeypatch.setattr(J, "_across", lambda *a: used.append(a) or across(*a))
    rows = []
    for group in range(90):
        own = [f"w{group}x{k}" for k in range(r.randint(1, 4))]
        for _ in range(3):
            tail = own[: r.randint(1, len(own))]
            if r.random() < 0.5:
                tail[-1] = f"v{r.randrange(10**6)}"
            rows.append((len(rows), " ".join([f"s{k}" for k in range(10)] + tail)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()}
    assert used and got == brute(rows, 5, percent)


def test_sizes_that_may_link_share_a_home(spark):
    n = np.arange(1, 1200)
    cells = {x.n: [tuple(c) for c in x.cells] for x in spark.createDataFrame([(int(k),) for k in n], "n int").select("n", J._cells(85, "n").alias("cells")).collect()}
    for a in range(1, 1000):
        for b in (a, min(a * 100 // 85, 1199)):
            homes = [c for c, home in cells[a] + cells[b] if home]
            assert any(c in homes for c in {c for c, _ in cells[a]} & {c for c, _ in cells[b]})


@pytest.mark.parametrize("longer", [0, 60])
def test_a_block_gives_every_pair_that_links(longer):
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 2000 + longer).astype(np.uint64)  # bitmaps of 1,024 bits, and of 2,048 from 2,049 shingles on
    sets = [np.unique(np.concatenate([np.delete(base, r.choice(len(base), r.integers(60, 100), replace=False)), r.integers(0, 1 << 63, r.integers(40, 60 + longer)).astype(np.uint64)])) for _ in range(40)]
    bits = J._parity(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    assert len({len(x) for x in bits}) == (2 if longer else 1)
    n = len(sets)
    same, nodes = [pa.array(np.zeros(n, np.int32))] * 5, pa.array(np.arange(n))
    columns = [*same, pa.array(np.ones(n, bool)), pa.array(np.array([len(s) for s in sets], np.int32)), nodes, nodes, bits]
    block = pa.RecordBatch.from_arrays(columns, names=["token", "cell", "i", "j", "own", "home", "n", "node", "component", "bits"])
    got = {p for out in J._across(85, False)(iter([block])) for p in zip(*out.to_pydict().values(), strict=True)}
    shared = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a in range(n) for b in range(a + 1, n)}
    linked = {(a, b) for (a, b), x in shared.items() if 100 * x >= 85 * (len(sets[a]) + len(sets[b]) - x)}
    assert linked and linked <= got

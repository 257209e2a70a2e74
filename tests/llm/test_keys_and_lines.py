"""Target encoding and line dedup on small odd tables against plain Python, with trees and shards so small that all their parts are used."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from quarry.llm import line_dedup, target_encoding

FOLD = lambda sale: zlib.crc32(str(sale).encode()) % 5


def shop(seed):
    r = random.Random(seed)
    sales = [(s, r.choice([None, 1, 1, 2, 3]), None if r.random() < 0.1 else r.choice([0, 0, r.randrange(2000)])) for s in range(150)]
    lines = [(r.choice([r.randrange(160), 7, 7]), r.choice([None, 1, 1, 2, 3, 9]), r.choice([None, 4, 5]), r.choice(["returned", "kept", None])) for _ in range(700)]
    items, vendors, clients = [(1, "a"), (2, "a"), (3, None), (8, "b")], [(4, 10), (5, None)], [(1, "s"), (2, "t"), (-1, "s")]
    return lines + lines[:20] + [(None, 1, 4, "returned")], sales, items, vendors, clients


def encoded(lines, sales, items, vendors, clients):
    at = {s: (c if c is not None else -1, t) for s, c, t in sales if t is not None}
    kind, nation, segment = dict(items), dict(vendors), dict(clients)
    rows = []
    for sale, item, vendor, flag in lines:
        if sale in at:
            client, t = at[sale]
            item = -1 if item is None else item
            rows.append((sale, item, vendor, client, t, kind.get(item), nation.get(vendor), segment.get(client), flag == "returned"))
    out = {}
    for x in rows:
        past = [y for y in rows if y[4] < x[4] and FOLD(y[0]) != FOLD(x[0])]

        def rate(prior, k=None, past=past, x=x):
            own = [y for y in past if k is None or y[k] == x[k]]
            return len(own), (1_000_000 * sum(y[8] for y in own) + 50 * prior) // (len(own) + 50) if own else prior

        whole = rate(500_000)[1]
        known = [rate(rate(whole, group)[1], key) for key, group in ((1, 5), (2, 6), (3, 7))]
        same = [y for y in rows if y[:3] == x[:3]]
        out[x[:3]] = (len(same), sum(y[8] for y in same), *(v for pair in known for v in pair))
    return out


@pytest.mark.parametrize(("leaf", "bits"), [(1, 0), (1, 3), (64, 12)])
def test_encoding(spark, monkeypatch, leaf, bits):
    monkeypatch.setattr(target_encoding, "COPY_BITS", bits)
    lines, sales, items, vendors, clients = shop(leaf + bits)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    sold = frame(sales, "sale_id long, client_id long, s long").selectExpr("sale_id", "client_id", "timestamp_seconds(1704067200 + s) AS sold_at", "'x' AS kind", "1 AS n")
    found = target_encoding.encode(
        frame(lines, "sale_id long, item_id long, vendor_id long, flag string").selectExpr("*", "1 AS at", "2 AS fold"), sold,
        frame(items, "item_id long, kind string"), frame(vendors, "vendor_id long, nation_id int"), frame(clients, "client_id long, segment string"), leaf=leaf,
    )
    got = {tuple(r)[:3]: tuple(r)[3:] for r in found.collect()}
    assert got == encoded(lines, sales, items, vendors, clients)


def test_encoding_of_empty_tables(spark):
    schemas = ("sale_id long, item_id long, vendor_id long, flag string", "sale_id long, client_id long, sold_at timestamp", "item_id long, kind string", "vendor_id long, nation_id int", "client_id long, segment string")
    assert target_encoding.encode(*(spark.createDataFrame([], x) for x in schemas)).count() == 0


def deduped(rows, points, documents):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = collections.defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= points:
                holders[key(line)].add(-1 if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        own = -1 if doc is None else doc
        stay = [x for x in lines if not (len(key(x)) >= points and len(holders[key(x)]) >= documents and max(holders[key(x)]) != own)]
        out.append((doc, text, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return collections.Counter(out)


@pytest.mark.parametrize(("shard", "probe"), [(1 << 17, 1 << 19), (8, 3)])
def test_line_dedup(spark, shard, probe):
    r = random.Random(3)
    shared = [f"{'Shared' if k % 2 else 'sháred ü'} line number {k} " + "z" * k for k in range(40)]
    texts = ["\n".join(r.choice([f"  {r.choice(shared)}\t", r.choice(shared).upper(), f"own {r.random()}", "", " "]) for _ in range(r.randint(1, 30))) for _ in range(80)]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(3, texts[3]), (3, texts[4]), (None, texts[5]), (None, None), (200, None), (201, ""), (202, "\n"), (203, "é" * 50_000 + "\n" + shared[30]), (204, "a\n" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS kept", "1 AS name", "2 AS box", "3 AS doc", "4 AS n_lines")
    found = line_dedup.dedup(df, points=20, documents=5, shard_lines=shard, probe_rows=probe)
    assert found.columns == ["doc_id", "text", "name", "box", "doc", "n_lines", "n_dropped", "kept"]
    got = collections.Counter((x.doc_id, x.text, x.n_lines, x.n_dropped, x.kept) for x in found.collect())
    assert got == deduped(rows, 20, 5)
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_perfect_hash():
    r = np.random.default_rng(1)
    names = r.integers(0, 1 << 63, 50_000).astype(np.uint64)
    names[1] = names[0]  # one name, two checks
    checks = r.integers(0, 1 << 63, 50_000).astype(np.uint64)
    whole = line_dedup.PerfectHash.of(names, checks)
    assert sorted(whole.find(names, checks)) == list(range(50_000))
    assert whole.words.nbytes * 8 < 5 * 50_000

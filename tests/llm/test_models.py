"""Classifier, language models, fingerprints, URL filter and pipeline."""

import hashlib
import math
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import fingerprints as P
from quarry.llm import lm_score, quality, urls

SF = "/root/testdata/sf0.01"


def test_quality_held_out_accuracy(spark):
    got = quality.op8_quality(spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == r.quality for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_without_labels_and_odd_texts(spark, documents):
    none = quality.fit(documents, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score(documents, none).collect()} == {0.5}
    one = quality.fit(documents, spark.createDataFrame([(k, 1) for k in range(9)], "doc_id long, quality int"))
    assert {r.score for r in quality.score(documents, one).collect()} == {1.0}
    two = quality.fit(documents, spark.createDataFrame([(k, k % 2) for k in range(60)] + [(3, None)], "doc_id long, quality int"))
    got = quality.score(documents, two)
    assert got.count() == documents.count() and got.where("score IS NULL OR isnan(score)").count() == 0 and "component_id" in got.columns
    assert quality.score(documents.limit(0), two).count() == 0


def test_tokens_mark_capitals_and_repeats():
    data = np.frombuffer(b"AB cd cd cd cd cd %%", np.uint8)
    bucket, bounds = quality.tokens(data, np.array([0, len(data)]))
    assert bucket[0] == quality._CAPITALS and (bucket[2:6] == quality._AGAIN).all() and 2 <= bucket[-1] < 258 and bounds.tolist() == [0, 7]


def test_language_model_prefers_its_own(spark, documents):
    docs = spark.createDataFrame([(k, ("abab baba " if k % 2 else "xyzx zyzy ") * (k % 7 + 3)) for k in range(40)] + [(90, None), (91, "")], "doc_id long, text string")
    target = spark.createDataFrame([(k,) for k in range(1, 40, 2)], "doc_id long")
    got = {r.doc_id: r for r in lm_score.score(docs, target).collect()}
    assert max(got[k].score for k in range(1, 40, 2)) < min(got[k].score for k in range(0, 40, 2))
    assert (got[90].n_tokens, got[90].score, got[91].score) == (0, 0, 0)
    assert all(abs(r.score - (r.target_loss - r.background_loss)) < 2e-6 for r in got.values())
    again = {r.doc_id: r.score for r in lm_score.score(docs.repartition(5), target.union(target)).collect()}
    assert again == {k: r.score for k, r in got.items()}
    clash = documents.withColumns({"box": F.lit("b"), "target": F.lit("t"), "chunk": F.lit(1), "id": F.lit("i")})
    out = lm_score.score(clash, target.limit(0))
    assert out.count() == documents.count() and {(r.box, r.target, r.chunk, r.id, r.component_id) for r in out.collect()} == {("b", "t", 1, "i", "clash")}
    assert out.columns == [c for c in clash.columns if c != "score"] + ["n_tokens", "target_loss", "background_loss", "score"]
    assert lm_score.score(documents.limit(0), target).count() == 0


def plain_losses(texts, marked, order):
    """Mean losses of each text under (target, background), counted and estimated word by word."""
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))) for t in texts]
    count = [Counter(), Counter()]
    for k, w in enumerate(words):
        for n in range(1, order + 1):
            for i in range(len(w) - n + 1):
                for m in (0, 1) if k in marked else (0,):
                    count[m][tuple(w[i : i + n])] += 1
    vocabulary = len({x for w in words for x in w})
    total = [sum(c for g, c in x.items() if len(g) == 1) for x in count]
    share = (min(1, total[1] / total[0]) if total[0] and total[1] else 1, 1)
    out = []
    for w in words:
        row = []
        for m in (1, 0):
            bits = 0.0
            for i in range(len(w)):
                p = (share[m] * count[m][(w[i],)] + lm_score.PSEUDO / vocabulary) / (share[m] * total[m] + lm_score.PSEUDO)
                for n in range(2, min(order, i + 1) + 1):
                    p = (share[m] * count[m][tuple(w[i - n + 1 : i + 1])] + lm_score.PSEUDO * p) / (share[m] * count[m][tuple(w[i - n + 1 : i])] + lm_score.PSEUDO)
                bits -= math.log2(p)
            row.append(bits / max(len(w), 1))
        out.append((len(w), *row))
    return out


@pytest.mark.parametrize(("order", "chunk"), [(1, 1 << 23), (2, 2000), (3, 5000)])
def test_language_model_against_plain_counts(spark, corpus, documents, monkeypatch, order, chunk):
    monkeypatch.setattr(lm_score, "_CHUNK", chunk)
    marked = {k for k, _ in corpus if k % 3 == 0}
    target = spark.createDataFrame([(k,) for k in [*marked, 10**9]] + [(None,)], "doc_id long")
    docs = documents.unionByName(documents.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    got = lm_score.score(docs, target, order=order).collect()
    want = plain_losses([t for _, t in corpus] + [corpus[4][1]], marked, order)
    for r in got:
        n, one, two = want[-1 if r.doc_id is None else r.doc_id]
        assert r.n_tokens == n and np.allclose([r.target_loss, r.background_loss], [one, two], atol=2e-6)


@pytest.fixture(scope="module")
def fingered(spark, tables, documents):
    folder = tables("fingers", documents=documents)
    return {r.doc_id: r for r in P.op10_fingerprints(spark, folder).collect()}


def test_fingerprints(fingered, corpus):
    texts = [t or "" for _, t in corpus]
    by_text = {}
    for k, t in enumerate(texts):
        n, following = len(t), texts[(k + 1) % len(texts)]
        e = t[: n - n // 2] + following[: n // 2]
        r = fingered[k]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(e.encode()).hexdigest())
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert by_text.setdefault(e, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        a, b = P.parse(r.fingerprint), P.parse(fingered[(k + 1) % len(texts)].fingerprint)
        assert abs(P.likeness(a, b) - r.near_next) < 1e-6 and abs(P.likeness(b, a) - r.near_next) < 1e-6
    assert P.likeness(P.parse(fingered[0].fingerprint), P.parse(fingered[0].fingerprint)) == 1


def test_fingerprints_over_many_parts(spark, fingered, documents, monkeypatch):
    monkeypatch.setattr(P, "_ROWS_A_PART", 9)
    got = {r.doc_id: (r.fingerprint, r.edited_fingerprint, round(r.near_next, 6)) for r in P.fingerprints(documents.repartition(5)).collect()}
    assert got == {k: (r.fingerprint, r.edited_fingerprint, r.near_next) for k, r in fingered.items()}


def test_fingerprints_of_one_and_none(spark):
    one = P.fingerprints(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert one[0].edited_text == "abab" and one[0].near_next == 1
    assert P.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    nulls = P.fingerprints(spark.createDataFrame([(None, "zz"), (1, "yy"), (1, "yy")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.edited_text) for r in nulls) == [("1", "yy"), ("1", "yz"), ("None", "zy")]


def test_fingerprints_read_texts_without_spaces_whole(spark):
    r = np.random.default_rng(3)
    run = lambda n: "".join(map(chr, r.integers(0x4E00, 0x9000, n)))
    a, b, long = run(3400), run(3400), run(2000)
    a, b = "x" * 64 + a, "x" * 64 + b
    words = " ".join(run(2) for _ in range(300))
    shorts = ["y" * 64 + "".join(map(chr, r.integers(97, 123, 60))) for _ in range(2)]
    rows = [a, b, "z" * 64 + " " + words, words + " " + long, words + " " + run(2000), *shorts, "x " * 300, "v " * 300]
    got = {k.doc_id: k for k in P.fingerprints(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got[0].near_next < 0.2 and 0.05 < got[0].near_edited < 0.9
    assert got[3].near_next < 0.9 and got[5].near_next < 0.9 and got[7].near_next < 0.2
    assert all(len(P.parse(k.fingerprint)) for k in got.values())
    shifted = P.digests([a.encode(), ("q" + a).encode()], np.arange(P.RANKS))
    assert P.likeness(*shifted) > 0.9


def test_fingerprint_windows_cover_all_bytes():
    r = np.random.default_rng(5)
    for n in (1, 63, 64, 65, 90, 1000, 3000):
        for high in (33, 34, 60, 256):
            texts = [r.integers(low, high, n).astype(np.uint8) for low in (0, 32)]
            start, text, _ = P.windows(np.concatenate(texts), np.array([0, n, 2 * n]))
            seen = np.zeros(2 * n + 1, int)
            np.add.at(seen, start, 1)
            np.add.at(seen, np.minimum(start + P.WINDOW, (text + 1) * n), -1)
            assert (np.cumsum(seen)[:-1] > 0).all()


def plain_features(data, rank):
    """Starts of features of a text of short words: leaders of neighbourhoods, by their definition."""
    size = P.WINDOW
    starts = {i for i in range(len(data)) if i == 0 or data[i] > 32 >= data[i - 1]} | ({len(data) - size} if len(data) >= size else set())
    starts = sorted(i for i in starts if i + size <= len(data) or i == 0)
    found, _, classes = P.windows(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert found.tolist() == starts
    sort = lambda b: chr(b).lower() if chr(b) in string.ascii_letters else "space" if b < 33 else "digit" if 48 <= b < 58 else "sign" if b < 127 else b % 3
    for i, c in zip(starts, classes, strict=True):
        counts = Counter(sort(b) for b in data[i : i + size])
        assert abs(sum(v / size * math.log2(size / v) for v in counts.values()) * P.RANKS / 5 - c) <= 1.01
    keys = [(rank[c], i) for i, c in zip(starts, classes, strict=True)]
    near = min(1 + len(keys) // P.GROWTH, P.NEAR)
    return sorted({min(keys[k : k + near])[1] for k in range(len(keys) - near + 1)})


def plain_filters(data, rank):
    """Sets of bits, FULL distinct features a set."""
    seen = list(dict.fromkeys(data[i : i + P.WINDOW] for i in plain_features(data, rank)))
    out = []
    for k, window in enumerate(seen):
        named = (sum(int(P._BYTE_VALUES[b]) * int(P._BYTE_POWERS.get(len(data) + 1)[0][j]) for j, b in enumerate(window)) + len(window)) % (1 << 64)
        h = int(P.mix(np.array([named], np.uint64))[0])
        if k % P.FULL == 0:
            out.append(set())
        out[-1] |= {h >> 11 * j & P.BITS - 1 for j in range(P.HASHES)}
    return out


def plain_likeness(a, b):
    def one(x, y):
        chance = len(x) * len(y) / P.BITS
        floor = chance + P.NOISE * math.sqrt(chance * (1 - len(x) / P.BITS) * (1 - len(y) / P.BITS))
        return min(max((len(x & y) - floor) / max(min(len(x), len(y)) - floor, 1e-9), 0), 1)

    short, long = sorted((a, b), key=len)
    if not short:
        return float(not long)
    return 1.0 if a == b else sum(max(one(x, y) for y in long) for x in short) / len(short)


def test_digests_against_their_definition():
    r = np.random.default_rng(9)
    words = ["".join(chr(c) for c in r.choice([*range(97, 123), 65, 48, 44, 233], r.integers(1, 9))) for _ in range(900)]
    texts = [" ".join(r.choice(words, n)) for n in (1, 3, 9, 15, 17, 40, 63, 64, 65, 120, 400, 3000)]
    texts = [x for t in texts for x in (t, t[: len(t) // 2] + t[: len(t) // 3])] + ["", "aa " * 500, texts[5]]
    data = [t.encode() for t in texts]
    rank = r.permutation(P.RANKS)
    got, want = P.digests(data, rank), [plain_filters(d, rank) for d in data]
    for g, w in zip(got, want, strict=True):
        assert [set(np.flatnonzero(row)) for row in np.unpackbits(g, axis=1)] == w
    assert max(len(w) for w in want) > 1
    for i in range(len(data)):
        for j in range(max(0, i - 4), i + 1):
            if len(want[i]) != len(want[j]) or len(want[i]) < 2:  # chains of one length go either way round
                assert abs(P.likeness(got[i], got[j]) - plain_likeness(want[i], want[j])) < 1e-5


def test_half_edited_texts_are_told_from_others(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("text").collect()]
    got = {r.doc_id: r for r in P.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    classes = {}
    for k, t in enumerate(texts):
        n = len(t.split())
        if n >= 20:
            classes.setdefault(min(int(math.log2(n / 20)), 6), []).append(got[k].near_edited > got[k].near_next)
    assert len(classes) > 3 and all(np.mean(c) >= 0.9 for c in classes.values())


def host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def test_urls(spark):
    rows = [None, "", "no scheme", "http://", "https://A.Example.COM/en/7x?q#f", "http://example.com/en/8", "http://example.com/en/71", "http://notexample.com/en/7", "http://x.net/de/1", "http://b.example.net/de/8", "http://example.net/de/9", "ftp://o.org/es/", "http://org/es/1", "http://c.com#en/", "http://É.com/en/", "a://b://c/d", "http://h.com/a/b/c/d/e/f"] * 2
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(rows)], "page_id long, url string").withColumn("verdict", F.lit("clash"))
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    for k, u in enumerate(rows):
        h, p = host_path(u)
        fits = [r for r in urls.RULES if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        assert (got[k].host, got[k].path, got[k].rule) == (h, p, best.name if best else None), u
        assert got[k].verdict == best.verdict if best else got[k].verdict in ("allow", "block")
    assert urls.judge(pages.limit(0)).count() == 0


def test_url_tree_rejects_blocked_templates(spark):
    rows = [f"http://bad.com/en/{k}" for k in range(30)] + [f"http://good.net/de/{k}" for k in range(30)] + ["http://bad.com/fr/1", "http://good.net/fr/1"]
    got = {r.url: r.verdict for r in urls.judge(spark.createDataFrame([(k, u) for k, u in enumerate(rows)], "page_id long, url string")).collect()}
    assert got["http://bad.com/fr/1"] == "block" and got["http://good.net/fr/1"] == "allow"


def plain_tree(rows):
    """Template and purity of each (host, path, blocked or not or None), by recursion over nested lists."""
    shape = lambda p: tuple(re.sub("[0-9]+", "{n}", s) for s in p.split("/") if s)
    template = {}

    def walk(host, prefix, inside, level):
        children = {}
        for k in inside:
            s = shape(rows[k][1])
            if len(s) == level:
                template[k] = prefix
            else:
                children.setdefault(s[level], []).append(k)
        label = lambda ks: (sum(rows[k][2] is not None for k in ks), sum(bool(rows[k][2]) for k in ks))
        every = [k for ks in children.values() for k in ks]
        all_l, all_b = label(every)
        names = {}
        for c, ks in children.items():
            n, b = label(ks)
            rest, rest_b = all_l - n, all_b - b
            stays = len(children) == 1
            if n and rest:
                pooled = (all_b + 1) / (all_l + 2)
                stays |= abs(b / n - rest_b / rest) > urls.APART * math.sqrt(pooled * (1 - pooled) * (1 / n + 1 / rest))
            else:
                stays |= not (len(children) > urls.CHILDREN and len(ks) < urls.SHARE * len(every))
            names.setdefault(c if stays else "*", []).extend(ks)
        for name, ks in names.items():
            walk(host, f"{prefix}/{name}", ks, level + 1)

    hosts = {}
    for k, r in enumerate(rows):
        hosts.setdefault(r[0], []).append(k)
    for host, inside in hosts.items():
        walk(host, "", inside, 0)
    label = lambda ks: (sum(rows[k][2] is not None for k in ks), sum(bool(rows[k][2]) for k in ks))
    l, b = label(range(len(rows)))
    base = b / max(l, 1)
    purity = {}
    for host, inside in hosts.items():
        host_l, host_b = label(inside)
        own = (host_b + urls.SMOOTH * base) / (host_l + urls.SMOOTH)
        for t in {template[k] for k in inside}:
            n, c = label([k for k in inside if template[k] == t])
            purity[host, t] = ((c + urls.SMOOTH * own) / (n + urls.SMOOTH), host_l)
    return [(template[k], *purity[rows[k][0], template[k]]) for k in range(len(rows))]


def test_url_tree_against_recursion(spark):
    r = np.random.default_rng(5)
    paths = ["en/{}", "de/{}", "fr/{}/x", "a/b/c/d/e/{}", "a/b/c/d/f/{}", "", "w{}z/y"]
    made = [f"http://{h}/{paths[r.integers(len(paths))].format(r.integers(50))}" for h in ("a.com", "b.net", "c.org", "none") for _ in range(70)]
    made += [f"http://a.com/u{chr(97 + k % 26) * (k // 26 + 1)}/x" for k in range(60)] + ["http:///", "no"]
    rules = (urls.Rule("block", "com", "/en/"), urls.Rule("allow", "a.com", "/de/"), urls.Rule("block", "a.com", "/a/b/c/d/e/"), urls.Rule("allow", "a.com", "/a/b/c/d/f/1"), urls.Rule("allow", "net", "/de/"), urls.Rule("block", "org", "/uc"))
    got = {x.page_id: x for x in urls.judge(spark.createDataFrame(list(enumerate(made)), "page_id long, url string").selectExpr("*", "'s' AS _shape", "1 AS box", "2 AS _verdict"), rules=rules).collect()}
    marked = [(got[k].host, got[k].path, None if got[k].rule is None else got[k].verdict == "block") for k in range(len(made))]
    assert {x.template.count("/") for x in got.values()} >= {0, 2, 6}
    for k, (template, purity, labels) in enumerate(plain_tree(marked)):
        assert got[k].template == template and abs(got[k].purity - purity) < 1e-8 and (got[k]._shape, got[k].box, got[k]._verdict) == ("s", 1, 2)
        if got[k].rule is None:
            assert got[k].verdict == ("block" if labels and round(purity, 9) > 0.5 else "allow")


def test_url_rounds_follow_forks_not_depth(spark):
    def jobs(depth):
        deep = "/".join(chr(97 + k % 26) * (1 + k % 3) for k in range(depth))
        made = [f"http://com/{deep}", f"http://com/{deep[: len(deep) // 2]}", "http://com/en/1", "http://com/fr/1", "http://x.org/es/1", "http://x.org/es/1"]
        spark.sparkContext.setJobGroup(f"depth{depth}", "")
        got = {(r.page_id, r.url): (r.host, r.path, r.template, r.purity, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(list(enumerate(made)), "page_id long, url string")).collect()}
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        rows = [(host, path, None if rule is None else verdict == "block") for host, path, _, _, rule, verdict in got.values()]
        assert all((t, round(p, 9)) == (g[2], g[3]) for (t, p, _), g in zip(plain_tree(rows), got.values(), strict=True))
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"depth{depth}"))

    assert jobs(400) <= jobs(6) + 3
    long = "http://com/" + "/".join(["s", "t"] * 1000)
    assert urls.judge(spark.createDataFrame([(1, long), (2, None), (2, None)], "page_id long, url string")).where("template LIKE '/s/t/%'").count() == 1


def test_pipeline_stages(spark, corpus, documents, tables):
    import corpus_pipeline as C
    from test_ngram_join import brute

    docs = documents.drop("score", "component_id")
    bench = spark.createDataFrame([(1, " ".join(corpus[5][1].split()[20:60]))], "item_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(9)], "doc_id long, quality int")
    folder = tables("pipe", documents=docs, benchmark=bench, labels=labels)
    at = docs
    for name, stage in C.STAGES:
        before, at = at, stage(spark, at, folder)
        if name != "packing":
            assert at.columns == docs.columns
        if name == "near_duplicates":
            own = brute([(r.doc_id, r.text) for r in before.collect()], 5, 80)
            assert {r.doc_id for r in at.collect()} == {k for k, (_, c) in own.items() if k == c}
        if name == "pii":
            assert at.count() == before.count()
    ids = {r.doc_id for r in at.collect()}
    assert 2 not in ids and 0 in ids
    assert {r.doc_id for r in C.run(spark, folder).collect()} == ids

"""Operators on words, tokens and spans against plain Python on small tables."""

import collections
import hashlib
import os
import random
import re
import zlib

import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from quarry.llm import decontaminate, licenses, packing, pii, substrings  # noqa: E402

PLAIN = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def folder(spark, tables, corpus, documents):
    items = [corpus[2][1].split()[20:60], corpus[2][1].split()[25:28], corpus[5][1].split()[20:40]]
    bench = [(k, " ".join(x)) for k, x in enumerate(items)] + [(7, None), (8, "!!"), (9, "nowhere to be found at all"), (1, bench_repeat(items))]
    labels = [(k, k % 2, 0) for k in range(60)]
    return tables("words", documents=documents, benchmark=spark.createDataFrame(bench, "item_id long, text string"), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def bench_repeat(items):
    return " ".join(items[1])


@pytest.mark.parametrize("rows", [20_000, 2])
def test_substrings(spark, folder, corpus, monkeypatch, rows):
    monkeypatch.setattr(substrings, "GROUP_ROWS", rows)
    got = {r.doc_id: tuple(r)[1:] for r in substrings.op4_substring_dedup(spark, folder).collect()}
    docs = {k: (t or "").encode().split() for k, t in corpus}
    seen = collections.Counter(tuple(w[i : i + 35]) for w in docs.values() for i in range(len(w) - 34))
    for k, w in docs.items():
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        left = b" ".join(x for i, x in enumerate(w) if i not in gone)
        assert got[k] == (len(w), len(gone), hashlib.sha256(left).hexdigest()), k


@pytest.mark.parametrize("block", [1_000_000, 5])
def test_decontamination(spark, folder, corpus, block):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = decontaminate.contamination(docs, bench, block_windows=block)
    assert {"score", "lang"} <= set(found.columns)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()}
    words = lambda t: ALNUM.findall((t or "").encode().translate(PLAIN))
    windows = {}
    for r in bench.collect():
        w = words(r.text)
        for i in range(max(1, len(w) - 12)) if w else []:
            windows.setdefault(tuple(w[i : i + 13]), set()).add(r.item_id)
    for k, t in corpus:
        w, hit, items = words(t), set(), set()
        for x, ids in windows.items():
            for i in range(len(w) - len(x) + 1):
                if tuple(w[i : i + len(x)]) == x:
                    hit.update(range(i, i + len(x)))
                    items |= ids
        digest = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        assert got[k] == (len(w), len(hit), len(items), digest, bool(hit) and 20 * len(hit) >= len(w)), k
    assert any(v[4] for v in got.values())


def test_decontamination_with_an_empty_benchmark(spark, documents):
    found = decontaminate.contamination(documents, spark.createDataFrame([], "item_id long, text string"))
    assert found.where("contaminated OR n_hit > 0 OR n_items > 0").count() == 0


def test_packing_is_an_exact_round_trip(spark, folder, corpus):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_paths()[0])
    rows = packing.pack(spark.read.parquet(f"{folder}/documents.parquet").repartition(3)).collect()
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for k, t in corpus:
        ids = b"".join(bytes(p.ids) for p in sorted(pieces[k], key=lambda p: p.start))
        want = whole.encode(t or "", add_special_tokens=False).ids + [1]
        assert ids == b"".join(x.to_bytes(4, "little") for x in want), k
        assert all(p.length * 4 == len(p.ids) and p.doc_tokens == len(want) for p in pieces[k])
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 2048 or (at < 2048 and at & (at - 1) == 0)


def test_packing_query_digests(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    whole = {(r.doc_id, r.start): zlib.crc32(bytes(r.ids)) for r in packing.pack(docs).collect()}
    assert {(r.doc_id, r.start): r.ids_crc32 for r in packing.op3_packing(spark, folder).collect()} == whole
    assert packing.pack(docs.limit(0)).count() == 0


def test_pieces_split_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    p, whole, r = packing._pieces(packing.default_paths()), Tokenizer.from_file(packing.default_paths()[0]), random.Random(1)
    signs = ["'", "s", "re", "ve", "ll", "t", " ", "  ", "\n", "\t", "é", "日", "5", "Ⅷ", "!", "...", "a", "THE", "'s", "😀", "d", "m", " '", "\u00a0", "\u0301"]
    for _ in range(100):
        texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 30))) for _ in range(20)]
        for ids, t in zip(p.encode(texts), texts, strict=True):
            assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_fill_has_the_least_slack():
    r = random.Random(4)
    for _ in range(300):
        room = r.randint(1, 60)
        counts = {r.randint(1, 40): r.randint(1, 4) for _ in range(r.randint(0, 5))}
        sums = {0}
        for x, c in counts.items():
            sums = {s + x * k for s in sums for k in range(c + 1) if s + x * k <= room}
        slack, used = packing.fill(counts, room)
        assert slack == room - max(sums) and sum(x * k for x, k in used.items()) == max(sums)
        assert all(k <= counts[x] for x, k in used.items())


BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def spans(t):
    out = []
    for kind, p in BASE:
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark, tables):
    r = random.Random(3)
    signs = list("0123456789") * 3 + [".", " ", "-", "+", "@", "a", "é", "😀", "(", ")", "x.y", "255", "300", "a@b.c", "_", "4111111111111111", "1.2.3.4", "\n", "%"]
    rows = [(i, "".join(r.choice(signs) for _ in range(r.randint(0, 60)))) for i in range(800)] + [(900, None), (901, ""), (902, "a@b.c " * 700), (903, "iban DE89 3704 0044 0532 0130 00 end"), (904, "GB00WEST12345698765432"), (905, "ssn 123-45-6789")]
    found = {x.doc_id: x for x in pii.op6_pii(spark, tables("pii", documents=spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for k, t in rows:
        want = spans(t or "")
        x = found[k]
        assert x.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(sum(s.startswith(f"{n}:") for s in want) for n, _ in BASE)
        assert x.spans.split(",")[: len(want)] == (want or x.spans.split(",")[:0])
    assert "iban:5:32" in found[903].spans and "iban" not in found[904].spans and "ssn:4:15" in found[905].spans


def test_masking_rebuilds_the_rest(spark):
    rows = spark.createDataFrame([(1, "é a@b.c and 1.2.3.4, bye"), (2, None), (3, "none")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.mask(pii.find(rows)).collect()}
    assert got == {1: "é [EMAIL] and [IP], bye", 2: None, 3: "none"}


def test_licences(spark):
    mit = licenses.TEMPLATES["mit"].split()
    changed = mit.copy()
    changed[10] = "anybody"
    rows = [(1, "x y. Released under the MIT License. z"), (2, "pre " * 40 + " ".join(changed) + " post" * 40), (3, "license the of mit"), (4, None), (5, "Licensed under CC BY-NC 4.0. " + "w " * 60 + "Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: [(x.name, x.start, x.end) for x in r.licences] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [x[0] for x in got[1]] == ["mit-line"] and rows[0][1].encode()[got[1][0][1] : got[1][0][2]] == b"Released under the MIT License"
    assert [x[0] for x in got[2]] == ["mit"] and got[3] == [] and got[4] == [] and [x[0] for x in got[5]] == ["cc-by-nc-4.0-line"] * 2


def test_licences_close_together(spark):
    line, mit = "Released under the MIT License.", licenses.TEMPLATES["mit"]
    changed = mit.split()
    changed[10] = "anybody"
    gap = " gap" * (len(mit.split()) // 3) + " "
    rows = [f"foo bar baz {line} {line} qux", "pre " * 200 + mit + gap + mit + " post" * 200, f"a {mit} {' '.join(changed)} {mit} b", " ".join([line] * 40), f"see the {line} or the {line} of", "x " * 9 + f"{mit}\n" * 5 + "y " * 9]
    got = {r.doc_id: r.licences for r in licenses.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [[x.name for x in got[k]] for k in range(6)] == [["mit-line"] * 2, ["mit"] * 2, ["mit"] * 3, ["mit-line"] * 40, ["mit-line"] * 2, ["mit"] * 5]
    for k, t in enumerate(rows):
        assert all(t[x.start : x.end].startswith(("Released", "Permission")) and t[x.start : x.end].endswith(("License", "Software")) for x in got[k])
        assert all(x.end <= y.start for x, y in zip(got[k], got[k][1:], strict=False))


def test_alignment_is_a_common_subsequence():
    r = random.Random(8)
    for _ in range(200):
        a, b = ([r.randrange(12) for _ in range(r.randint(0, 30))] for _ in range(2))
        m = licenses.align(a, b)
        assert all(a[x] == b[y] for x, y in m) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:], strict=False))
        same = [r.randrange(99) for _ in range(20)]
        assert len(licenses.align([1, 2, *same, 3], [4, *same])) == 20

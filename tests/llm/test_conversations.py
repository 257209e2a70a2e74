"""Conversation repair against a search over all edits, on damaged conversations and on odd ones."""

import hashlib
import heapq
import random
import zlib

import pytest

from quarry.llm import conversations

SPACES = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else str(x)
        fate = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out


def cheapest(rows):
    """Least (cost, labels) by a search over whole label strings; rows: (role, text, must_go, truncated)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, turns = heapq.heappop(heap)
        grammar = roles.removeprefix("s")
        if grammar != "ua" * (len(grammar) // 2) + "u" * (len(grammar) % 2):
            continue
        state = (i, roles[:1] == "s" and len(roles) == 1, len(grammar) % 2, roles == "")
        if state in done:
            continue
        done.add(state)
        if i == len(rows) and (roles == "" or (grammar and len(grammar) % 2 == 0)):
            return cost, audit, turns
        for x, role in (("u", "user"), ("a", "assistant")):
            heapq.heappush(heap, (cost + 3, audit + "I", i, roles + x, (*turns, (role, ""))))
        if i < len(rows):
            role, text, must_go, truncated = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles, turns))
            if not must_go:
                extra = 3 * truncated
                if role[:1] in ("s", "u", "a"):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, roles + role[:1], (*turns, (role, text))))
                for x, new in (("u", "user"), ("a", "assistant")):
                    heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, roles + x, (*turns, (new, text))))


def plain(rows, ids):
    out = {}
    for conv in ids:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
        known = [t for t, _, _ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        faults, seen, marked = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, role, text in own:
            ink = text.rstrip(SPACES)
            fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        cost, audit, turns = cheapest(marked)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest)
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    texts = ["Yes.", "No", "Why?", "", " \t", None, "So it is! ", "x " * 3000 + ".", "é…", "Yes."]
    roles = ["system", "user", "assistant", "user", "assistant", None, "", "tool", "unknown"]
    out = [(conv, r.choice([None, *range(9)]) if r.random() < 0.2 else k, r.choice(roles), r.choice(texts)) for conv in range(120) for k in range(r.randint(1, 8))]
    out += [(None, None, None, None), (None, 3, "user", "Hi."), (900, None, "user", "a."), (900, None, "user", "b."), (901, 5, "assistant", "Z."), (901, 5, "assistant", "Z.")]
    return out


def test_repair_equals_the_search(spark, tables, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS cost", "'x' AS policy", "text AS audit")
    folder = tables("talk", conversations=df)
    got = {r.conv_id: tuple(r)[1:] for r in conversations.op11_conversation_repair(spark, folder).collect()}
    want = plain(plain_damage(rows), {r[0] for r in rows})
    assert got.keys() == want.keys()
    for conv, x in want.items():
        assert got[conv] == x, conv


def test_edits_give_the_repaired_turns(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = conversations.repair(df)
    summary = {r.conv_id: r for r in found.summary().collect()}
    audits, turns = {}, {}
    for r in sorted(found.edits().collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.place)):
        audits[r.conv_id] = audits.get(r.conv_id, "") + r.edit
        if r.edit != "D":
            turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, row in summary.items():
        assert row.audit == audits.get(conv, "")
        assert row.repaired_sha256 == hashlib.sha256("\n".join(turns.get(conv, [])).encode()).hexdigest()


def test_a_long_conversation_and_an_empty_table(spark):
    df = spark.range(30_000).selectExpr("7L AS conv_id", "id AS turn", "IF(id % 3 = 0, 'user', 'assistant') AS role", "concat(id % 9000, '.') AS text")
    row = conversations.repair(df).summary().first()
    assert len(row.audit) >= 30_000 and row.duplicate > 0
    assert conversations.repair(df.limit(0)).summary().count() == 0

"""Embedding under a cap and within batch limits."""

import hashlib

import pytest

from quarry.operators import embed


def model(log):
    def transport(texts):
        with open(log, "a") as f:
            f.write(f"{len(texts)} {sum(-(-len(t) // 4) for t in texts)}\n")
        if any("broken" in t for t in texts):
            raise OSError("429")
        return [[float(len(t)), 1.0] for t in texts]

    return transport


@pytest.mark.parametrize("parts", [1, 7])
def test_cap_and_batches(spark, tmp_path, parts):
    rows = [(k, "x" * (k * 13 % 90)) for k in range(400)] + [(1000, None), (1001, ""), (1002, "y" * 1000)]
    df = spark.createDataFrame(rows, "i long, text string").repartition(parts)
    log = tmp_path / "log"
    got = {r.i: (r.vector, r.reason) for r in embed.embedded(df, "i", "text", model(str(log)), cap=3000, batch_tokens=60, batch_texts=9).collect()}
    total = 0
    for i, t in sorted(rows, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0])):
        n = -(-len(t or "") // 4)
        total += n
        want = (None, "empty") if not n else (None, "too long") if n > 60 else (None, "cap") if total > 3000 else ([float(len(t)), 1.0], None)
        assert got[i] == want, i
    sent = [tuple(map(int, x.split())) for x in log.read_text().split("\n") if x]
    assert max(n for n, _ in sent) <= 9 and max(t for _, t in sent) <= 60 and sum(t for _, t in sent) <= 3000


def test_failing_requests_are_tried_and_reported(spark, tmp_path):
    df = spark.createDataFrame([(1, "broken"), (1, "fine")], "i long, text string")
    log = tmp_path / "log"
    got = sorted((r.i, r.reason or "") for r in embed.embedded(df, "i", "text", model(str(log)), cap=100, batch_texts=1, wait=0).collect())
    assert got == [(1, ""), (1, "failed")] and log.read_text().count("\n") == embed.ATTEMPTS + 1
    assert embed.embedded(df.limit(0), "i", "text", model(str(log)), cap=100).count() == 0

"""The inverted-file index against exact nearest neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieve, vector_index

SF = "/root/testdata/sf0.1"


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.qid, []).append((r.rank, r.doc, round(r.score, 6)))
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


@pytest.fixture(scope="module")
def built(spark, vectors, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ivf"))
    model = vector_index.fit(vectors, "vec_id", "embedding", cells=32)
    model.save(spark, f"{path}/model")
    model = vector_index.Model.load(spark, f"{path}/model")
    return model, vector_index.build(vectors, model, "vec_id", "embedding", f"{path}/codes")


def test_recall_at_50(vectors, built):
    model, index = built
    asked = vectors.where("vec_id % 100 = 0")
    exact = found(retrieve.dense(asked, vectors, 50, "vec_id", "vec_id", "embedding"))
    near = found(vector_index.search(asked, index, model, vectors, 50, query="vec_id", id="vec_id", column="embedding", probes=26))
    assert exact.keys() == near.keys()
    hit = np.mean([len({d for d, _ in exact[q]} & {d for d, _ in near[q]}) / 50 for q in exact])
    assert hit >= 0.9, hit
    for q, rows in near.items():  # what is found has its exact score
        scores = dict(exact[q])
        assert all(scores.get(d, s) == s for d, s in rows)


def test_every_row_is_indexed_and_cells_are_pruned(vectors, built):
    _, index = built
    assert index.select("id").distinct().count() == vectors.count() == index.count()
    plan = index.where(F.col("cell").isin(3, 4)).select("codes")._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan and "ReadSchema: struct<codes:binary>" in plan


def test_all_cells_and_a_full_shortlist_are_exact(vectors, built, monkeypatch):
    monkeypatch.setattr(vector_index, "SHARE_ROWS", 50)
    monkeypatch.setattr(vector_index, "SHARE_QUERIES", 3)
    model, index = built
    asked = vectors.where("vec_id % 200 = 0")
    near = vector_index.search(asked, index, model, vectors, 20, query="vec_id", id="vec_id", column="embedding", probes=32, shortlist=2000)
    assert found(near) == found(retrieve.dense(asked, vectors, 20, "vec_id", "vec_id", "embedding"))


def test_copies_zeros_nulls_and_empty_tables(spark, tmp_path):
    rows = [(k, [1.0, 0.0, 0.0, 0.0]) for k in range(30)] + [(40, [0.0] * 4), (41, None), (42, [0.0, 1.0, 0.0, 1.0])]
    v = spark.createDataFrame(rows, "i long, v array<float>")
    model = vector_index.fit(v, "i", "v", cells=3, parts=2)
    index = vector_index.build(v, model, "i", "v", str(tmp_path / "a"))
    assert index.count() == 32
    near = found(vector_index.search(v.where("i IN (0, 40)"), index, model, v, 5, query="i", id="i", column="v", probes=3, shortlist=40))
    assert [d for d, _ in near[0]] == [0, 1, 2, 3, 4]
    assert all(s == 0 for _, s in near[40])
    none = v.limit(0)
    model = vector_index.fit(none, "i", "v", cells=3, parts=2)
    assert vector_index.search(none, vector_index.build(none, model, "i", "v", str(tmp_path / "b")), model, none, 5, query="i", id="i", column="v", probes=1).count() == 0

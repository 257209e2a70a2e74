"""Files by content: copies, rejects, empty files and an empty folder."""

from quarry.plans import page_queries
from quarry.sources import landed


def test_by_content(spark, tmp_path):
    files = {"b.pdf": b"%PDF x", "a.pdf": b"%PDF x", "c.html": b"tiny", "d.html": b"z" * 10_001, "e": b"", "f": b"%PD"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r["name"]: (r.status, r.kept_as, r.bytes) for r in landed.by_content(spark, str(tmp_path)).collect()}
    assert got == {
        "a.pdf": ("landed", "a.pdf", 6), "b.pdf": ("duplicate", "a.pdf", 6), "c.html": ("rejected", None, 4), "d.html": ("landed", "d.html", 10_001), "f": ("rejected", None, 3),
    }
    (tmp_path / "none").mkdir()
    assert landed.by_content(spark, str(tmp_path / "none")).count() == 0


def test_packed_downloads_have_the_manifest_of_their_files(spark, tmp_path):
    files = {"b": b"%PDF x", "a": b"%PDF x", "c": b"tiny", "d": b"z" * 10_001, "f": b"%PD", "g": "\u00e9\n".encode()}
    (tmp_path / "files").mkdir()
    for name, content in files.items():
        (tmp_path / "files" / name).write_bytes(content)
    landed.pack(spark.createDataFrame([*files.items(), ("e", b"")], "name string, content binary").coalesce(1), str(tmp_path / "packs"))
    assert len(list((tmp_path / "packs").glob("part-*"))) == 1
    got = landed.content_manifest(landed.packed(spark, str(tmp_path / "packs")))
    assert sorted(map(tuple, got.where("name <> 'e'").collect()), key=str) == sorted(map(tuple, landed.by_content(spark, str(tmp_path / "files")).collect()), key=str)
    assert [(r.status, r.bytes, r.kept_as) for r in got.where("name = 'e'").collect()] == [("rejected", 0, None)]


def test_landing_by_content_writes_few_files(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(k, f"<p>{k}</p>") for k in range(300)], "page_id long, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(landed, "folder", lambda _: f"{tmp_path}/landed")
    assert page_queries.landing_by_content(spark, str(tmp_path)).count() == 300
    assert len([p for p in (tmp_path / "landed").rglob("*") if p.is_file() and p.name.startswith("part-")]) < 10

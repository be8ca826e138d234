"""Sources, sinks and the stream, on files in a temporary folder."""

import json
import struct

from tamarack.sources import schemas, tables
from tamarack.streaming import ingest


def test_files(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset><url><loc> https://x/a </loc><lastmod>2025</lastmod></url><url><lastmod>1</lastmod></url><url><loc>b</loc></url></urlset>")
    assert [tuple(r) for r in tables.sitemap(spark, str(tmp_path / "s.xml")).collect()] == [("https://x/a", "2025"), ("b", None)]
    (tmp_path / "m.json").write_text(json.dumps({"u": {"lastmod": "1", "scrapedAt": "2", "status": "ok"}}))
    assert [tuple(r) for r in tables.manifest(spark, str(tmp_path / "m.json")).collect()] == [("u", "1", "2", "ok", None)]
    (tmp_path / "cards").mkdir()
    (tmp_path / "cards/a.json").write_text(json.dumps({"name": "A", "ingredients": [{"name": "x"}], "steps": [{"text": "y"}]}))
    (tmp_path / "cards/b.json").write_text(json.dumps({"name": " ", "ingredients": []}))
    good, bad = tables.staged_cards(spark, str(tmp_path / "cards"))
    assert [r.name for r in good.collect()] == ["A"] and bad.count() == 1


def test_snapshot_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    tables.snapshot({"t": df}, str(tmp_path))
    assert sorted(tables.restore(spark, str(tmp_path), ["t"])["t"].collect()) == sorted(df.collect())


def test_image_sizes(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 30, 20)
    gif = b"GIF89a" + struct.pack("<HH", 5, 6)
    df = spark.createDataFrame([(0, bytearray(png)), (1, bytearray(gif)), (2, bytearray(b"x")), (3, None)], "i int, content binary")
    out = [r.s for r in df.orderBy("i").select(tables.image_size("content").alias("s")).collect()]
    assert [(s.width, s.height) if s else (None, None) for s in out] == [(30, 20), (5, 6), (None, None), (None, None)]


def test_stream(spark, tmp_path):
    ld = '<script type="application/ld+json">{"@type":"Recipe","name":"N","recipeIngredient":["1 cup Milk"]}</script>'
    spark.createDataFrame([("https://x.example/recipes/a", "", ld), ("https://x.example/recipes/b", "", "")], ingest.PAGES).write.parquet(str(tmp_path / "in"))
    args = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):  # the second run finds nothing new
        ingest.run(spark, *args).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/recipes")).count() == 1
    assert spark.read.parquet(str(tmp_path / "out/errors")).count() == 1


def test_versions_fetches_and_schemas(spark, tmp_path):
    path = str(tmp_path / "snap")
    assert tables.versions(spark, path) == []
    for v, n in (("2025-01-01", 1), ("2025-02-01", 2)):
        tables.snapshot({"t": spark.range(n)}, path, v)
    assert tables.versions(spark, path) == ["2025-01-01", "2025-02-01"]
    assert tables.restore(spark, path, ["t"])["t"].count() == 2 and tables.restore(spark, path, ["t"], "2025-01-01")["t"].count() == 1

    def make_fetch():
        def fetch(url):
            if url == "bad":
                raise ValueError("gone")
            return url + "/", "<p>"

        return fetch

    out = {r.url: tuple(r)[1:] for r in tables.fetched_pages(spark.createDataFrame([("a",), ("bad",), (None,)], "url string"), make_fetch).collect()}
    assert out == {"a": ("a/", "<p>", None), "bad": (None, None, "ValueError: gone")}
    for name in schemas.TABLES:
        assert schemas.empty(spark, name).count() == 0 and schemas.repeated_keys(schemas.empty(spark, name), name).count() == 0
    schemas.create(spark, "ingredient", str(tmp_path / "i"))
    rows = spark.createDataFrame([("1", "a", "x"), ("2", "a", "y"), ("3", None, "z"), ("4", None, "z")], "id string, canonical_name string, category string")
    assert [tuple(r) for r in schemas.repeated_keys(rows, "ingredient").collect()] == [("canonical_name", "a", 2)]

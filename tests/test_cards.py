"""Whole cards, sources of images and OCR lines, on worked examples and odd input."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.functions import text
from tamarack.operators import card_reading as R
from tamarack.operators import cards
from tamarack.sources import tables


def one(spark, c):
    return spark.range(1).select(c.alias("r")).first().r


def lines(*rows):
    """An array of lines; a row is (text, y) or (text, y, red)."""
    return F.array(*[F.struct(F.lit(r[0]).alias("text"), F.lit(0.0).alias("x"), F.lit(float(r[1])).alias("y"), F.lit(len(r) > 2).alias("red")) for r in rows]).cast(f"array<{R.LINE}>")


def test_nearest_lines(spark):
    anchors, some = lines(("a", 1), ("b", 2), ("c", 9)), lines(("q", 2.2), ("p", 1.9))
    assert one(spark, cards.match_nearest(anchors, some)) == ["p", "q", None]
    assert one(spark, cards.match_nearest(lines(("a", 2)), lines(("first", 1), ("second", 3)))) == ["first"]
    assert one(spark, cards.match_nearest(anchors, lines())) == [None] * 3 and one(spark, cards.match_nearest(lines(), some)) == []


def test_ingredients_of_both_layouts(spark):
    names = R.name_lines(lines(("Ingredients", 0), ("Oil", 1), ("Soy 11)", 2), ("13)", 3), ("Oil", 4), ("Nutrition", 5), ("Salt", 6)))
    assert [n.text for n in one(spark, names)] == ["Oil", "Soy 11) 13)", "Oil"] and [n.y for n in one(spark, names)] == [1, 2, 4]
    table = one(spark, R.ingredient_table(names, F.array(lines(("Ya tbsp", 1), ("3g", 4)), lines(("2", 1), ("5 fl oz", 2), ("1 unit(s)", 4)))))
    assert [(r.name, [tuple(c) for c in r.cells]) for r in table] == [("Oil", [(0.5, "tbsp", "Ya tbsp"), (2.0, None, "2")]), ("Soy 11) 13)", [(3.0, "g", "3g"), (5.0, "fl oz", "5 fl oz")]), ("Oil", [(None, None, ""), (1.0, None, "1 unit(s)")])]
    flat = one(spark, R.ingredient_list(lines(("Pantry", 0), ("- 250g Rice *", 1), ("Salt", 2), ("***", 3), ("Allergens: rice", 4))))
    assert [(r.name, tuple(r.cells[0])) for r in flat] == [("Rice", (250.0, "g", "250 g Rice")), ("Salt", (None, None, "Salt"))]


def test_nutrition_tables(spark):
    labels = lines(("(kcal)", 0), ("CHRErgYy (kJ/kcal)", 10), ("Fat (g)", 20), ("Sat. fat", 30), ("Sodium", 40))
    read = lambda values, wider: one(spark, R.nutrition_table(labels, values, wider))
    full = lines(("per", 1), ("2480", 5), ("2487/594", 10), ("12.5 g", 21), ("3", 31), ("0.9", 41))
    assert tuple(read(full, full))[:3] == (594.0, 12.5, 3.0) and read(full, full).salt_grams == 0.9 and read(full, full).protein_grams is None
    clipped = lines(("12.5 g", 21), ("3", 31), ("0.9", 41))
    assert read(clipped, full).calories == 594.0 and read(clipped, clipped).calories is None
    assert tuple(read(lines(), lines())) == (None,) * 8
    text_of = cards.labeled_nutrition(F.lit("Saturated fat 3 g Fat: 9.5 g | Fatty 1 Carbohydrates: 40 Calories 740.6 kcal, Salt: 1 Fat: 7"))
    assert {k: v for k, v in one(spark, text_of).asDict().items() if v is not None} == {"saturated_fat_grams": 3.0, "fat_grams": 9.5, "carbs_grams": 40.0, "calories": 741.0, "salt_grams": 1.0}


def test_steps(spark):
    columns = F.array(F.lit("METHOD\n1. Boil\nfor about\n40 minutes"), F.lit("2\nDrain 3 cups\r\n 6) Serve"), F.lit("Enjoy"), F.lit(None).cast("string"))
    assert one(spark, cards.flowing_steps(columns)) == ["Boil for about 40 minutes", "Drain 3 cups", "Serve", "Enjoy"]
    grid = one(spark, R.grid_steps(F.array(lines(("1 PREP", 0), ("Peel", 1), ("it", 2)), lines(("PREP ALL", 0)), lines(("cook", 0)), lines())))
    assert [tuple(s) for s in grid] == [("PREP", "Peel it"), ("PREP ALL", ""), (None, "cook"), (None, "")]


def png(rgb, kind=0, channels=3):
    """A PNG whose rows all have this filter."""
    h, w = rgb.shape[:2]
    flat = rgb.astype(np.int32)
    left = np.pad(flat, ((0, 0), (1, 0), (0, 0)))[:, :-1]
    up = np.pad(flat, ((1, 0), (0, 0), (0, 0)))[:-1]
    corner = np.pad(flat, ((1, 0), (1, 0), (0, 0)))[:-1, :-1]
    p = left + up - corner
    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
    guess = [0 * flat, left, up, (left + up) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))][kind]
    rows = ((flat - guess) & 255).astype(np.uint8).reshape(h, -1)
    data = b"".join(bytes([kind]) + r.tobytes() for r in rows)
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_pixels(kind, channels):
    image = np.random.default_rng(kind).integers(0, 256, (9, 13, channels), dtype=np.uint8)
    want = np.repeat(image[:, :, :1], 3, axis=2) if channels < 3 else image[:, :, :3]
    assert np.array_equal(tables.pixels(png(image, kind, channels)), want)


def test_red_lines(spark):
    image = np.full((40, 60, 3), 255, np.uint8)
    image[8:14, 5:50] = (200, 30, 30)
    image[28:34, 5:50] = (20, 20, 20)
    red, black = {"x0": 5.0, "y0": 14.0, "x1": 50.0, "y1": 14.0}, {"x0": 5.0, "y0": 34.0, "x1": 50.0, "y1": 34.0}
    assert tables.is_red(png(image), red) and not tables.is_red(png(image), black)
    assert not any(tables.is_red(*x) for x in ((png(image), None), (b"", red), (b"no image", red), (png(image), {"x0": 900.0, "y0": 0.0, "x1": 950.0, "y1": 0.0})))

    def make_engine():
        return lambda image: [("Pearl barley ", 8.0, 14.0, (5, 14, 50, 14)), ("  ", 0, 0, None), ("Oil", 28.0, 34.0, (5, 34, 50, 34)), ("dot", 1.0, 2.0, (3, 3, 3, 3))]

    files = spark.createDataFrame([("a.pdf", bytearray(b"xx"))], "path string, content binary")
    picture = png(image)
    pages = tables.rendered_pages(files, lambda content: [picture] * len(content))
    assert [(r.path, r.page_no) for r in pages.orderBy("page_no").collect()] == [("a.pdf", 1), ("a.pdf", 2)]
    out = tables.ocr_lines(pages.filter("page_no = 1").select(F.col("path").alias("crop_id"), "image"), make_engine).orderBy("line_no").collect()
    assert [(r.text, r.y, r.red, r.baseline is None) for r in out] == [("Pearl barley", 11.0, True, False), ("Oil", 31.0, False, False), ("dot", 1.5, False, True)]


def test_manifest_and_images(spark, tmp_path):
    schema = "url string, lastmod string, scraped_at string, status string, error string"
    old = spark.createDataFrame([("a", "1", "1", "ok", None), ("b", "1", "1", "error", "x")], schema)
    new = spark.createDataFrame([("b", "2", "3", "ok", None), ("b", "2", "2", "error", "y"), ("c", None, "3", "error", "z")], schema)
    rows = tables.upsert_manifest(old, new)
    assert {(r.url, r.scraped_at, r.status) for r in rows.collect()} == {("a", "1", "ok"), ("b", "3", "ok"), ("c", "3", "error")}
    tables.write_manifest(rows, str(tmp_path / "m"))
    assert tables.manifest_lines(spark, str(tmp_path / "m")).exceptAll(rows).count() == 0
    (tmp_path / "img/d").mkdir(parents=True)
    for name in ("a.PNG", "b.jpeg", "c.webp", "d.xyz"):
        (tmp_path / "img/d" / name).write_bytes(b"1")
    assert sorted(r.content_type for r in tables.image_files(spark, str(tmp_path / "img")).collect()) == ["image/jpeg", "image/png", "image/png", "image/webp"]


def test_addresses_and_segments(spark):
    df = spark.createDataFrame([("p://u:pw@h/d?schema=a&b=1&schemas=2", ["a", "b.png"]), ("p://h/d?schema", ["..", "x"]), ("p://h", ["a/b"]), (None, []), ("p://h?a", None), ("x", ["a\\b"]), ("y", ["."]), ("z", [None])], "u string, s array<string>")
    out = df.select(text.redacted(text.without_param(F.col("u"), "schema")).alias("u"), text.safe_segments(F.col("s")).alias("s")).collect()
    assert [r.u for r in out] == ["p://u:***@h/d?b=1&schemas=2", "p://h/d", "p://h", None, "p://h?a", "x", "y", "z"]
    assert [r.s for r in out] == [True] + [False] * 7


def test_cards_without_anything(spark):
    from tamarack.plans.card_queries import _blank_card

    cards_ = _blank_card(spark.createDataFrame([("a",), ("b",), (None,)], "card_id string"))
    out = R.read_cards(cards_).orderBy(F.col("card_id").asc_nulls_first()).collect()
    assert [r.name for r in out] == ["Quiet Supper"] * 3 and out[0].warnings == ["no ingredients", "no calories"] and out[0].steps == []
    assert R.read_cards(cards_.limit(0)).count() == 0
    none = R.read_cards(cards_.withColumn("pages", F.lit(None).cast("int"))).first()
    assert none.error == "fewer than two pages" and none.warnings is None

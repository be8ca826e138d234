"""Queries of scanned cards; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.operators import cards as C
from tamarack.session import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ocr_line").select("line_id", "draft_id", "page_no", "line_no", "text", "y", "baseline").dropDuplicates(["line_id"])


def page_skew(spark, sf_dir):
    """Median angle of each page."""
    return C.skew(_lines(spark, sf_dir), "draft_id", "page_no").withColumn("angle", F.round("angle", 6))


def line_headings(spark, sf_dir):
    """Lines that are step headings."""
    return _lines(spark, sf_dir).select("line_id", C.step_heading(F.col("text")).alias("heading")).filter("heading is not null")


def page_regions(spark, sf_dir):
    """The region around all lines of a page, moved right by a tenth of its width."""
    r = _lines(spark, sf_dir).filter("baseline is not null").select("draft_id", "page_no", (F.col("baseline.x0") / 1000).alias("left"), (F.col("y") / 1000).alias("top"), ((F.col("baseline.x1") - F.col("baseline.x0")) / 1000).alias("width"), F.lit(0.02).alias("height"))
    u = C.union_region(r, "draft_id", "page_no")
    return u.select("draft_id", "page_no", *[F.round(c, 6).alias(c) for c in ("left", "top", "width", "height")], F.round(C.shift(F.col("left"), F.col("width") / 10, F.col("width")), 6).alias("shifted"))


def serves_anchor(spark, sf_dir):
    """Of each page's lines that say "serves", the one nearest to the foot."""
    rows = _lines(spark, sf_dir).filter("baseline is not null").select("draft_id", "page_no", "text", F.col("baseline.x0").alias("x"), "y")
    return C.nearest_anchor(rows, "serves", 50.0, 800.0, "draft_id", "page_no")


def quantity_cells(spark, sf_dir):
    """quantity and unit of every cell."""
    cells = table(spark, sf_dir, "parsed_card_quantity").select("cell_id", "raw_text").distinct()
    q = C.quantity_cell(F.col("raw_text"))
    return cells.select("cell_id", q["quantity"].alias("quantity"), q["unit"].alias("unit"))


def step_times(spark, sf_dir):
    """the time that a step names."""
    steps = table(spark, sf_dir, "parsed_card_step").select("step_id", "text").distinct()
    return steps.select("step_id", C.card_minutes(F.col("text")).alias("minutes")).filter("minutes is not null")


def page_matches(lines: DataFrame) -> DataFrame:
    """(draft_id, page_no, pos, text, match): a page's next one is the next that the draft has; lines without a page number are left out."""
    rows = lines.filter("page_no is not null")
    pages = rows.select("draft_id", "page_no").distinct()
    before = pages.withColumn("before", F.lag("page_no").over(Window.partitionBy("draft_id").orderBy("page_no"))).filter("before is not null")
    following = rows.join(before.withColumnRenamed("draft_id", "d"), F.col("draft_id").eqNullSafe(F.col("d")) & (rows["page_no"] == before["page_no"])).select("draft_id", F.col("before").alias("page_no"), "text", "y")
    return C.match_rows(rows, following, "draft_id", "page_no")


def matched_rows(spark, sf_dir):
    """Lines of each page matched to those of the draft's next page by height; those of the last page match nothing."""
    return page_matches(_lines(spark, sf_dir))


def flowing_steps(spark, sf_dir):
    """Running text of each page split into steps."""
    texts = _lines(spark, sf_dir).groupBy("draft_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    texts = texts.select("draft_id", "page_no", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))
    return texts.select("draft_id", "page_no", F.posexplode(C.flowing_steps(F.array("text"))).alias("pos", "step"))


def nutrition_texts(spark, sf_dir):
    """Labelled nutrition lines made of the recipe table and read back."""
    from tamarack.operators.browse import current

    now = current(table(spark, sf_dir, "recipe"), "calories", "fat_grams", "saturated_fat_grams", "salt_grams").filter("calories is not null and fat_grams is not null and saturated_fat_grams is not null and salt_grams is not null")
    text = F.concat(F.lit("Calories: "), "calories", F.lit(" kcal | Saturated fat: "), "saturated_fat_grams", F.lit(" g | Fat: "), "fat_grams", F.lit(" g | Sodium: "), "salt_grams", F.lit(" g"))
    n = C.labeled_nutrition(text)
    cell = F.concat((F.col("calories") * 4).cast("string"), F.lit("["), F.col("calories").cast("string"))
    return now.select("id", n["calories"].cast("int").alias("calories"), n["fat_grams"].alias("fat"), n["saturated_fat_grams"].alias("saturated"), n["salt_grams"].alias("salt"), C.energy_kcal(cell).alias("kcal"))


def list_lines(spark, sf_dir):
    """Lines of each page after joining continuations and cleaning, as a list layout."""
    texts = _lines(spark, sf_dir).groupBy("draft_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    merged = C.merge_wrapped(F.transform("l", lambda x: x["text"]))
    return texts.select("draft_id", "page_no", F.size(C.ingredient_lines(merged, table=False)).alias("lines"), F.array_join(F.transform(C.ingredient_lines(merged), C.bullet), "|").alias("text"))


QUERIES = [page_skew, line_headings, page_regions, serves_anchor, quantity_cells, step_times, matched_rows, flowing_steps, nutrition_texts, list_lines]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def cell_readings() -> str:
    """SQL of ``readings``: quantity and unit of every cell."""
    from tamarack.functions.ingredients import COUNT_WORDS, FRACTIONS, UNIT_WORDS

    v = "".join(FRACTIONS)
    fraction = " ".join(f"WHEN '{c}' THEN {x!r}::DOUBLE" for c, x in FRACTIONS.items())
    known = ", ".join(f"'{u}'" for u in UNIT_WORDS)
    counts = ", ".join(f"'{u}'" for u in COUNT_WORDS)
    return rf"""c AS (SELECT DISTINCT cell_id, raw_text, regexp_replace(regexp_replace(trim(raw_text), '(^|\s)[Yy][Aa](\s|$)', '\1½\2', 'g'), '^(\d+(?:\.\d+)?)([a-zA-Z]+)', '\1 \2') AS t FROM parsed_card_quantity),
q AS (SELECT *, regexp_extract(t, '^(\d+(?:\.\d+)?(?:/\d+)?|\d*[{v}])\s+(.+)$', 1) AS tok, regexp_extract(t || ' placeholder', '^(\d+(?:\.\d+)?(?:/\d+)?|\d*[{v}])\s+(.+)$', 1) AS tok2, regexp_extract(t || ' placeholder', '^(\d+(?:\.\d+)?(?:/\d+)?|\d*[{v}])\s+(.+)$', 2) AS tail FROM c),
a AS (SELECT *, CASE WHEN coalesce(raw_text, '') = '' THEN NULL WHEN regexp_matches(tok2, '^\d+/\d+$') THEN split_part(tok2, '/', 1)::DOUBLE / nullif(split_part(tok2, '/', 2)::DOUBLE, 0) WHEN regexp_matches(tok2, '^\d*[{v}]$') THEN coalesce(try_cast(left(tok2, length(tok2) - 1) AS DOUBLE), 0) + CASE right(tok2, 1) {fraction} END WHEN regexp_matches(tok2, '^\d+(\.\d+)?$') THEN tok2::DOUBLE END AS quantity FROM q),
r AS (SELECT *, CASE WHEN quantity IS NULL THEN t || ' placeholder' ELSE tail END AS rest FROM a),
u AS (SELECT *, lower(regexp_extract(rest, '^(\S+\s+\S+)\s+(.+)$', 1)) AS u2, lower(regexp_extract(rest, '^(\S+)\s+(.+)$', 1)) AS u1 FROM r),
p AS (SELECT *, CASE WHEN coalesce(raw_text, '') = '' THEN NULL WHEN quantity IS NOT NULL AND u2 IN ({known}) THEN u2 WHEN u1 IN ({known}) THEN u1 END AS unit FROM u),
readings AS (SELECT cell_id, quantity, CASE WHEN unit NOT IN ({counts}) THEN unit END AS unit FROM p)"""


def oracle_sql() -> dict[str, str]:
    from tamarack.plans.baskets import CUR

    lines = "l AS (SELECT DISTINCT ON (line_id) * FROM ocr_line)"
    region = "SELECT draft_id, page_no, min(baseline.x0 / 1000) AS l, min(y / 1000) AS t, max(baseline.x0 / 1000 + (baseline.x1 - baseline.x0) / 1000) AS r, max(y / 1000 + 0.02::DOUBLE) AS b FROM l WHERE baseline IS NOT NULL GROUP BY 1, 2"
    return {
        "page_skew": f"WITH {lines}, a AS (SELECT draft_id, page_no, CASE WHEN baseline.x1 - baseline.x0 >= 80 THEN degrees(atan2(baseline.y1 - baseline.y0, baseline.x1 - baseline.x0)) END AS a FROM l) SELECT draft_id, page_no, round(coalesce(median(a), 0), 6) AS angle, abs(coalesce(median(a), 0)) >= 0.3 AS rotate FROM a GROUP BY 1, 2",
        "line_headings": rf"WITH {lines}, h AS (SELECT line_id, CASE WHEN regexp_matches(text, '^\d+[.)]?\s+(.+)$') THEN regexp_extract(text, '^\d+[.)]?\s+(.+)$', 1) WHEN length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) >= 3 AND regexp_replace(text, '[^a-zA-Z]', '', 'g') = upper(regexp_replace(text, '[^a-zA-Z]', '', 'g')) THEN text END AS heading FROM l) SELECT * FROM h WHERE heading IS NOT NULL",
        "page_regions": f"WITH {lines}, u AS ({region}) SELECT draft_id, page_no, round(l, 6) AS left, round(t, 6) AS top, round(r - l, 6) AS width, round(b - t, 6) AS height, round(greatest(0, least(l + (r - l) / 10, 1 - (r - l))), 6) AS shifted FROM u",
        "serves_anchor": f"WITH {lines}, d AS (SELECT draft_id, page_no, text, sqrt((baseline.x0 - 50) ** 2 + (y - 800) ** 2) AS d FROM l WHERE baseline IS NOT NULL AND contains(lower(text), 'serves')) SELECT draft_id, page_no, text, round(d, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY draft_id, page_no ORDER BY d, text) = 1",
        "quantity_cells": f"WITH {cell_readings()} SELECT cell_id, quantity, unit FROM readings",
        "step_times": r"WITH s AS (SELECT DISTINCT step_id, try_cast(coalesce(nullif(regexp_extract(text, '(?i)total time:?\s*(\d+)', 1), ''), nullif(regexp_extract(text, '(?i)(\d+)\s*-?\s*(?:\d+\s*)?min', 1), '')) AS INTEGER) AS minutes FROM parsed_card_step) SELECT * FROM s WHERE minutes IS NOT NULL",
        "nutrition_texts": f"WITH {CUR} SELECT id, calories, fat_grams AS fat, saturated_fat_grams AS saturated, salt_grams AS salt, CASE WHEN calories >= 50 THEN calories END AS kcal FROM cur WHERE calories IS NOT NULL AND fat_grams IS NOT NULL AND saturated_fat_grams IS NOT NULL AND salt_grams IS NOT NULL",
    }

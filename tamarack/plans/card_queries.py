"""Queries of whole cards, drafts, files and details; with their DuckDB SQL.

The cards are printed in the query from the tables and read back, so the oracle is the table itself.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions import text as T
from tamarack.operators import basket, browse, ingest, state, suggest
from tamarack.operators import card_reading as R
from tamarack.operators import cards as C
from tamarack.plans.baskets import E, _combos, _entries, _sets
from tamarack.plans.catalog import AS_OF, CUR, FILTER
from tamarack.plans.pages import _manifest
from tamarack.plans.scanned import cell_readings
from tamarack.session import table
from tamarack.sources import schemas
from tamarack.sources import tables as files

LINES = f"array<{R.LINE}>"
NUTRIENTS = ["calories", "fat_grams", "saturated_fat_grams", "carbs_grams", "sugar_grams", "protein_grams", "fiber_grams", "salt_grams"]
LABELS = ["Energy (kJ/kcal)", "Fat (g)", "Saturates (g)", "Carbohydrate (g)", "Sugars (g)", "Protein (g)", "Fibre (g)", "Sodium (g)"]


def _now(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return browse.current(table(spark, sf_dir, "recipe"), *columns)


def _line(text: Column, y: Column | float, red: Column | None = None, x: Column | None = None) -> Column:
    return F.struct(text.cast("string").alias("text"), (F.lit(0.0) if x is None else x).alias("x"), (y if isinstance(y, Column) else F.lit(float(y))).cast("double").alias("y"), (F.lit(False) if red is None else red).alias("red"))


def _blank_card(rows: DataFrame, **parts: Column) -> DataFrame:
    """Cards with these parts and nothing in the others."""
    kinds = {"pages": "int", "titles": "array<struct<template:string,title:string,time:string>>", "ingredient_layout": "string", "names": LINES, "columns": f"array<{LINES}>", "nutrition_layout": "string", "labels": LINES, "values": LINES, "wider": LINES, "second_values": LINES, "block": "string", "step_layout": "string", "step_crops": f"array<{LINES}>", "step_columns": "array<string>"}
    usual = {"pages": F.lit(2), "titles": F.array(F.struct(F.lit("classic").alias("template"), F.lit("Quiet Supper").alias("title"), F.lit("35 minutes").alias("time"))), "ingredient_layout": F.lit("table"), "nutrition_layout": F.lit("table"), "step_layout": F.lit("grid")}
    empty = {c: F.array().cast(k) for c, k in kinds.items() if k.startswith("array") and c != "second_values"}
    return rows.select("card_id", *[(parts.get(c) if c in parts else usual.get(c, empty.get(c, F.lit(None)))).cast(k).alias(c) for c, k in kinds.items()])


def card_ingredients(spark, sf_dir):
    """The ingredient table of every draft and serving column, read off its card row by row."""
    cells = table(spark, sf_dir, "parsed_card_quantity").select("cell_id", "draft_id", "row_no", "serving_count", "raw_text").distinct().filter("raw_text <> ''")
    card = F.concat_ws("/", "draft_id", F.col("serving_count").cast("string")).alias("card_id")
    name = _line(F.concat(F.lit("Row "), F.col("row_no").cast("string"), F.lit(" of cell "), F.col("cell_id").cast("string")), F.col("row_no") * 1000 + F.pmod("cell_id", F.lit(500)))
    cell = _line(F.col("raw_text"), F.col("row_no") * 1000 + F.pmod("cell_id", F.lit(500)))
    drafts = cells.groupBy(card).agg(F.array_sort(F.collect_list(F.struct(F.col("row_no"), F.col("cell_id"), name.alias("l")))).alias("n"), F.array_sort(F.collect_list(F.struct(F.xxhash64("cell_id").alias("h"), cell.alias("l")))).alias("c"))
    rows = R.read_cards(_blank_card(drafts, names=F.transform("n", lambda x: x["l"]), columns=F.array(F.transform("c", lambda x: x["l"]))))
    one = rows.select("card_id", F.explode("ingredients").alias("i")).select("card_id", F.regexp_extract("i.name", r"(\d+)$", 1).cast("bigint").alias("cell_id"), F.get("i.cells", F.lit(0)).alias("cell"))
    return one.select("card_id", "cell_id", "cell.quantity", "cell.unit")


def _nutrition_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _now(spark, sf_dir, *NUTRIENTS).filter(" and ".join(f"{c} is not null" for c in NUTRIENTS)).withColumn("card_id", F.col("id"))
    cells = [F.concat((F.col("calories") * 4).cast("string"), F.lit("/"), F.col("calories").cast("string")), *[F.col(c).cast("string") for c in NUTRIENTS[1:]]]
    labels = F.array(_line(F.lit("(kcal)"), 1), *[_line(F.lit(l), 10 * i) for i, l in enumerate(LABELS, 1)])
    values = F.array(_line(F.lit("Per serving"), 1), _line(F.lit("2345"), 2), *[_line(c, 10 * i + 1) for i, c in enumerate(cells, 1)])
    # On every second card the top row is out of the first crop.
    clipped = F.array(_line(F.lit("Per"), 1), *[_line(c, 10 * i + 1) for i, c in enumerate(cells[1:], 2)])
    optional = F.concat((F.col("calories") * 4 + 4).cast("string"), F.lit("/"), (F.col("calories") + 1).cast("string"))
    second = F.when(F.col("calories") > 700, F.array(*[_line(c, 10 * i) for i, c in enumerate([optional, *cells[1:]], 1)]))
    return _blank_card(rows, labels=labels, values=F.when(F.col("calories") % 2 == 0, clipped).otherwise(values), wider=values, second_values=second)


def card_nutrition(spark, sf_dir):
    """Nutrition tables, every second one clipped at its top row, some with a second column."""
    rows = R.read_cards(_nutrition_cards(spark, sf_dir))
    return rows.select(F.col("card_id").alias("id"), *[F.col(f"nutrition.{c}").alias(c) for c in NUTRIENTS], F.col("optional_nutrition.calories").alias("second_calories"), F.array_join(F.filter("warnings", lambda w: w != "no ingredients"), ", ").alias("warnings"))


def card_numbers(spark, sf_dir):
    """Nutrition of cards with labelled text and of cards with bare numbers in the order of their columns."""
    rows = _now(spark, sf_dir, *NUTRIENTS).filter(" and ".join(f"{c} is not null" for c in NUTRIENTS)).withColumn("card_id", F.col("id"))
    labelled = F.concat(F.lit("Nutrition per serving: Calories: "), "calories", F.lit(" kcal | Saturated fat: "), "saturated_fat_grams", F.lit(" g | Fat: "), "fat_grams", F.lit(" g | Carbs "), "carbs_grams", F.lit(" g | Sugars: "), "sugar_grams", F.lit(" g\nProtein: "), "protein_grams", F.lit(" g | Fibre: "), "fiber_grams", F.lit(" g | Sodium: "), "salt_grams", F.lit(" g"))
    bare = F.concat_ws("  ", *[F.col(c).cast("string") for c in NUTRIENTS[:4]])
    odd = F.col("calories") % 2 == 1
    cards = _blank_card(rows, nutrition_layout=F.when(odd, "labeled").otherwise("positional"), block=F.when(odd, labelled).otherwise(bare))
    return R.read_cards(cards, fields=NUTRIENTS[:4]).select(F.col("card_id").alias("id"), *[F.col(f"nutrition.{c}").alias(c) for c in NUTRIENTS])


def card_steps(spark, sf_dir):
    """Steps of cards with a crop for each, and of cards with two columns of running text whose numbers go on."""
    rows = _now(spark, sf_dir, "steps").withColumns({"card_id": F.col("id"), "steps": F.filter("steps", lambda s: F.trim(s["text"]) != "")}).filter("size(steps) > 0")
    grid = F.pmod(F.size("steps"), F.lit(2)) == 0
    crops = F.transform("steps", lambda s, i: F.filter(F.array(F.when(s["heading"].isNotNull(), _line(F.concat((i + 1).cast("string"), F.lit(". "), s["heading"]), 0)), _line(s["text"], 10)), lambda l: l.isNotNull()))
    numbered = F.transform("steps", lambda s, i: F.concat((i + 1).cast("string"), F.when(i % 2 == 0, ". ").otherwise(" "), F.replace(s["text"], F.lit(" "), F.lit("  "))))
    half = F.floor(F.size("steps") / 2).cast("int")
    columns = F.array(F.concat(F.lit("METHOD\n"), F.array_join(F.slice(numbered, 1, half + 1), "\n")), F.array_join(F.slice(numbered, half + 2, F.size("steps")), "\r\n"))
    out = R.read_cards(_blank_card(rows, step_layout=F.when(grid, "grid").otherwise("flowing"), step_crops=crops, step_columns=columns))
    return out.select(F.col("card_id").alias("id"), F.posexplode("steps").alias("pos", "s")).select("id", "pos", "s.heading", "s.text")


def card_reports(spark, sf_dir):
    """Template, time, error and warnings of every card; some have one page, no time, or red lines."""
    rows = _now(spark, sf_dir, "cook_minutes", "calories").withColumn("card_id", F.col("id"))
    time = F.concat(F.lit("Total time: "), F.col("cook_minutes").cast("string"), F.lit(" minutes"))
    first = F.struct(F.lit("older").alias("template"), F.when(F.col("calories") % 4 == 0, "Quiet Supper").otherwise("Supper").alias("title"), F.lit("5-10 min").alias("time"))
    second = F.struct(F.lit("classic").alias("template"), F.concat(F.lit("Quiet Supper "), "id").alias("title"), time.alias("time"))
    red = F.coalesce(F.col("calories") % 3 == 0, F.lit(False))
    names = F.array(_line(F.lit("Pearl barley"), 1, red), _line(F.lit("Oil"), 2))
    columns = F.array(F.array(_line(F.lit("2 g"), 1)), F.array(_line(F.lit("2 g"), 1), _line(F.lit("1"), 2)))
    steps = F.array(F.array(_line(F.lit("1 Boil"), 1), _line(F.lit("the barley"), 2, red)), F.array(_line(F.lit("2. Serve"), 1)))
    cards = _blank_card(rows, pages=F.when(F.col("calories") % 7 == 0, 1).otherwise(2), titles=F.array(first, second), names=names, columns=columns, step_crops=steps)
    return R.read_cards(cards).select(F.col("card_id").alias("id"), "error", "template", "cook_minutes", F.array_join("warnings", ", ").alias("warnings"))


def card_regions(spark, sf_dir):
    """Nutrition regions moved to where their heading was found, and columns fixed by theirs."""
    rows = _now(spark, sf_dir, "calories").filter("calories is not null").withColumn("n", F.pmod("calories", F.lit(6)))
    xs = F.transform(F.sequence(F.lit(0), F.col("n") + 1), lambda i: F.struct((F.lit(0.4) + i * 0.1).alias("x"), F.lit(0.52).alias("y"), F.lit(" Per").alias("text")))
    # A second reading of a heading, one of another height, and other words.
    more = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(t).alias("text")) for x, y, t in ((0.41, 0.52, "per"), (0.2, 0.7, "per"), (0.1, 0.5, "per serving"))])
    lines = rows.filter("n > 0").select("id", F.explode(F.concat(F.slice(xs, 1, F.col("n")), more)).alias("l")).select("id", "l.*")
    found = rows.join(C.header_positions(lines, "id", top=F.lit(0.5)), "id", "left")

    def region(*sides: float) -> Column:
        return F.struct(*[F.lit(v).alias(k) for k, v in zip(("left", "top", "width", "height"), sides, strict=True)])

    at = F.when(F.col("calories") % 5 > 0, F.struct((F.lit(0.1) + F.col("calories") % 10 / 100).alias("left"), F.lit(0.55).alias("top")))
    r = R.corrected_regions(region(0.1, 0.5, 0.35, 0.3), region(0.6, 0.5, 0.1, 0.3), at, F.struct(F.lit(0.1).alias("left"), F.lit(0.5).alias("top")), F.col("xs"))
    one = found.select("id", r.alias("r"))
    return one.select("id", *[F.round(f"r.{k}", 6).alias(k.replace(".", "_")) for k in ("label.left", "label.top", "label.width", "value.left", "second.left")])


def serving_cells(spark, sf_dir):
    """The second serving column of every row of a card, else its first."""
    cells = table(spark, sf_dir, "parsed_card_quantity").groupBy("draft_id", "row_no").agg(F.array_sort(F.collect_set(F.struct("serving_count", "cell_id", "raw_text"))).alias("c"))
    return cells.select("draft_id", "row_no", R.serving(F.col("c"), F.lit(1))["raw_text"].alias("raw_text"))


def draft_records(spark, sf_dir):
    """P20: parsed cards as they are stored, without pictures."""
    rows = _now(spark, sf_dir, "name", "steps").withColumns({"cover": F.encode("name", "utf-8"), "steps": F.transform("steps", lambda s: F.struct("id", s["heading"].alias("heading"), s["text"].alias("text"), F.encode(s["text"], "utf-8").alias("photo")))})
    return R.draft_record(rows).select("id", F.posexplode("steps").alias("pos", "s")).select("id", "pos", "s.*")


def committed_drafts(spark, sf_dir):
    """Reviewed drafts made into recipes."""
    return _committed(spark, sf_dir)[0].select("draft_id", "name", "subtitle", "cook_minutes", "servings", "is_pdf_import")


def committed_lines(spark, sf_dir):
    """Ingredient lines of the recipes made from drafts."""
    recipes, lines = _committed(spark, sf_dir)
    return lines.join(recipes.select(F.col("id").alias("recipe_id"), "draft_id"), "recipe_id").select("draft_id", "row_no", "name", "quantity", "unit", "raw_text")


def _committed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edits = table(spark, sf_dir, "edited_ingredient").select("edit_id", "recipe_id", "row_no", "name", "quantity", "unit").distinct()
    lists = edits.groupBy(F.col("recipe_id").alias("draft_id")).agg(F.array_sort(F.collect_list(F.struct("row_no", "edit_id", "name", "quantity", "unit"))).alias("ingredients"))
    rows = _now(spark, sf_dir, "name", "subtitle", "cook_minutes", "servings", "calories", "steps").withColumnRenamed("id", "draft_id").join(lists, "draft_id")
    drafts = rows.withColumns({"name": F.when(F.col("calories") % 5 == 0, "  ").otherwise(F.col("name")), "serving_counts": F.array("servings"), "ingredients": F.transform("ingredients", lambda i: F.struct(i["name"].alias("name"), i["quantity"].alias("quantity"), i["unit"].alias("unit")))})
    return state.commit_drafts(drafts, rows.select(F.lit("taken").alias("slug")), AS_OF, 1)


def cloned_lines(spark, sf_dir):
    """The ingredient lines of cloned recipes."""
    clones = state.clone(_now(spark, sf_dir, *browse.SUMMARY, "rating_count", "variant_of_id", "created_at", "updated_at", "cloned_from_id"), _now(spark, sf_dir, "calories").filter("calories > 800").select("id"), AS_OF)
    rows = table(spark, sf_dir, "edited_ingredient").select("edit_id", "recipe_id", "name").distinct()
    copied = state.clone_children(rows, clones, "recipe_id")
    return copied.join(clones.select(F.col("id").alias("recipe_id"), "cloned_from_id"), "recipe_id").select("edit_id", F.col("cloned_from_id").alias("recipe_id"), "name")


def kept_lines(spark, sf_dir):
    """The ingredient lines left after user-created recipes are deleted with theirs."""
    recipes = _now(spark, sf_dir, "is_user_created", "variant_of_id", "cloned_from_id")
    rows = table(spark, sf_dir, "edited_ingredient").select("edit_id", "recipe_id", "name").distinct()
    return state.delete_children(rows, state.delete(recipes, recipes.select("id")), recipes, "recipe_id")


def recipe_details(spark, sf_dir):
    """Every recipe with its ingredients and its variants, those of one cuisine being variants of the least id."""
    rows = _now(spark, sf_dir, "slug", "name", "subtitle", "cuisine")
    primary = rows.groupBy("cuisine").agg(F.min("id").alias("_first"))
    rows = rows.join(primary, "cuisine", "left").withColumn("variant_of_id", F.when(F.col("_first") != F.col("id"), F.col("_first")))
    lines = table(spark, sf_dir, "recipe_ingredient_set").select("recipe_id", F.explode("ingredient_ids").alias("ingredient_id"))
    out = browse.all_details(rows, lines, table(spark, sf_dir, "ingredient"))
    return out.select("recipe_id", "slug", F.array_join("ingredients", "|").alias("ingredients"), F.coalesce(F.size("variants"), F.lit(0)).alias("variants"), F.element_at("variants", -1)["slug"].alias("last_variant"))


def scaled_views(spark, sf_dir):
    """every entry for two, three and four people."""
    recipes = _now(spark, sf_dir, "servings").select(F.col("id").alias("recipe_id"), "servings")
    rows = _entries(spark, sf_dir).select("entry_id", "recipe_id", "quantity").join(recipes, "recipe_id", "left")
    return basket.scaled_views(rows, F.col("servings")).select("entry_id", "target", F.round("scaled", 6).alias("scaled"))


def oldest_plan(spark, sf_dir):
    """S3: the plan that was begun first."""
    rows = table(spark, sf_dir, "shopping_list_entry").groupBy("plan_id").agg(F.min("added_at").alias("created_at"))
    return rows.orderBy("created_at", "plan_id").limit(1).select("plan_id")


def manifest_upsert(spark, sf_dir):
    """K1: a manifest after a run over the pending pages."""
    site, old = _manifest(spark, sf_dir)
    done = ingest.pending(site, old).select("url", "lastmod", F.lit("2025-10-02").alias("scraped_at"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"))
    return files.upsert_manifest(old.select("url", "lastmod", F.lit("2025-10-01").alias("scraped_at"), "status", F.lit(None).cast("string").alias("error")), done.unionByName(done)).select("url", "lastmod", "scraped_at", "status")


def error_head(spark, sf_dir):
    """The first ten errors of a run."""
    return _manifest(spark, sf_dir)[1].filter("status = 'error'").orderBy("url").limit(10).select("url", "lastmod")


def _image_names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Drafts with their number of steps, and the files that their folders hold."""
    rows = _now(spark, sf_dir, "steps")
    name = F.transform("steps", lambda s, i: F.when(s["image_url"].isNotNull(), F.concat(F.lit("step-"), (i + 1).cast("string"), F.lit(".png"))))
    text = F.transform("steps", lambda s, i: F.when(s["heading"].isNotNull(), F.concat(F.lit("step-"), (i + 1).cast("string"), F.lit("-text.png"))))
    names = rows.select(F.col("id").alias("draft_id"), F.explode(F.concat(F.array(F.lit("cover.png")), name, text)).alias("file")).filter("file is not null")
    return rows.select(F.col("id").alias("draft_id"), F.size("steps").alias("steps")), names


def draft_images(spark, sf_dir):
    """Addresses of the step images of every draft, null where there is no file."""
    return files.draft_images(*_image_names(spark, sf_dir), "/images/drafts")


def image_moves(spark, sf_dir):
    """K4: where the pictures of committed drafts go."""
    drafts, names = _image_names(spark, sf_dir)
    commits = drafts.filter("steps > 2").select("draft_id", F.concat(F.lit("pdf-"), "draft_id").alias("recipe_id"))
    return files.image_moves(names, commits, "/images/drafts", "/images")


def key_conflicts(spark, sf_dir):
    """Values of unique columns that stand in more than one row of the catalog, old crawls included."""
    return schemas.repeated_keys(table(spark, sf_dir, "recipe"), "recipe")


def step_presence(spark, sf_dir):
    """The last step image of every draft and which are there."""
    return files.step_presence(_image_names(spark, sf_dir)[1]).select("draft_id", "last_step", F.array_join("present", ",").alias("present"))


def image_paths(spark, sf_dir):
    """whether the path of an image stays inside its folder; some are made to leave it."""
    rows = _now(spark, sf_dir, "image_url", "calories").filter("image_url is not null")
    path = F.regexp_replace("image_url", r"^https?://[^/]*/", "")
    parts = F.when(F.col("calories") % 3 == 0, F.concat(F.array(F.lit("..")), F.split(path, "/"))).when(F.col("calories") % 3 == 1, F.array(path)).otherwise(F.split(path, "/"))
    return rows.select("id", T.safe_segments(parts).alias("safe"))


def public_urls(spark, sf_dir):
    """addresses without one query parameter, and with their password starred out."""
    rows = _now(spark, sf_dir, "source_url", "slug").filter("source_url is not null")
    url = F.concat(F.lit("db://user:"), "slug", F.lit("@host/base?schema=public&"), F.lit("a=1"))
    return rows.select("id", T.redacted(T.without_param(url, "schema")).alias("with_others"), T.without_param(F.concat("source_url", F.lit("?schema=x")), "schema").alias("alone"))


def _pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rested pool of a narrow filter, or the whole one where that is too small, with items and quality."""
    now = _now(spark, sf_dir, *FILTER)
    marked = state.mark_suggested(now, now.filter("name like '%e%'").select("id"), datetime(2025, 9, 25))
    p = browse.BrowseParams(max_minutes=40)
    pool = suggest.rested_or_all(browse.pool(marked, p, AS_OF), browse.pool(marked, p), suggest.meal_count(7))
    sets = _sets(spark, sf_dir).select(F.col("recipe_id").alias("id"), F.array_distinct("ingredient_ids").alias("items"))
    return pool.join(sets, "id", "left").select("id", "items", F.col("rating_value").alias("quality"))


def rested_pool(spark, sf_dir):
    """Candidates that have rested, or all of them where too few have."""
    return _pools(spark, sf_dir).select("id", "quality")


def suggest_seeded(spark, sf_dir):
    """The best disjoint combinations grown from best and randomly chosen seeds of the rested pool."""
    return suggest.top_disjoint(suggest.combinations(_pools(spark, sf_dir), seed=7)).select("rank", F.array_join("recipe_ids", ",").alias("recipes"), "score")


def shown_recipes(spark, sf_dir):
    """Every recipe of the combinations that are shown."""
    return suggest.top_disjoint(_combos(spark, sf_dir)).select(F.explode("recipe_ids").alias("recipe_id"), "rank")


QUERIES = [card_ingredients, card_nutrition, card_numbers, card_steps, card_reports, card_regions, serving_cells, draft_records, committed_drafts, committed_lines, cloned_lines, kept_lines, recipe_details, scaled_views, oldest_plan, manifest_upsert, error_head, draft_images, image_moves, key_conflicts, step_presence, image_paths, public_urls, rested_pool, suggest_seeded, shown_recipes]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    full = " AND ".join(f"{c} IS NOT NULL" for c in NUTRIENTS)
    kcal = "CASE WHEN calories >= 50 THEN calories::DOUBLE END"
    site = f"{CUR}, site AS (SELECT source_url AS url, max(strftime(updated_at, '%Y-%m-%d')) AS lastmod, max(calories) AS calories FROM cur WHERE source_url IS NOT NULL GROUP BY 1), m AS (SELECT url, CASE WHEN calories % 2 = 0 THEN lastmod ELSE '2020-01-01' END AS lastmod, CASE WHEN calories % 3 = 0 THEN 'ok' WHEN calories % 3 = 1 THEN 'error' ELSE 'skipped' END AS status FROM site)"
    steps = f"{CUR}, x AS (SELECT id, [s for s in steps if trim(s.text) <> ''] AS steps FROM cur), st AS (SELECT id, len(steps) % 2 = 0 AS grid, unnest(steps) AS s, generate_subscripts(steps, 1) - 1 AS pos FROM x)"
    edits = "e AS (SELECT DISTINCT edit_id, recipe_id, row_no, name, quantity, unit FROM edited_ingredient)"
    number = "CASE WHEN h % 100 = 0 THEN (h // 100)::VARCHAR ELSE (h // 100)::VARCHAR || '.' || rtrim(lpad((h % 100)::VARCHAR, 2, '0'), '0') END"
    names = f"{CUR}, s AS (SELECT id AS draft_id, unnest(steps) AS s, generate_subscripts(steps, 1) AS n FROM cur)"
    n = "calories % 6"
    dx = "CASE WHEN calories % 5 > 0 THEN calories % 10 / 100.0::DOUBLE ELSE 0 END"
    # Headings stand at 0.4, 0.5, 0.6 and so on; the second reading at 0.41 is dropped.
    return {
        "card_ingredients": f"WITH {cell_readings()}, cells AS (SELECT DISTINCT cell_id, draft_id, serving_count FROM parsed_card_quantity WHERE raw_text <> '') SELECT draft_id || '/' || serving_count AS card_id, cell_id, quantity, unit FROM cells JOIN readings USING (cell_id)",
        "card_nutrition": f"WITH {CUR} SELECT id, {kcal} AS calories, {', '.join(NUTRIENTS[1:])}, CASE WHEN calories > 700 THEN calories + 1.0::DOUBLE END AS second_calories, concat_ws(', ', CASE WHEN calories < 50 THEN 'no calories' END, CASE WHEN calories > 700 THEN 'second nutrition column' END) AS warnings FROM cur WHERE {full}",
        "card_numbers": f"WITH {CUR} SELECT id, calories::DOUBLE AS calories, {', '.join(NUTRIENTS[1:4])}, {', '.join(f'CASE WHEN calories % 2 = 1 THEN {c} END AS {c}' for c in NUTRIENTS[4:])} FROM cur WHERE {full}",
        "card_steps": f"WITH {steps} SELECT id, pos::INTEGER AS pos, CASE WHEN grid THEN trim(s.heading) END AS heading, CASE WHEN grid THEN trim(s.text) ELSE trim(regexp_replace(s.text, '\\s+', ' ', 'g')) END AS text FROM st",
        "card_reports": f"""WITH {CUR}, r AS (SELECT id, cook_minutes, calories, coalesce(calories % 7 = 0, false) AS one, coalesce(calories % 4 = 0, false) AS older, coalesce(calories % 3 = 0, false) AS red FROM cur),
e AS (SELECT *, CASE WHEN one THEN 'fewer than two pages' WHEN NOT older AND cook_minutes IS NULL THEN 'unknown layout' END AS error FROM r)
SELECT id, error, CASE WHEN error IS NULL THEN CASE WHEN older THEN 'older' ELSE 'classic' END END AS template, CASE WHEN error IS NULL THEN CASE WHEN older THEN 5 ELSE cook_minutes END END AS cook_minutes,
CASE WHEN error IS NULL THEN 'quantity column with 1 of 2 rows' || CASE WHEN red THEN ', red ingredient: Pearl barley' ELSE '' END || ', no calories' || CASE WHEN red THEN ', red text in step 1' ELSE '' END || ', no text in step 2' END AS warnings FROM e""",
        "card_regions": f"""WITH {CUR}, r AS (SELECT id, calories, {n} AS n, 0.1 + {dx} AS l, CASE WHEN calories % 5 > 0 THEN 0.55 ELSE 0.5 END AS t FROM cur WHERE calories IS NOT NULL)
SELECT id, round(l, 6) AS label_left, round(t, 6)::DOUBLE AS label_top, round(CASE WHEN n >= 2 THEN least(0.35, greatest(0.02, 0.4 - l - 0.005)) ELSE 0.35 END, 6)::DOUBLE AS label_width, round(CASE WHEN n >= 2 THEN 0.4 ELSE 0.5 + l END, 6)::DOUBLE AS value_left, CASE WHEN n >= 4 THEN 0.6::DOUBLE END AS second_left FROM r""",
        "serving_cells": "WITH c AS (SELECT DISTINCT draft_id, row_no, serving_count, cell_id, raw_text FROM parsed_card_quantity), o AS (SELECT draft_id, row_no, list(raw_text ORDER BY serving_count, cell_id) AS l FROM c GROUP BY 1, 2) SELECT draft_id, row_no, coalesce(l[2], l[1]) AS raw_text FROM o",
        "draft_records": f"WITH {CUR}, x AS (SELECT id, unnest(steps) AS s, generate_subscripts(steps, 1) - 1 AS pos FROM cur) SELECT id, pos::INTEGER AS pos, s.heading AS heading, s.text AS text FROM x",
        "committed_drafts": f"WITH {CUR} SELECT id AS draft_id, CASE WHEN calories % 5 = 0 THEN 'Untitled recipe' ELSE trim(name) END AS name, nullif(trim(subtitle), '') AS subtitle, cook_minutes, servings, true AS is_pdf_import FROM cur WHERE id IN (SELECT recipe_id FROM edited_ingredient)",
        "committed_lines": f"WITH {CUR}, {edits}, h AS (SELECT *, floor(quantity * 100 + 0.5)::BIGINT AS h FROM e) SELECT recipe_id AS draft_id, (row_number() OVER (PARTITION BY recipe_id ORDER BY row_no, edit_id) - 1)::INTEGER AS row_no, h.name, h.quantity, h.unit, concat_ws(' ', CASE WHEN quantity <> 0 THEN {number} END, nullif(unit, ''), nullif(h.name, '')) AS raw_text FROM h WHERE recipe_id IN (SELECT id FROM cur)",
        "cloned_lines": f"WITH {CUR}, {edits} SELECT DISTINCT edit_id, recipe_id, e.name FROM e JOIN cur ON cur.id = e.recipe_id WHERE calories > 800",
        "kept_lines": f"WITH {CUR}, {edits} SELECT DISTINCT edit_id, recipe_id, name FROM e WHERE recipe_id NOT IN (SELECT id FROM cur WHERE is_user_created)",
        "recipe_details": f"""WITH {CUR}, f AS (SELECT cuisine, min(id) AS first FROM cur WHERE cuisine IS NOT NULL GROUP BY 1), r AS (SELECT cur.id, slug, CASE WHEN first <> cur.id THEN first END AS variant_of FROM cur LEFT JOIN f USING (cuisine)),
i AS (SELECT DISTINCT recipe_id, unnest(ingredient_ids) AS ingredient_id FROM recipe_ingredient_set), g AS (SELECT recipe_id, string_agg(DISTINCT canonical_name, '|' ORDER BY canonical_name) AS ingredients FROM i JOIN ingredient ON ingredient.id = i.ingredient_id GROUP BY 1),
v AS (SELECT variant_of AS id, count(*) AS variants, max_by(slug, id) AS last_variant FROM r WHERE variant_of IS NOT NULL GROUP BY 1)
SELECT r.id AS recipe_id, slug, ingredients, coalesce(variants, 0)::INTEGER AS variants, last_variant FROM r LEFT JOIN g ON g.recipe_id = r.id LEFT JOIN v ON v.id = r.id""",
        "scaled_views": f"WITH {CUR}, {E}, t AS (SELECT unnest([2, 3, 4]) AS target) SELECT entry_id, target, round(quantity * CASE WHEN servings <> 0 THEN target / servings::DOUBLE ELSE 1 END, 6) AS scaled FROM e LEFT JOIN cur ON cur.id = e.recipe_id, t",
        "oldest_plan": "SELECT plan_id FROM shopping_list_entry GROUP BY 1 ORDER BY min(added_at), plan_id LIMIT 1",
        "manifest_upsert": f"WITH {site} SELECT m.url, CASE WHEN m.status = 'ok' AND m.lastmod = site.lastmod THEN m.lastmod ELSE site.lastmod END AS lastmod, CASE WHEN m.status = 'ok' AND m.lastmod = site.lastmod THEN '2025-10-01' ELSE '2025-10-02' END AS scraped_at, 'ok' AS status FROM m JOIN site USING (url)",
        "error_head": f"WITH {site} SELECT url, lastmod FROM m WHERE status = 'error' ORDER BY url LIMIT 10",
        "draft_images": f"WITH {names} SELECT draft_id, n::INTEGER AS step_no, CASE WHEN s.image_url IS NOT NULL THEN '/images/drafts/' || draft_id || '/step-' || n || '.png' END AS image_url, CASE WHEN s.heading IS NOT NULL THEN '/images/drafts/' || draft_id || '/step-' || n || '-text.png' END AS text_url FROM s",
        "image_moves": f"WITH {names}, f AS (SELECT draft_id, 'step-' || n || '.png' AS file FROM s WHERE s.image_url IS NOT NULL UNION ALL SELECT draft_id, 'step-' || n || '-text.png' FROM s WHERE s.heading IS NOT NULL UNION ALL SELECT id, 'cover.png' FROM cur) SELECT '/images/drafts/' || draft_id || '/' || file AS source, CASE WHEN NOT contains(file, 'text') THEN '/images/pdf-' || draft_id || '/' || file END AS target FROM f JOIN cur ON cur.id = draft_id WHERE len(steps) > 2",
        "key_conflicts": " UNION ALL ".join(f"SELECT '{c}' AS columns, {c} AS value, count(*) AS rows FROM recipe GROUP BY 2 HAVING count(*) > 1" for c in ("id", "hf_id", "slug")),
        "step_presence": f"WITH {names} SELECT draft_id, max(n)::INTEGER AS last_step, string_agg(n::VARCHAR, ',' ORDER BY n) AS present FROM s WHERE s.image_url IS NOT NULL GROUP BY 1",
        "image_paths": f"WITH {CUR}, p AS (SELECT id, calories, regexp_replace(image_url, '^https?://[^/]*/', '') AS p FROM cur WHERE image_url IS NOT NULL) SELECT id, CASE WHEN calories % 3 = 0 THEN false WHEN calories % 3 = 1 THEN NOT contains(p, '/') AND NOT contains(p, '..') AND p NOT IN ('', '.') ELSE NOT contains(p, '..') AND p NOT IN ('', '.') AND replace(p, '/', '') <> '' END AS safe FROM p",
        "public_urls": f"WITH {CUR} SELECT id, 'db://user:***@host/base?a=1' AS with_others, source_url AS alone FROM cur WHERE source_url IS NOT NULL",
        "rested_pool": f"""WITH {CUR}, m AS (SELECT *, CASE WHEN name LIKE '%e%' THEN TIMESTAMP '2025-09-25' ELSE last_suggested_at::TIMESTAMP END AS seen_at FROM cur WHERE is_browsable AND NOT is_hidden AND variant_of_id IS NULL AND cook_minutes <= 40),
r AS (SELECT * FROM m WHERE seen_at IS NULL OR seen_at < TIMESTAMP '2025-10-01' - INTERVAL 14 DAY), a AS (SELECT * FROM r UNION ALL SELECT * FROM m WHERE (SELECT count(*) FROM r) < 3)
SELECT id, rating_value AS quality FROM a ORDER BY rating_value DESC NULLS FIRST, id LIMIT 400""",
    }

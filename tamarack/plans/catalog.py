"""Queries of the catalog: browsing, facets, pool, flags; with their DuckDB SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions.text import usable_image
from tamarack.operators import browse as B
from tamarack.operators import state as S
from tamarack.session import table

AS_OF = datetime(2025, 10, 1)
NUTRITION = ["calories", "fat_grams", "saturated_fat_grams", "carbs_grams", "sugar_grams", "protein_grams", "fiber_grams", "salt_grams"]
FILTER = ["is_browsable", "is_hidden", "variant_of_id", "protein_type", "cuisine", "calories", "cook_minutes", "name", "subtitle", "is_favourite", "is_pdf_import", "rating_value", "created_at", "last_suggested_at"]

CUR = "cur AS (SELECT * FROM recipe QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_scraped_at DESC, updated_at DESC) = 1)"
VISIBLE = "is_browsable AND NOT is_hidden AND variant_of_id IS NULL"


def _now(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return B.current(table(spark, sf_dir, "recipe"), *dict.fromkeys([*columns, "id"]))


BROWSE = B.BrowseParams(protein_types=["CHICKEN", "FISH", "VEGAN", "VEGETARIAN", "BEEF"], min_calories=300, max_minutes=40)
SEARCH = B.BrowseParams(search="MEADOW", sort="time", page=2, page_size=10)


def browse_page(spark, sf_dir):
    """The first page by rating."""
    return B.page(_now(spark, sf_dir, *FILTER, *B.SUMMARY), BROWSE).select(*B.SUMMARY)


def browse_count(spark, sf_dir):
    """Total and pages of the same filter."""
    return B.count(_now(spark, sf_dir, *FILTER), BROWSE)


def browse_search(spark, sf_dir):
    """Literal search in name and subtitle, second page by time."""
    return B.page(_now(spark, sf_dir, *FILTER), SEARCH).select("id", "name", "subtitle", "cook_minutes")


def browse_cuisine(spark, sf_dir):
    """Cuisine without regard to case, all flags."""
    p = B.BrowseParams(cuisine="coastal", show_all=True)
    return _now(spark, sf_dir, *FILTER).filter(B.predicate(p)).select("id", "cuisine")


def cuisines(spark, sf_dir):
    """Distinct cuisines, case kept."""
    return _now(spark, sf_dir, "cuisine").filter("cuisine is not null").select("cuisine").distinct().orderBy("cuisine")


def protein_counts(spark, sf_dir):
    """Recipes by protein type with its label."""
    return _now(spark, sf_dir, "protein_type").groupBy("protein_type").agg(F.count("*").alias("recipes")).withColumn("label", B.label(F.col("protein_type")))


def preset_counts(spark, sf_dir):
    """Recipes by preset range of calories and minutes."""
    rows = _now(spark, sf_dir, "calories", "cook_minutes")
    return rows.groupBy(B.preset_of(F.col("calories"), B.CALORIE_PRESETS).alias("calories"), B.preset_of(F.col("cook_minutes"), B.MINUTE_PRESETS).alias("minutes")).agg(F.count("*").alias("recipes"))


def nutrition_flags(spark, sf_dir):
    """Recipes by whether they have nutrition and a usable image."""
    rows = _now(spark, sf_dir, *NUTRITION, "image_url")
    return rows.groupBy(B.has_nutrition(NUTRITION).alias("has_nutrition"), usable_image(F.col("image_url")).alias("has_image")).agg(F.count("*").alias("recipes"))


def completeness(spark, sf_dir):
    """Completeness and the derived browsable flag of every recipe, with its ingredient list."""
    sets = table(spark, sf_dir, "recipe_ingredient_set").groupBy(F.col("recipe_id").alias("id")).agg(F.max(F.size("ingredient_ids")).alias("n"))
    rows = _now(spark, sf_dir, "steps", "rating_count", "image_url").join(sets, "id", "left")
    listed = F.sequence(F.lit(1), F.coalesce("n", F.lit(0)))
    flag = B.browsable(F.col("steps"), F.col("image_url"), F.when(F.col("n") > 0, listed).otherwise(F.array().cast("array<int>")))
    return rows.select("id", B.completeness(F.col("steps"), F.col("rating_count")).alias("completeness"), flag.alias("browsable"))


def candidate_pool(spark, sf_dir):
    """The best-rated candidates that have rested."""
    marked = S.mark_suggested(_now(spark, sf_dir, *FILTER), _now(spark, sf_dir, "name").filter("name like '%a'").select("id"), datetime(2025, 9, 25))
    return B.pool(marked, B.BrowseParams(max_calories=700), AS_OF).select("id", "rating_value")


def point_lookup(spark, sf_dir):
    """The recipes of one slug pattern by key (the least slug)."""
    rows = _now(spark, sf_dir, "slug", "name")
    return rows.join(F.broadcast(rows.agg(F.min("slug").alias("slug"))), "slug", "left_semi").select("id", "slug", "name")


def catalog_summary(spark, sf_dir):
    """Counts of the catalog."""
    rows = _now(spark, sf_dir, "calories", "is_browsable", "is_published", "steps")
    return rows.agg(F.count("*").alias("recipes"), F.count("calories").alias("with_calories"), F.count_if("is_browsable").alias("browsable"), F.count_if(~F.col("is_published")).alias("unpublished"), F.sum(F.size("steps")).alias("steps"))


def current_recipes(spark, sf_dir):
    """The current row of each recipe."""
    return _now(spark, sf_dir, "slug", "cuisine", "calories", "rating_value", "is_active")


def toggle_favourites(spark, sf_dir):
    """A flag turned for the recipes of one cuisine."""
    rows = _now(spark, sf_dir, "cuisine", "is_favourite")
    return S.toggle(rows, rows.filter("cuisine = 'Coastal'").select("id"), "is_favourite").select("id", "is_favourite")


def clone_recipes(spark, sf_dir):
    """Copies of the favourites' names and flags."""
    cols = ["name", "slug", "is_user_created", "is_favourite", "is_hidden", "rating_value", "rating_count", "variant_of_id", "created_at", "updated_at", "cloned_from_id", "calories"]
    rows = _now(spark, sf_dir, *cols)
    return S.clone(rows, rows.filter("calories > 800").select("id"), AS_OF).select("cloned_from_id", "name", "slug", "is_user_created", "is_favourite", "rating_value", "calories")


def upsert_recipes(spark, sf_dir):
    """Recipes updated by a second crawl (older rows stand for it), flags kept."""
    cols = ["hf_id", "name", "is_favourite", "protein_type", "protein_type_manual_override", "calories"]
    rows = _now(spark, sf_dir, *cols)
    new = rows.filter("calories > 500").withColumns({"name": F.upper("name"), "is_favourite": ~F.col("is_favourite"), "protein_type": F.lit("VEGAN"), "id": F.concat(F.lit("x"), "id")})
    extra = rows.filter("calories > 900").withColumns({"hf_id": F.concat("hf_id", F.lit("n")), "id": F.concat(F.lit("n"), "id")})
    return S.upsert(rows, new.unionByName(extra), "hf_id", override="protein_type_manual_override", overridden="protein_type").select("id", "hf_id", "name", "is_favourite", "protein_type")


def recode_types(spark, sf_dir):
    """An enumeration recoded in one pass."""
    kind = F.when(F.col("protein_type").isin("MEAT_OTHER", "VENISON", "DUCK"), "MEAT").otherwise(F.col("protein_type"))
    return _now(spark, sf_dir, "protein_type").select("id", kind.alias("kind"))


QUERIES = [browse_page, browse_count, browse_search, browse_cuisine, cuisines, protein_counts, preset_counts, nutrition_flags, completeness, candidate_pool, point_lookup, catalog_summary, current_recipes, toggle_favourites, clone_recipes, upsert_recipes, recode_types]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    w = f"{VISIBLE} AND protein_type IN ('CHICKEN', 'FISH', 'VEGAN', 'VEGETARIAN', 'BEEF') AND calories >= 300 AND cook_minutes <= 40"
    labels = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in B.PROTEIN_LABELS.items())
    nutrition = f"coalesce({', '.join(f'{c}::DOUBLE' for c in NUTRITION)}) IS NOT NULL"
    usable = "coalesce(length(image_url) > 0 AND NOT suffix(image_url, '/'), false)"
    return {
        "browse_page": f"WITH {CUR} SELECT {', '.join(B.SUMMARY)} FROM cur WHERE {w} ORDER BY rating_value DESC NULLS FIRST, id LIMIT 24",
        "browse_count": f"WITH {CUR} SELECT count(*) AS total, greatest(1, ceil(count(*) / 24))::BIGINT AS pages FROM cur WHERE {w}",
        "browse_search": f"WITH {CUR} SELECT id, name, subtitle, cook_minutes FROM cur WHERE {VISIBLE} AND (contains(lower(name), 'meadow') OR contains(lower(coalesce(subtitle, '')), 'meadow')) ORDER BY cook_minutes ASC NULLS LAST, id LIMIT 10 OFFSET 10",
        "browse_cuisine": f"WITH {CUR} SELECT id, cuisine FROM cur WHERE is_browsable AND NOT is_hidden AND lower(cuisine) = 'coastal'",
        "cuisines": f"WITH {CUR} SELECT DISTINCT cuisine FROM cur WHERE cuisine IS NOT NULL",
        "protein_counts": f"WITH {CUR} SELECT protein_type, count(*) AS recipes, CASE protein_type {labels} END AS label FROM cur GROUP BY 1",
        "preset_counts": f"WITH {CUR} SELECT CASE WHEN calories <= 399 THEN 'under-400' WHEN calories BETWEEN 400 AND 700 THEN '400-700' WHEN calories >= 701 THEN 'over-700' END AS calories, CASE WHEN cook_minutes <= 19 THEN 'under-20' WHEN cook_minutes BETWEEN 20 AND 40 THEN '20-40' WHEN cook_minutes >= 41 THEN 'over-40' END AS minutes, count(*) AS recipes FROM cur GROUP BY 1, 2",
        "nutrition_flags": f"WITH {CUR} SELECT {nutrition} AS has_nutrition, {usable} AS has_image, count(*) AS recipes FROM cur GROUP BY 1, 2",
        "completeness": f"WITH {CUR}, s AS (SELECT recipe_id AS id, max(len(ingredient_ids)) AS n FROM recipe_ingredient_set GROUP BY 1) SELECT cur.id, (coalesce(len(steps), 0) * 1000 + coalesce(rating_count, 0))::BIGINT AS completeness, coalesce(n, 0) > 0 AND len(steps) > 1 AND {usable} AS browsable FROM cur LEFT JOIN s ON s.id = cur.id",
        "candidate_pool": f"WITH {CUR}, m AS (SELECT *, CASE WHEN name LIKE '%a' THEN TIMESTAMP '2025-09-25' ELSE last_suggested_at::TIMESTAMP END AS seen_at FROM cur) SELECT id, rating_value FROM m WHERE {VISIBLE} AND calories <= 700 AND (seen_at IS NULL OR seen_at < TIMESTAMP '2025-10-01' - INTERVAL 14 DAY) ORDER BY rating_value DESC NULLS FIRST, id LIMIT 400",
        "point_lookup": f"WITH {CUR} SELECT id, slug, name FROM cur WHERE slug = (SELECT min(slug) FROM cur)",
        "catalog_summary": f"WITH {CUR} SELECT count(*) AS recipes, count(calories) AS with_calories, count(*) FILTER (is_browsable) AS browsable, count(*) FILTER (NOT is_published) AS unpublished, sum(len(steps))::BIGINT AS steps FROM cur",
        "current_recipes": f"WITH {CUR} SELECT id, slug, cuisine, calories, rating_value, is_active FROM cur",
        "toggle_favourites": f"WITH {CUR} SELECT id, CASE WHEN cuisine = 'Coastal' THEN NOT is_favourite ELSE is_favourite END AS is_favourite FROM cur",
        "clone_recipes": f"WITH {CUR} SELECT id AS cloned_from_id, name || ' (Custom)' AS name, slug || '-custom' AS slug, true AS is_user_created, false AS is_favourite, NULL::DOUBLE AS rating_value, calories FROM cur WHERE calories > 800",
        "upsert_recipes": f"WITH {CUR} SELECT id, hf_id, CASE WHEN calories > 500 THEN upper(name) ELSE name END AS name, is_favourite, CASE WHEN calories > 500 AND NOT coalesce(protein_type_manual_override, false) THEN 'VEGAN' ELSE protein_type END AS protein_type FROM cur UNION ALL SELECT 'n' || id, hf_id || 'n', name, is_favourite, protein_type FROM cur WHERE calories > 900",
        "recode_types": f"WITH {CUR} SELECT id, CASE WHEN protein_type IN ('MEAT_OTHER', 'VENISON', 'DUCK') THEN 'MEAT' ELSE protein_type END AS kind FROM cur",
    }

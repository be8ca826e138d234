"""Queries of the page ETL and of changes of plans and recipes; with their DuckDB SQL.

Pages are built in the query from the recipe table: the linked data and the page's own record are
written as JSON into HTML and parsed back, so the oracle is the table itself.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators import browse, ingest, state
from tamarack.plans.baskets import CUR, E, _entries
from tamarack.session import table

AT = datetime(2025, 10, 1)
PAGE = ["slug", "name", "subtitle", "cuisine", "category", "cook_minutes", "servings", "calories", "fat_grams", "rating_value", "is_published", "is_active", "steps", "source_url", "updated_at", "is_user_created"]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = browse.current(table(spark, sf_dir, "recipe"), *PAGE).filter("source_url is not null")
    text = lambda c, tail="": F.concat(F.col(c).cast("string"), F.lit(tail))
    ld = F.to_json(
        F.struct(
            F.when(F.col("calories") % 7 == 0, "Thing").otherwise("Recipe").alias("@type"),
            F.concat_ws("  ", "name", "subtitle").alias("name"),
            F.col("cuisine").alias("recipeCuisine"),
            F.col("category").alias("recipeCategory"),
            F.concat(F.lit("PT"), text("cook_minutes"), F.lit("M")).alias("totalTime"),
            F.array(F.concat(F.lit("Serves "), text("servings"))).alias("recipeYield"),
            F.array(F.lit("2 unit(s) Onion"), F.lit("½ tbsp Oil")).alias("recipeIngredient"),
            F.struct(text("calories", " kcal").alias("calories"), text("fat_grams", " g").alias("fatContent")).alias("nutrition"),
            F.struct(F.col("rating_value").alias("ratingValue")).alias("aggregateRating"),
        )
    )
    step = F.transform("steps", lambda s: F.struct(F.concat(F.lit("<p>"), s["text"], F.lit("</p>")).alias("instructionsHTML"), F.array(F.struct(F.lit("/a.jpg").alias("path"), s["caption"].alias("caption"))).alias("images")))
    app = F.to_json(F.struct(F.struct(F.struct(F.struct(F.struct(F.col("is_published").alias("isPublished"), F.col("is_active").alias("active"), step.alias("steps")).alias("recipe")).alias("ssrPayload")).alias("pageProps")).alias("props")))
    graph = F.concat(F.lit('{"@graph":[{"@type":"WebPage"},'), ld, F.lit("]}"))
    html = F.concat(F.lit('<html><script type="application/ld+json">not json</script><script type="application/ld+json">'), graph, F.lit('</script><script id="__NEXT_DATA__" type="application/json">'), app, F.lit("</script></html>"))
    return now.select(F.col("source_url").alias("url"), html.alias("html"))


def parsed_pages(spark, sf_dir):
    """Fields of every page that has a recipe."""
    rows = ingest.parse_pages(_pages(spark, sf_dir)).filter("error is null")
    return rows.select("url", "slug", "name", "subtitle", "cuisine", "category", "cook_minutes", "servings", "calories", "fat_grams", "rating_value", "is_published", "is_active", F.size("ingredients").alias("lines"))


def page_errors(spark, sf_dir):
    """Pages without a recipe."""
    return ingest.parse_pages(_pages(spark, sf_dir)).filter("error is not null").select("url", "error")


def page_steps(spark, sf_dir):
    """Steps of every good page with their images."""
    rows = ingest.parse_pages(_pages(spark, sf_dir), "https://img.example").filter("error is null")
    return rows.select("url", F.posexplode("steps").alias("pos", "s")).select("url", "pos", "s.text", "s.image_url", "s.caption")


def _manifest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    now = browse.current(table(spark, sf_dir, "recipe"), "source_url", "updated_at", "calories")
    day = F.date_format("updated_at", "yyyy-MM-dd")
    site = now.filter("source_url is not null").groupBy(F.col("source_url").alias("url")).agg(F.max(day).alias("lastmod"), F.min("id").alias("position"), F.max("calories").alias("calories"))
    status = F.when(F.col("calories") % 3 == 0, "ok").when(F.col("calories") % 3 == 1, "error").otherwise("skipped")
    return site, site.select("url", F.when(F.col("calories") % 2 == 0, F.col("lastmod")).otherwise("2020-01-01").alias("lastmod"), status.alias("status"))


def pending_pages(spark, sf_dir):
    """Pages that must be fetched again."""
    return ingest.pending(*_manifest(spark, sf_dir)).select("url")


def first_pending(spark, sf_dir):
    """The first pending pages in sitemap order."""
    return ingest.first_pending(ingest.pending(*_manifest(spark, sf_dir)), 20).select("url", "position")


def spread_sample(spark, sf_dir):
    """Fifty pages evenly spaced over the sitemap."""
    return ingest.spread_sample(_manifest(spark, sf_dir)[0], 50).select("url", "position")


def run_report(spark, sf_dir):
    """Conditional counts of a run."""
    return ingest.run_report(_manifest(spark, sf_dir)[1])


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("plan_id", "recipe_id").distinct().withColumn("servings", F.lit(2))


def plan_changes(spark, sf_dir):
    """Servings set, recipes removed, one recipe added to every plan."""
    plan = _plan(spark, sf_dir)
    low = plan.filter("recipe_id < 'c4'").select("plan_id", "recipe_id", F.when(F.col("recipe_id") < "c2", 0.0).otherwise(4.0).alias("value"))
    out = state.plan_servings(plan, low)
    out = state.plan_remove(out, plan.filter("recipe_id >= 'cf'").select("plan_id", "recipe_id"))
    return state.plan_add(out, plan.select("plan_id").distinct().withColumn("recipe_id", F.lit("c-added"))).select("plan_id", "recipe_id", "servings")


def _own(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = browse.current(table(spark, sf_dir, "recipe"), "name", "calories", "is_user_created", "variant_of_id", "cloned_from_id")
    first = rows.agg(F.min(F.when(F.col("is_user_created"), F.col("id"))).alias("_first"))
    return rows.crossJoin(F.broadcast(first)).withColumn("variant_of_id", F.when(F.col("calories") > 900, F.col("_first"))).drop("_first")  # one row


def edited_recipes(spark, sf_dir):
    """Names of user-created recipes edited, others left."""
    rows = _own(spark, sf_dir)
    return state.edit(rows, rows.select("id", F.upper("name").alias("name"))).select("id", "name")


def deleted_recipes(spark, sf_dir):
    """User-created recipes removed, references to them cleared."""
    rows = _own(spark, sf_dir)
    return state.delete(rows, rows.select("id")).select("id", "variant_of_id")


def replaced_lines(spark, sf_dir):
    """Ingredient rows of some recipes replaced as a whole."""
    rows = table(spark, sf_dir, "edited_ingredient").select("edit_id", "recipe_id", "name").distinct()
    new = rows.filter("recipe_id < 'c8' and edit_id % 3 = 0").withColumn("name", F.lower("name"))
    return state.replace_children(rows, new, "recipe_id")


QUERIES = [parsed_pages, page_errors, page_steps, pending_pages, first_pending, spread_sample, run_report, plan_changes, edited_recipes, deleted_recipes, replaced_lines]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    bad = "coalesce(calories % 7 = 0, false)"
    site = f"{CUR}, site AS (SELECT source_url AS url, max(strftime(updated_at, '%Y-%m-%d')) AS lastmod, min(id) AS position, max(calories) AS calories FROM cur WHERE source_url IS NOT NULL GROUP BY 1), m AS (SELECT url, CASE WHEN calories % 2 = 0 THEN lastmod ELSE '2020-01-01' END AS lastmod, CASE WHEN calories % 3 = 0 THEN 'ok' WHEN calories % 3 = 1 THEN 'error' ELSE 'skipped' END AS status FROM site)"
    pending = "SELECT * FROM site WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.url = site.url AND m.lastmod = site.lastmod AND m.status = 'ok')"
    own = f"{CUR}, f AS (SELECT min(id) FILTER (is_user_created) AS f FROM cur)"
    return {
        "parsed_pages": f"WITH {CUR} SELECT source_url AS url, regexp_extract(source_url, '([^/]+)/*$', 1) AS slug, name, subtitle, nullif(trim(cuisine), '') AS cuisine, nullif(trim(category), '') AS category, cook_minutes, servings, calories, fat_grams, rating_value, is_published, is_active, 2 AS lines FROM cur WHERE source_url IS NOT NULL AND NOT {bad}",
        "page_errors": f"WITH {CUR} SELECT source_url AS url, 'no recipe, name or ingredients' AS error FROM cur WHERE source_url IS NOT NULL AND {bad}",
        "page_steps": f"WITH {CUR}, x AS (SELECT source_url AS url, unnest(steps) AS s, generate_subscripts(steps, 1) - 1 AS pos FROM cur WHERE source_url IS NOT NULL AND NOT {bad}) SELECT url, (row_number() OVER (PARTITION BY url ORDER BY pos) - 1)::INTEGER AS pos, trim(s.text) AS text, 'https://img.example/a.jpg' AS image_url, s.caption AS caption FROM x WHERE trim(s.text) <> ''",
        "pending_pages": f"WITH {site} SELECT url FROM ({pending})",
        "first_pending": f"WITH {site} SELECT url, position FROM ({pending}) ORDER BY position LIMIT 20",
        "spread_sample": f"WITH {site}, r AS (SELECT url, position, row_number() OVER (ORDER BY position) - 1 AS k, count(*) OVER () AS n FROM site) SELECT url, position FROM r WHERE k IN (SELECT floor(i * (n - 1) / 49)::BIGINT FROM range(50) t(i)) OR n <= 50",
        "run_report": f"WITH {site} SELECT count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'skipped') AS skipped FROM m",
        "plan_changes": f"WITH {E}, p AS (SELECT DISTINCT plan_id, recipe_id FROM e) SELECT plan_id, recipe_id, CASE WHEN recipe_id < 'c2' THEN NULL WHEN recipe_id < 'c4' THEN 4 ELSE 2 END AS servings FROM p WHERE recipe_id < 'cf' UNION ALL SELECT DISTINCT plan_id, 'c-added', NULL FROM p",
        "edited_recipes": f"WITH {CUR} SELECT id, CASE WHEN is_user_created THEN upper(name) ELSE name END AS name FROM cur",
        "deleted_recipes": f"WITH {own} SELECT id, NULL::VARCHAR AS variant_of_id FROM cur WHERE NOT is_user_created",
        "replaced_lines": "WITH r AS (SELECT DISTINCT edit_id, recipe_id, name FROM edited_ingredient), n AS (SELECT * FROM r WHERE recipe_id < 'c8' AND edit_id % 3 = 0) SELECT * FROM r WHERE recipe_id NOT IN (SELECT recipe_id FROM n) UNION ALL SELECT edit_id, recipe_id, lower(name) FROM n",
    }

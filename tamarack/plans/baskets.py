"""Queries of baskets, similarity and suggestion; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators import basket, browse, packed, similarity, suggest
from tamarack.plans.catalog import CUR
from tamarack.session import materialize, table

LEAST, THRESHOLD = 6, 0.8


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shopping entries, repeated ids once."""
    return table(spark, sf_dir, "shopping_list_entry").select("entry_id", "plan_id", "recipe_id", "ingredient_id", "quantity", "unit", "raw_text").dropDuplicates(["entry_id"])


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = browse.current(table(spark, sf_dir, "recipe"), "name", "servings")
    recipes = now.select(F.col("id").alias("recipe_id"), F.col("name").alias("recipe_name"), "servings")
    planned = now.filter("servings = 2").select(F.col("id").alias("recipe_id"), F.lit(4).alias("planned"))
    return basket.scaled_entries(_entries(spark, sf_dir), recipes, planned)


def shared_ingredients(spark, sf_dir):
    """A4 A5: entries and recipes of each ingredient, shared or not."""
    return basket.ingredient_groups(_entries(spark, sf_dir))


def unit_totals(spark, sf_dir):
    """Totals by ingredient and unit, no unit being one of its own."""
    return basket.unit_totals(_entries(spark, sf_dir)).select("ingredient_id", "unit", F.round("total", 6).alias("total"))


def scaled_totals(spark, sf_dir):
    """Totals after scaling to planned servings."""
    return basket.unit_totals(_scaled(spark, sf_dir)).select("ingredient_id", "unit", F.round("total", 6).alias("total"))


def shopping_lists(spark, sf_dir):
    """The printable list of every plan; entries without a plan are on none."""
    names = table(spark, sf_dir, "ingredient").select(F.col("id").alias("ingredient_id"), "canonical_name")
    return basket.ordered_lines(basket.shopping_lines(_entries(spark, sf_dir).filter("plan_id is not null"), names, "plan_id"), "plan_id")


def plan_recipes(spark, sf_dir):
    """Recipes of each plan with their current names."""
    now = browse.current(table(spark, sf_dir, "recipe"), "name")
    return _entries(spark, sf_dir).select("plan_id", F.col("recipe_id").alias("id")).distinct().join(now, "id").groupBy("plan_id").agg(F.count("*").alias("recipes"), F.min("name").alias("first_name"))


def plan_marks(spark, sf_dir):
    """Every recipe with a mark whether some plan has it."""
    marked = _entries(spark, sf_dir).select(F.col("recipe_id").alias("id")).distinct().withColumn("in_plan", F.lit(True))
    return browse.current(table(spark, sf_dir, "recipe"), "slug").join(marked, "id", "left").select("id", F.coalesce("in_plan", F.lit(False)).alias("in_plan"))


def set_scores(spark, sf_dir):
    """How many ingredients the recipes of each plan save by sharing."""
    return suggest.set_scores(_entries(spark, sf_dir).select(F.col("plan_id").alias("set_id"), "recipe_id", F.col("ingredient_id").alias("item")))


def _greatest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("recipe_id").agg(F.max(F.struct("completeness_score", "ingredient_ids")).alias("r")).select("recipe_id", "r.*")


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list for each recipe: of repeated rows the greatest."""
    return _greatest(table(spark, sf_dir, "recipe_ingredient_set"))


def idf_weights(spark, sf_dir):
    """Document frequency and weight of each ingredient."""
    sets = _sets(spark, sf_dir)
    items = similarity.multiset(sets, "recipe_id", "ingredient_ids")
    return similarity.weights(items, sets.count()).select("item", "df", F.round("idf", 9).alias("idf"))


def basket_overlaps(spark, sf_dir):
    """Directed weighted overlap of recipes that share at least six ingredients."""
    rows = table(spark, sf_dir, "recipe_ingredient_set").select("recipe_id", "completeness_score", "ingredient_ids")
    names = packed.item_names(rows, "ingredient_ids")
    lists = _greatest(packed.coded(rows, "ingredient_ids", names) if names is not None else rows)
    return similarity.list_overlaps(lists, "recipe_id", "ingredient_ids", names, LEAST, digits=6)


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Recipes with their distinct ingredients, and the links between those that overlap enough."""
    sets = materialize(_sets(spark, sf_dir).withColumn("ingredient_ids", F.array_distinct("ingredient_ids")))
    return sets, similarity.similar_edges(similarity.multiset(sets, "recipe_id", "ingredient_ids"), sets.count(), THRESHOLD, LEAST)


def variant_edges(spark, sf_dir):
    """The links that variants come from."""
    return _edges(spark, sf_dir)[1].withColumn("overlap", F.round("overlap", 6))


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets, edges = _edges(spark, sf_dir)
    return similarity.star_clusters(sets.select(F.col("recipe_id").alias("id"), F.col("completeness_score").alias("score")), edges)


def variant_clusters(spark, sf_dir):
    """Each variant and its primary."""
    return _clusters(spark, sf_dir)


def variant_sizes(spark, sf_dir):
    """Variants of each primary."""
    return _clusters(spark, sf_dir).groupBy("primary_id").agg(F.count("*").alias("variants"))


def variant_write_back(spark, sf_dir):
    """Recipes with their cluster written back."""
    now = browse.current(table(spark, sf_dir, "recipe"), "slug", "variant_of_id")
    return similarity.write_back(now, _clusters(spark, sf_dir)).select("id", "variant_of_id")


def _combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = browse.current(table(spark, sf_dir, "recipe"), *["is_browsable", "is_hidden", "variant_of_id", "protein_type", "cuisine", "calories", "cook_minutes", "name", "subtitle", "rating_value", "is_favourite", "is_pdf_import"])
    pool = browse.pool(now, browse.BrowseParams())
    sets = _sets(spark, sf_dir).select(F.col("recipe_id").alias("id"), F.array_distinct("ingredient_ids").alias("items"))
    return suggest.combinations(pool.join(sets, "id", "left").select("id", "items", F.col("rating_value").alias("quality")), suggest.meal_count(3))


def suggest_combos(spark, sf_dir):
    """Distinct grown combinations with their scores."""
    return _combos(spark, sf_dir).select(F.array_join("recipe_ids", ",").alias("recipes"), "score", "seed_pos")


def suggest_top(spark, sf_dir):
    """The best disjoint combinations."""
    return suggest.top_disjoint(_combos(spark, sf_dir)).select("rank", F.array_join("recipe_ids", ",").alias("recipes"), "score")


QUERIES = [shared_ingredients, unit_totals, scaled_totals, shopping_lists, plan_recipes, plan_marks, set_scores, idf_weights, basket_overlaps, variant_edges, variant_clusters, variant_sizes, variant_write_back, suggest_combos, suggest_top]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


E = "e AS (SELECT DISTINCT ON (entry_id) entry_id, plan_id, recipe_id, ingredient_id, quantity, unit, raw_text FROM shopping_list_entry)"
SETS = "s AS (SELECT recipe_id, ingredient_ids FROM recipe_ingredient_set QUALIFY row_number() OVER (PARTITION BY recipe_id ORDER BY completeness_score DESC, ingredient_ids DESC) = 1)"
ITEMS = f"{SETS}, i AS (SELECT recipe_id AS id, item, count(*) AS times FROM (SELECT recipe_id, unnest(ingredient_ids) AS item FROM s) GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM s), w AS (SELECT item, count(*) AS df, ln((any_value(n) + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM i, n GROUP BY 1)"


def oracle_sql() -> dict[str, str]:
    number = "CASE WHEN h % 100 = 0 THEN (h // 100)::VARCHAR ELSE (h // 100)::VARCHAR || '.' || rtrim(lpad((h % 100)::VARCHAR, 2, '0'), '0') END"
    return {
        "shared_ingredients": f"WITH {E} SELECT ingredient_id, count(*) AS entries, count(DISTINCT recipe_id) AS recipe_count, count(DISTINCT recipe_id) >= 2 AS is_shared FROM e GROUP BY 1",
        "unit_totals": f"WITH {E} SELECT ingredient_id, unit, round(sum(quantity), 6) AS total FROM e WHERE quantity IS NOT NULL GROUP BY 1, 2",
        "scaled_totals": f"WITH {E}, {CUR} SELECT ingredient_id, unit, round(sum(quantity * CASE WHEN servings = 2 THEN 2 ELSE 1 END), 6) AS total FROM e LEFT JOIN cur ON cur.id = e.recipe_id WHERE quantity IS NOT NULL GROUP BY 1, 2",
        "shopping_lists": f"""WITH {E}, o AS (SELECT * FROM e WHERE plan_id IS NOT NULL),
t AS (SELECT plan_id, ingredient_id, unit, floor(sum(quantity) * 100 + 0.5)::BIGINT AS h FROM o WHERE quantity IS NOT NULL GROUP BY 1, 2, 3),
p AS (SELECT plan_id, ingredient_id, string_agg({number} || CASE WHEN coalesce(unit, '') = '' THEN '' ELSE ' ' || unit END, ' + ' ORDER BY coalesce(unit, '')) AS q FROM t GROUP BY 1, 2),
g AS (SELECT plan_id, ingredient_id, count(*) AS entries, count(DISTINCT recipe_id) AS recipe_count FROM o GROUP BY 1, 2)
SELECT g.plan_id, g.ingredient_id, canonical_name, recipe_count >= 2 AS is_shared, recipe_count, upper(canonical_name[1]) || canonical_name[2:] || ' - ' || coalesce(q, 'x' || entries) AS line FROM g LEFT JOIN p USING (plan_id, ingredient_id) JOIN ingredient i ON i.id = g.ingredient_id""",
        "plan_recipes": f"WITH {E}, {CUR} SELECT plan_id, count(*) AS recipes, min(name) AS first_name FROM (SELECT DISTINCT plan_id, recipe_id FROM e) x JOIN cur ON cur.id = x.recipe_id GROUP BY 1",
        "plan_marks": f"WITH {E}, {CUR} SELECT id, id IN (SELECT recipe_id FROM e WHERE recipe_id IS NOT NULL) AS in_plan FROM cur",
        "set_scores": f"WITH {E} SELECT plan_id AS set_id, sum(greatest(0, k - 1))::BIGINT AS score FROM (SELECT plan_id, ingredient_id, count(DISTINCT recipe_id) AS k FROM e GROUP BY 1, 2) GROUP BY 1",
        "idf_weights": f"WITH {ITEMS} SELECT item, df, round(idf, 9) AS idf FROM w",
        "variant_edges": f"""WITH {ITEMS}, d AS (SELECT id, item, idf FROM i JOIN w USING (item)), t AS (SELECT id, sum(idf) AS weight FROM d GROUP BY 1),
c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS shared, sum(a.idf) AS common FROM d a JOIN d b ON a.item = b.item AND a.id <> b.id GROUP BY 1, 2 HAVING count(*) >= {LEAST})
SELECT id_a, id_b, shared, round(common / least(ta.weight, tb.weight), 6) AS overlap FROM c JOIN t ta ON ta.id = id_a JOIN t tb ON tb.id = id_b WHERE round(common / least(ta.weight, tb.weight), 9) >= {THRESHOLD}""",
        "basket_overlaps": f"""WITH {ITEMS}, x AS (SELECT i.*, idf FROM i JOIN w USING (item)), t AS (SELECT id, sum(times * idf) AS weight FROM x GROUP BY 1),
c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS shared, sum(a.times * a.idf) AS common FROM x a JOIN x b ON a.item = b.item AND a.id <> b.id GROUP BY 1, 2 HAVING count(*) >= {LEAST})
SELECT id_a, id_b, shared, round(common / least(ta.weight, tb.weight), 6) AS overlap FROM c JOIN t ta ON ta.id = id_a JOIN t tb ON tb.id = id_b""",
    }

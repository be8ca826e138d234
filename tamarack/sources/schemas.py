"""Schemas of the persistent tables, as DDL, and empty tables of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "recipe": "id string not null, hf_id string not null, slug string not null, name string not null, subtitle string, description string, image_url string, source_url string, cuisine string, category string, cook_minutes int, servings int, calories int, rating_count int, fat_grams double, saturated_fat_grams double, carbs_grams double, sugar_grams double, protein_grams double, fiber_grams double, salt_grams double, rating_value double, protein_type string not null, steps array<struct<heading:string,text:string,image_url:string,caption:string>> not null, protein_type_manual_override boolean not null, is_published boolean not null, is_active boolean not null, is_browsable boolean not null, is_favourite boolean not null, is_hidden boolean not null, is_user_created boolean not null, is_pdf_import boolean not null, variant_of_id string, cloned_from_id string, last_suggested_at timestamp, last_scraped_at timestamp not null, created_at timestamp not null, updated_at timestamp not null",
    "ingredient": "id string not null, canonical_name string not null, category string not null",
    "ingredient_alias": "id string not null, raw_text string not null, ingredient_id string not null",
    "recipe_ingredient": "id string not null, recipe_id string not null, ingredient_id string not null, raw_text string not null, quantity double, unit string",
    "meal_plan": "id string not null, label string not null, created_at timestamp not null",
    "meal_plan_recipe": "id string not null, meal_plan_id string not null, recipe_id string not null, servings int",
    "import_draft": "id string not null, original_filename string not null, template_id string not null, data variant, created_at timestamp not null",
}
# Columns of which no value may stand in two rows.
UNIQUE = {"recipe": [["id"], ["hf_id"], ["slug"]], "ingredient": [["id"], ["canonical_name"]], "ingredient_alias": [["id"], ["raw_text"]], "meal_plan_recipe": [["id"], ["meal_plan_id", "recipe_id"]]}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def create(spark: SparkSession, name: str, path: str) -> None:
    """An empty table as Parquet; an existing one is an error."""
    empty(spark, name).write.mode("error").parquet(path)


def repeated_keys(df: DataFrame, name: str) -> DataFrame:
    """(columns, value, rows) of every value that stands in more rows than its table allows; nulls may repeat."""
    found = None
    for key in UNIQUE.get(name, []):
        text = ", ".join(f"cast({c} as string)" for c in key)
        one = df.filter(" and ".join(f"{c} is not null" for c in key)).selectExpr(f"'{','.join(key)}' as columns", f"concat_ws(',', {text}) as value").groupBy("columns", "value").count().filter("count > 1").withColumnRenamed("count", "rows")
        found = one if found is None else found.unionByName(one)
    return found if found is not None else df.sparkSession.createDataFrame([], "columns string, value string, rows bigint")

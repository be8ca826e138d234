"""Basket analytics: which recipes share ingredients, and shopping totals by unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.text import capitalize, plain_number
from tamarack.session import small_or_join


def scale(base: Column, target: Column) -> Column:
    """Target over base servings; 1 unless both are there and not zero."""
    return F.when((base != 0) & (target != 0), target / base).otherwise(F.lit(1.0))


def scaled_entries(entries: DataFrame, recipes: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Entries with quantities scaled to the planned servings; unknown recipes keep theirs.

    ``entries``: recipe_id, ingredient_id, quantity, unit, raw_text; ``recipes``: recipe_id, recipe_name,
    servings; ``overrides``: recipe_id, planned.
    """
    out = entries.join(recipes, "recipe_id", "left")
    out = out.join(overrides, "recipe_id", "left") if overrides is not None else out.withColumn("planned", F.lit(None).cast("int"))
    return out.withColumns({"quantity": F.col("quantity") * scale(F.col("servings"), F.col("planned")), "recipe_name": F.coalesce("recipe_name", F.lit("Unknown recipe"))}).drop("planned", "servings")


def scaled_views(lines: DataFrame, servings: Column, targets: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """Each line once for each number of people, with its quantity scaled; a missing quantity stays missing."""
    each = lines.withColumn("target", F.explode(F.array(*map(F.lit, targets))))
    return each.withColumn("scaled", F.col("quantity") * scale(servings, F.col("target")))


def unit_totals(entries: DataFrame, *by: str) -> DataFrame:
    """(*by, ingredient_id, unit, total): sums by unit, a missing unit being a unit of its own; missing quantities are left out."""
    return entries.filter("quantity is not null").groupBy(*by, "ingredient_id", "unit").agg(F.sum("quantity").alias("total"))


def ingredient_groups(entries: DataFrame, *by: str) -> DataFrame:
    """(*by, ingredient_id, entries, recipe_count, is_shared). Counts combine on the map side; no entry lists are built."""
    n = F.count_distinct("recipe_id")
    return entries.groupBy(*by, "ingredient_id").agg(F.count("*").alias("entries"), n.alias("recipe_count"), (n >= 2).alias("is_shared"))


def with_entries(entries: DataFrame) -> DataFrame:
    """(ingredient_id, items): the entries of each ingredient as one array, for plans of a few recipes."""
    return entries.groupBy("ingredient_id").agg(F.array_sort(F.collect_list(F.struct("recipe_id", "quantity", "unit", "raw_text"))).alias("items"))


def shopping_lines(entries: DataFrame, ingredients: DataFrame, *by: str) -> DataFrame:
    """One line of text for each ingredient, or for each ingredient of each ``by``: shared ones first, then by number of recipes and name.

    The columns ``by`` are not null. Quantities of several units are joined with a plus; without any the number of entries stands.
    """
    totals = unit_totals(entries, *by).withColumn("part", F.concat_ws(" ", plain_number(F.col("total")), F.nullif("unit", F.lit(""))))
    parts = totals.groupBy(*by, "ingredient_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("unit", F.lit("")).alias("u"), "part"))).alias("parts"))
    rows = ingredient_groups(entries, *by).join(parts, [*by, "ingredient_id"], "left").join(small_or_join(ingredients), "ingredient_id")
    quantity = F.coalesce(F.array_join(F.transform("parts", lambda p: p["part"]), " + "), F.concat(F.lit("x"), F.col("entries").cast("string")))
    return rows.select(*by, "ingredient_id", "canonical_name", "is_shared", "recipe_count", F.concat(capitalize(F.col("canonical_name")), F.lit(" - "), quantity).alias("line"))


def ordered_lines(lines: DataFrame, *by: str) -> DataFrame:
    return lines.orderBy(*by, F.col("is_shared").desc(), F.col("recipe_count").desc(), F.collate("canonical_name", "UNICODE"), "ingredient_id")

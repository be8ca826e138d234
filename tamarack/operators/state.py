"""Changes of tables as pure ``DataFrame -> DataFrame`` transforms; the write goes to a new version of the table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.text import plain_number, slugify
from tamarack.session import numbered, small_or_join

KEPT = ["is_favourite", "is_hidden", "variant_of_id", "created_at", "id", "last_suggested_at"]


def upsert(old: DataFrame, new: DataFrame, key: str, kept: list[str] = KEPT, override: str | None = None, overridden: str | None = None) -> DataFrame:
    """Old rows updated from new ones by key, and new ones added. ``kept`` columns of an old row stay; ``overridden`` stays where ``override`` is set."""
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    is_new, is_old = F.col(f"n.{key}").isNotNull(), F.col(f"o.{key}").isNotNull()
    out = []
    for c in old.columns:
        a = F.col(f"o.{c}")
        if c not in new.columns:
            out.append(a.alias(c))
            continue
        b = F.col(f"n.{c}")
        value = F.when(is_old & is_new, a if c in kept else b).when(is_new, b).otherwise(a)
        if c == overridden:
            value = F.when(is_old & F.coalesce(F.col(f"o.{override}"), F.lit(False)), a).otherwise(value)
        out.append(value.alias(c))
    return joined.select(*out)


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in ``new`` replaced; others stay."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def toggle(rows: DataFrame, ids: DataFrame, flag: str) -> DataFrame:
    """The flag turned for the rows whose id is in ``ids``."""
    mark = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return rows.join(mark, "id", "left").withColumn(flag, F.when(F.col("_hit"), ~F.col(flag)).otherwise(F.col(flag))).drop("_hit")


def mark_suggested(rows: DataFrame, ids: DataFrame, at: datetime) -> DataFrame:
    mark = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return rows.join(mark, "id", "left").withColumn("last_suggested_at", F.when(F.col("_hit"), F.lit(at)).otherwise(F.col("last_suggested_at"))).drop("_hit")


def plan_add(plan: DataFrame, added: DataFrame) -> DataFrame:
    """Recipes added to a plan once; those in it keep their servings. Columns plan_id, recipe_id, servings."""
    fresh = added.select("plan_id", "recipe_id").distinct().join(plan, ["plan_id", "recipe_id"], "left_anti")
    return plan.unionByName(fresh.withColumn("servings", F.lit(None).cast("int")))


def plan_remove(plan: DataFrame, removed: DataFrame) -> DataFrame:
    return plan.join(removed, ["plan_id", "recipe_id"], "left_anti")


def plan_servings(plan: DataFrame, wanted: DataFrame) -> DataFrame:
    """Servings set where ``wanted`` (plan_id, recipe_id, value) names a row; not positive or not finite is null."""
    ok = F.when((F.col("value") > 0) & (F.col("value") < float("inf")), F.col("value").cast("int"))
    mark = wanted.select("plan_id", "recipe_id", ok.alias("value")).dropDuplicates(["plan_id", "recipe_id"]).withColumn("_hit", F.lit(True))
    return plan.join(mark, ["plan_id", "recipe_id"], "left").withColumn("servings", F.when(F.col("_hit"), F.col("value")).otherwise(F.col("servings"))).drop("_hit", "value")


def clone(rows: DataFrame, ids: DataFrame, at: datetime) -> DataFrame:
    """Copies of the named recipes as the user's own: new deterministic id and slug, "(Custom)" behind the name, defaults for rating and flags."""
    new_id = F.concat(F.lit("custom-"), F.substring(F.sha2(F.concat_ws("|", "id", F.lit(str(at))), 256), 1, 32))
    out = rows.join(ids.select("id").distinct(), "id", "left_semi").withColumn("cloned_from_id", F.col("id")).withColumn("id", new_id)
    return out.withColumns({"name": F.concat("name", F.lit(" (Custom)")), "slug": F.concat("slug", F.lit("-custom")), "is_user_created": F.lit(True), "is_favourite": F.lit(False), "is_hidden": F.lit(False), "rating_value": F.lit(None).cast("double"), "rating_count": F.lit(None).cast("int"), "variant_of_id": F.lit(None).cast("string"), "created_at": F.lit(at), "updated_at": F.lit(at)})


def clone_children(children: DataFrame, clones: DataFrame, parent: str, key: str | None = None) -> DataFrame:
    """Copies of the children of cloned rows under their clones (``id``, ``cloned_from_id``); ``key``, if the children have one, is made from both ids."""
    mark = clones.select(F.col("cloned_from_id").alias(parent), F.col("id").alias("_new")).distinct()
    out = children.join(mark, parent).withColumn(parent, F.col("_new")).drop("_new")
    return out.withColumn(key, F.concat(F.lit("custom-"), F.substring(F.sha2(F.concat_ws("|", parent, F.col(key).cast("string")), 256), 1, 32))).select(*children.columns) if key else out.select(*children.columns)


def delete_children(children: DataFrame, kept: DataFrame, all_parents: DataFrame, parent: str) -> DataFrame:
    """Children without those whose parent is in ``all_parents`` but no longer in ``kept`` (both have ``id``)."""
    gone = all_parents.select(F.col("id").alias(parent)).distinct().join(kept.select(F.col("id").alias(parent)), parent, "left_anti")
    return children.join(gone, parent, "left_anti").select(*children.columns)


def commit_drafts(drafts: DataFrame, taken: DataFrame, at: datetime, serving_index: int = 0) -> tuple[DataFrame, DataFrame]:
    """(recipes, lines) of reviewed drafts (draft_id, name, subtitle, cook_minutes, serving_counts, calories, steps, ingredients array<struct<name,quantity,unit>>).

    Every draft becomes a new recipe with an id made from the draft's, a free slug, and the wanted serving count, else the first.
    ``lines``: recipe_id, row_no, name, quantity, unit, raw_text; the text is made of what is there.
    """
    new_id = F.concat(F.lit("pdf-"), F.substring(F.sha2("draft_id", 256), 1, 32))
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit("Untitled recipe"))
    rows = drafts.withColumns({"id": new_id, "name": name, "subtitle": F.nullif(F.trim("subtitle"), F.lit("")), "servings": F.coalesce(F.get("serving_counts", F.lit(serving_index)), F.get("serving_counts", F.lit(0)))})
    recipes = rows.join(unique_slugs(rows, taken), "id").select("id", "draft_id", "slug", "name", "subtitle", "cook_minutes", "servings", "calories", "steps", F.lit(True).alias("is_browsable"), F.lit(True).alias("is_user_created"), F.lit(True).alias("is_pdf_import"), F.lit(at).alias("created_at"))
    part = rows.select(F.col("id").alias("recipe_id"), F.posexplode("ingredients").alias("row_no", "i")).select("recipe_id", "row_no", "i.name", "i.quantity", "i.unit")
    quantity = F.when(F.col("quantity") != 0, plain_number(F.col("quantity")))
    return recipes, part.withColumn("raw_text", F.concat_ws(" ", quantity, F.nullif("unit", F.lit("")), F.nullif("name", F.lit(""))))


def edit(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Fields of user-created rows replaced by those of ``changes`` (id and any columns of rows)."""
    cols = [c for c in changes.columns if c != "id"]
    mark = changes.select("id", *[F.col(c).alias(f"_n_{c}") for c in cols]).dropDuplicates(["id"]).withColumn("_hit", F.lit(True))
    out = rows.join(mark, "id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & F.col("is_user_created")
    return out.select(*[(F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c))).alias(c) if c in cols else F.col(c) for c in rows.columns])


def delete(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """User-created rows removed; references to them become null."""
    gone = rows.filter("is_user_created").join(ids.select("id").distinct(), "id", "left_semi").select("id")
    kept = rows.join(gone, "id", "left_anti")
    for ref in ("variant_of_id", "cloned_from_id"):
        mark = gone.select(F.col("id").alias(ref), F.lit(True).alias("_gone"))
        kept = kept.join(mark, ref, "left").withColumn(ref, F.when(F.col("_gone").isNull(), F.col(ref))).drop("_gone")
    return kept.select(*rows.columns)


def resolve_names(names: DataFrame, aliases: DataFrame, ingredients: DataFrame, canonical: Column) -> DataFrame:
    """(name, ingredient_id, is_new): alias first, then the ingredient of the canonical name, else a new id made from it."""
    distinct = names.select("name").filter("name is not null").distinct().withColumn("canonical", canonical)
    a = aliases.select(F.lower("raw_text").alias("_raw"), F.col("ingredient_id").alias("_by_alias"))
    i = ingredients.select(F.col("canonical_name").alias("canonical"), F.col("id").alias("_by_name"))
    out = distinct.join(a, F.lower(F.trim("name")) == F.col("_raw"), "left").join(i, "canonical", "left")
    fresh = F.concat(F.lit("new-"), F.substring(F.sha2("canonical", 256), 1, 16))
    return out.select("name", F.coalesce("_by_alias", "_by_name", fresh).alias("ingredient_id"), F.coalesce("_by_alias", "_by_name").isNull().alias("is_new"))


def unique_slugs(rows: DataFrame, taken: DataFrame, name_col: str = "name", id_col: str = "id") -> DataFrame:
    """(id, slug): the base slug for the first row of a name, then base-2, base-3 and so on, skipping what is taken.

    Rows of a name and its taken numbers are ranked by sorts over the whole cluster, so a name of very many rows or
    taken numbers never gathers in one task: before the i-th taken number k stand k - i free ones, so in one order of
    rows by rank and taken numbers by k - i + 1, taken ones first, the place of a row is its number.
    """
    base = rows.select(F.col(id_col).alias("id"), slugify(F.col(name_col)).alias("base")).filter("base is not null")
    used = taken.select(F.col("slug").alias("t")).distinct()
    stem = F.regexp_replace("t", r"-\d+$", "")
    number = F.coalesce(F.regexp_extract("t", r"-(\d+)$", 1).try_cast("int"), F.lit(1))
    used = used.select(F.explode(F.array(F.struct(stem.alias("base"), number.alias("k")), F.struct(F.col("t").alias("base"), F.lit(1).alias("k")))).alias("u")).select("u.base", "u.k").distinct()
    ranked = _places(base, "n", "base", "id")
    busy = _places(used.filter("base is not null and k > 0"), "i", "base", "k")
    events = ranked.select("base", F.col("n").alias("at"), F.lit(1).alias("free"), "id").unionByName(busy.select("base", (F.col("k") - F.col("i") + 1).alias("at"), F.lit(0).alias("free")), allowMissingColumns=True)
    out = _places(events, "k", "base", "at", "free").filter("free = 1")
    return out.select("id", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("k").cast("string"))).alias("slug"))


def _places(rows: DataFrame, name: str, key: str, *order: str) -> DataFrame:
    """Rows numbered from 1 within each key, in this order."""
    placed, _ = numbered(rows, key, *order, name=name)
    first = placed.groupBy(key).agg(F.min(name).alias("_first"))
    return placed.join(small_or_join(first), key).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first")

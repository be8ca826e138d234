"""Catalog ETL: change detection on a sitemap, typed parsing of pages, ok and error rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions import text as T
from tamarack.functions.ingredients import parse_line

LD_JSON = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
APP_JSON = r"(?is)<script[^>]*id=[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>"


def ld_recipe(html: Column) -> Column:
    """The first Recipe object of a page's linked data, as a variant: objects, arrays and @graph are searched in order."""
    docs = F.transform(F.regexp_extract_all(html, F.lit(LD_JSON), F.lit(1)), F.try_parse_json)

    def objects(v: Column) -> Column:
        graph = F.try_variant_get(v, "$['@graph']", "array<variant>")
        listed = F.try_variant_get(v, "$", "array<variant>")
        return F.when(graph.isNotNull(), graph).when(listed.isNotNull(), listed).otherwise(F.array(v))

    every = F.flatten(F.transform(F.filter(docs, lambda d: d.isNotNull()), objects))
    return F.get(F.filter(every, lambda v: F.try_variant_get(v, "$['@type']", "string") == "Recipe"), F.lit(0))


def app_recipe(html: Column, path: str = "$.props.pageProps.ssrPayload.recipe") -> Column:
    """The page's own record of its recipe, as a variant."""
    return F.try_variant_get(F.try_parse_json(F.nullif(F.regexp_extract(html, APP_JSON, 1), F.lit(""))), path, "variant")


def not_false(v: Column, path: str) -> Column:
    """True unless the field is there and is the boolean false; a number 0 is not false."""
    f = F.try_variant_get(v, path, "variant")
    return ~F.coalesce((F.schema_of_variant(f) == "BOOLEAN") & (F.try_variant_get(f, "$", "boolean") == F.lit(False)), F.lit(False))


def is_text(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def app_steps(app: Column, image_base: str) -> Column:
    """array of struct(text, image_url, caption): the HTML text before the plain one, blank steps dropped; null without a list."""
    steps = F.try_variant_get(app, "$.steps", "array<variant>")

    def step(v: Column) -> Column:
        html = F.try_variant_get(v, "$.instructionsHTML", "variant")
        raw = F.when(is_text(html), html).otherwise(F.try_variant_get(v, "$.instructions", "variant"))
        path, caption = F.try_variant_get(v, "$.images[0].path", "variant"), F.try_variant_get(v, "$.images[0].caption", "variant")
        return F.struct(
            F.when(is_text(raw), T.html_text(F.try_variant_get(raw, "$", "string"))).alias("text"),
            F.when(is_text(path), F.concat(F.lit(image_base), F.try_variant_get(path, "$", "string"))).alias("image_url"),
            F.when(is_text(caption), F.try_variant_get(caption, "$", "string")).alias("caption"),
        )

    return F.filter(F.transform(steps, step), lambda s: F.coalesce(s["text"] != "", F.lit(False)))


def ld_steps(ld: Column) -> Column:
    texts = F.transform(F.try_variant_get(ld, "$.recipeInstructions", "array<variant>"), lambda v: F.when(is_text(F.try_variant_get(v, "$.text", "variant")), T.html_text(F.try_variant_get(v, "$.text", "string"))))
    kept = F.filter(texts, lambda t: F.coalesce(t != "", F.lit(False)))
    return F.transform(F.coalesce(kept, F.array().cast("array<string>")), lambda t: F.struct(t.alias("text"), F.lit(None).cast("string").alias("image_url"), F.lit(None).cast("string").alias("caption")))


def parse_pages(pages: DataFrame, image_base: str = "") -> DataFrame:
    """One row for each page (url, html): fields of its recipe, or ``error`` where it has none, no name or no ingredient list.

    Steps come from the page's own record if it has a list, even an empty one, else from the linked data.
    """
    rows = pages.select("url", ld_recipe(F.col("html")).alias("ld"), app_recipe(F.col("html")).alias("app"))
    name = T.text_or_null(F.try_variant_get("ld", "$.name", "variant"))
    lines = F.try_variant_get("ld", "$.recipeIngredient", "array<string>")
    rows = rows.withColumns({"full_name": name, "lines": lines, "ids": T.url_ids(F.col("url"))})
    ok = F.col("ld").isNotNull() & F.col("full_name").isNotNull() & F.col("lines").isNotNull()
    rows = rows.withColumns({"ok": ok, "title": T.title_parts(F.col("full_name"))})

    def field(path: str) -> Column:
        return T.text_or_null(F.try_variant_get("ld", path, "variant"))

    return rows.select(
        "url",
        F.col("ids.ext_id").alias("ext_id"),
        F.col("ids.slug").alias("slug"),
        F.when(~F.col("ok"), F.lit("no recipe, name or ingredients")).alias("error"),
        F.col("title.name").alias("name"),
        F.col("title.subtitle").alias("subtitle"),
        field("$.recipeCuisine").alias("cuisine"),
        field("$.recipeCategory").alias("category"),
        T.duration_minutes(F.try_variant_get("ld", "$.totalTime", "string")).alias("cook_minutes"),
        T.servings(F.coalesce(F.try_variant_get("ld", "$.recipeYield[0]", "string"), F.try_variant_get("ld", "$.recipeYield", "string"))).alias("servings"),
        T.calories(F.try_variant_get("ld", "$.nutrition.calories", "string")).alias("calories"),
        T.grams(F.try_variant_get("ld", "$.nutrition.fatContent", "string")).alias("fat_grams"),
        T.number_or_null(F.try_variant_get("ld", "$.aggregateRating.ratingValue", "string")).alias("rating_value"),
        not_false(F.col("app"), "$.isPublished").alias("is_published"),
        not_false(F.col("app"), "$.active").alias("is_active"),
        F.coalesce(app_steps(F.col("app"), image_base), ld_steps(F.col("ld"))).alias("steps"),
        F.transform("lines", parse_line).alias("ingredients"),
    )


def pending(sitemap: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sitemap rows (url, lastmod, position) that must be fetched: not done before, done with an error, or changed since."""
    done = manifest.filter("status = 'ok' and lastmod is not null").select("url", F.col("lastmod").alias("_seen")).distinct()
    return sitemap.join(done, (sitemap["url"] == done["url"]) & (sitemap["lastmod"] == done["_seen"]), "left_anti")


def first_pending(rows: DataFrame, limit: int) -> DataFrame:
    """The first pending rows in sitemap order."""
    return rows.orderBy("position").limit(limit)


def spread_sample(rows: DataFrame, k: int, order_col: str = "position") -> DataFrame:
    """k rows evenly spaced over the ordered rows, ends included; all rows if there are no more than k, the first for k = 1.

    The wanted places are worked out from the count; ranks come from a range-partitioned count of rows
    for each value of the order column, which has to be unique.
    """
    n = rows.count()
    if k >= n:
        return rows
    wanted = sorted({int(i * (n - 1) // max(k - 1, 1)) for i in range(k)})
    ordered = rows.repartitionByRange(order_col).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(order_col)
    sizes = {r["_part"]: r["count"] for r in ordered.groupBy("_part").count().collect()}
    offset, total = {}, 0
    for p in sorted(sizes):
        offset[p], total = total, total + sizes[p]
    starts = F.create_map(*[F.lit(x) for kv in offset.items() for x in kv])
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order_col)) - 1 + F.try_element_at(starts, F.col("_part"))
    return ordered.withColumn("_place", place).filter(F.col("_place").isin(wanted)).drop("_part", "_place")


def run_report(status: DataFrame) -> DataFrame:
    """(ok, errors, skipped) of a manifest's rows."""
    return status.agg(*[F.count_if(F.col("status") == s).alias(a) for s, a in (("ok", "ok"), ("error", "errors"), ("skipped", "skipped"))])


def form_rows(forms: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of forms whose fields are parallel arrays; rows without a name are dropped."""
    zipped = forms.select(key, F.posexplode(F.arrays_zip(*fields)).alias("row_no", "row")).select(key, "row_no", *[F.col("row").getField(f).alias(f) for f in fields])
    return zipped.filter(F.coalesce(T.strip(F.col(fields[0])) != "", F.lit(False)))

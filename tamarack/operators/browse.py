"""The catalog: current rows, faceted browsing, page and count, facets, candidate pool, details."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from datetime import datetime
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Page size, cooldown, pool size, preset ranges, columns of a summary.
PAGE_SIZE, COOLDOWN_DAYS, POOL = 24, 14, 400
CALORIE_PRESETS = {"under-400": (None, 399), "400-700": (400, 700), "over-700": (701, None)}
MINUTE_PRESETS = {"under-20": (None, 19), "20-40": (20, 40), "over-40": (41, None)}
SUMMARY = ["id", "slug", "name", "subtitle", "image_url", "cuisine", "cook_minutes", "servings", "calories", "protein_type", "rating_value", "is_favourite", "is_hidden", "is_user_created", "is_pdf_import"]
PROTEIN_LABELS = {"CHICKEN": "Chicken", "BEEF": "Beef", "PORK": "Pork", "LAMB": "Lamb", "TURKEY": "Turkey", "DUCK": "Duck", "VENISON": "Venison", "MEAT_OTHER": "Other meat", "FISH": "Fish", "VEGETARIAN": "Vegetarian", "VEGAN": "Vegan", "UNKNOWN": "Unknown"}
SORTS = {"rating": ("rating_value", "desc"), "calories": ("calories", "asc"), "time": ("cook_minutes", "asc"), "newest": ("created_at", "desc")}


@dataclass(frozen=True)
class BrowseParams:
    """What to show. Empty lists and None mean no restriction."""

    protein_types: list[str] = field(default_factory=list)
    cuisine: str | None = None
    min_calories: int | None = None
    max_calories: int | None = None
    min_minutes: int | None = None
    max_minutes: int | None = None
    search: str | None = None
    favourites_only: bool = False
    imported_only: bool = False
    hidden_only: bool = False
    show_all: bool = False
    sort: str = "rating"
    page: int = 1
    page_size: int = PAGE_SIZE

    @classmethod
    def from_query(cls, raw: dict[str, str | list[str]]) -> BrowseParams:
        """Parameters of a query string; the first of repeated values counts, malformed ones are dropped."""
        one = {k: (v[0] if v else None) if isinstance(v, list) else v for k, v in raw.items()}

        def integer(key: str) -> int | None:
            m = re.match(r"\s*([+-]?\d+)", one.get(key) or "")
            return int(m[1]) if m else None

        kinds = [p for p in (one.get("protein") or "").split(",") if p in PROTEIN_LABELS and p != "UNKNOWN"]
        flag = lambda k: one.get(k) == "1"
        sort = one.get("sort") if one.get("sort") in SORTS else "rating"
        return cls(kinds, one.get("cuisine") or None, integer("minCal"), integer("maxCal"), integer("minTime"), integer("maxTime"), one.get("q") or None, flag("fav"), flag("imported"), flag("hidden"), flag("all"), sort, max(1, integer("page") or 1))

    def to_query(self) -> str:
        """The query string of these parameters, defaults left out."""
        pairs = [("protein", ",".join(self.protein_types)), ("cuisine", self.cuisine), ("minCal", self.min_calories), ("maxCal", self.max_calories), ("minTime", self.min_minutes), ("maxTime", self.max_minutes), ("q", self.search)]
        pairs += [(k, "1" if v else None) for k, v in (("fav", self.favourites_only), ("imported", self.imported_only), ("hidden", self.hidden_only), ("all", self.show_all))]
        pairs += [("sort", self.sort if self.sort != "rating" else None), ("page", self.page if self.page > 1 else None)]
        return urlencode([(k, v) for k, v in pairs if v not in (None, "")])

    def active_filters(self) -> int:
        """How many filters narrow the result."""
        ranges = (self.min_calories, self.max_calories), (self.min_minutes, self.max_minutes)
        return len(self.protein_types) + sum(r != (None, None) for r in ranges) + sum(map(bool, (self.cuisine, self.search, self.favourites_only, self.imported_only, self.hidden_only, self.show_all)))


def current(recipes: DataFrame, *columns: str) -> DataFrame:
    """The current row of each recipe: the one scraped last.

    A map-side aggregate; name the columns that are needed, and no others are read or shuffled.
    """
    cols = list(dict.fromkeys(["id", *(columns or recipes.columns)]))
    row = F.max_by(F.struct(*cols), F.struct("last_scraped_at", "updated_at")).alias("r")
    return recipes.groupBy(F.col("id").alias("_id")).agg(row).select(*[F.col("r").getField(c).alias(c) for c in cols])


def in_range(c: Column, low: float | None, high: float | None) -> Column:
    """Inclusive range, open at None; a null value is outside any bound."""
    out = F.lit(True)
    if low is not None:
        out = out & (c >= low)
    if high is not None:
        out = out & (c <= high)
    return out


def predicate(p: BrowseParams) -> Column:
    """All conditions as one conjunction, which Catalyst splits and pushes down. Search text is taken literally."""
    keep = F.col("is_browsable") & (F.col("is_hidden") == F.lit(p.hidden_only))
    if not p.show_all:
        keep = keep & F.col("variant_of_id").isNull()
    if p.protein_types:
        keep = keep & F.col("protein_type").isin(p.protein_types)
    if p.cuisine is not None:
        keep = keep & (F.lower("cuisine") == F.lower(F.lit(p.cuisine)))
    keep = keep & in_range(F.col("calories"), p.min_calories, p.max_calories) & in_range(F.col("cook_minutes"), p.min_minutes, p.max_minutes)
    if p.search:
        needle = F.lower(F.lit(p.search))
        keep = keep & (F.contains(F.lower("name"), needle) | F.contains(F.lower(F.coalesce("subtitle", F.lit(""))), needle))
    if p.favourites_only:
        keep = keep & F.col("is_favourite")
    if p.imported_only:
        keep = keep & F.col("is_pdf_import")
    return keep


def ordering(sort: str) -> list[Column]:
    """Sort columns with ties by id; nulls first when falling, last when rising."""
    name, way = SORTS.get(sort, SORTS["rating"])
    return [F.col(name).desc_nulls_first() if way == "desc" else F.col(name).asc_nulls_last(), F.col("id").asc()]


def page(rows: DataFrame, p: BrowseParams) -> DataFrame:
    """One page of the filtered, sorted rows. Spark takes offset plus limit rows from each partition, not a full sort."""
    return rows.filter(predicate(p)).orderBy(*ordering(p.sort)).offset((max(1, p.page) - 1) * p.page_size).limit(p.page_size)


def count(rows: DataFrame, p: BrowseParams) -> DataFrame:
    """(total, pages) of the filtered rows; there is at least one page."""
    n = F.count("*")
    return rows.filter(predicate(p)).agg(n.alias("total"), F.greatest(F.lit(1), F.ceil(n / p.page_size)).cast("bigint").alias("pages"))


def total_pages(total: int, size: int) -> int:
    return max(1, math.ceil(total / size))


def preset_of(c: Column, presets: dict[str, tuple[int | None, int | None]]) -> Column:
    """The name of the preset range a value lies in; null values are in none."""
    out = None
    for name, (low, high) in presets.items():
        cond = in_range(c, low, high)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def label(c: Column, labels: dict[str, str] = PROTEIN_LABELS) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), c)


def has_nutrition(columns: list[str]) -> Column:
    return F.coalesce(*[F.col(c).cast("double") for c in columns]).isNotNull()


def rested(as_of: datetime, days: int = COOLDOWN_DAYS) -> Column:
    """Never suggested, or not within the last days before ``as_of``."""
    return F.col("last_suggested_at").isNull() | (F.col("last_suggested_at") < F.lit(as_of) - F.make_interval(days=F.lit(days)))


def pool(rows: DataFrame, p: BrowseParams, as_of: datetime | None = None, cap: int = POOL) -> DataFrame:
    """The best-rated candidates, unrated ones first, ties by id; with ``as_of`` without recently suggested ones."""
    keep = predicate(p) if as_of is None else predicate(p) & rested(as_of)
    return rows.filter(keep).orderBy(F.col("rating_value").desc_nulls_first(), "id").limit(cap)


def browsable(steps: Column, image_url: Column, ingredients: Column) -> Column:
    """At least one ingredient, more than one step, and a usable image."""
    from tamarack.functions.text import usable_image

    return (F.coalesce(F.size(ingredients), F.lit(0)) > 0) & (F.coalesce(F.size(steps), F.lit(0)) > 1) & usable_image(image_url)


def completeness(steps: Column, rating_count: Column) -> Column:
    return (F.coalesce(F.size(steps), F.lit(0)) * 1000 + F.coalesce(rating_count, F.lit(0))).cast("bigint")


def all_details(recipes: DataFrame, lines: DataFrame, ingredients: DataFrame) -> DataFrame:
    """(recipe_id, slug, name, ingredients, variants): each side is collected for its recipe before the join, so rows do not multiply.

    ``lines``: recipe_id, ingredient_id. Names of ingredients are distinct and sorted; variants (id, slug, name, subtitle) are in the order of their ids.
    """
    own = lines.join(ingredients.select(F.col("id").alias("ingredient_id"), "canonical_name"), "ingredient_id").groupBy("recipe_id").agg(F.array_sort(F.collect_set("canonical_name")).alias("ingredients"))
    kin = recipes.filter("variant_of_id is not null").groupBy(F.col("variant_of_id").alias("recipe_id")).agg(F.array_sort(F.collect_list(F.struct("id", "slug", "name", "subtitle"))).alias("variants"))
    return recipes.select(F.col("id").alias("recipe_id"), "slug", "name").join(own, "recipe_id", "left").join(kin, "recipe_id", "left")


def details(recipes: DataFrame, lines: DataFrame, ingredients: DataFrame, key: str) -> DataFrame:
    """The details of one recipe by its slug; only its own lines and variants are collected."""
    one = recipes.filter(F.col("slug") == key)
    ids = one.select(F.col("id").alias("recipe_id"))
    kin = recipes.join(ids.select(F.col("recipe_id").alias("variant_of_id")), "variant_of_id", "left_semi")
    return all_details(one.unionByName(kin), lines.join(ids, "recipe_id", "left_semi"), ingredients).join(ids, "recipe_id", "left_semi")

"""Queries of the problems on training data. Every one runs over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import canonical, leak, lookalike, mixing, scans, similar_sets, together
from tamarack.session import materialize, table


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return together.together(table(spark, sf_dir, "recipe_ingredient_set"), least=6, least_share=(1, 500))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that recipes use together at least three times as often as chance."""
    return _pairs(spark, sf_dir).filter("n_ab * n >= 3 * n_a * n_b").select(F.col("item_a").alias("ingredient_id_a"), F.col("item_b").alias("ingredient_id_b"))


def p1_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of enough support with counts, lift and corrected odds ratio."""
    cols = [F.round(c, 6).alias(c) for c in ("expected", "lift", "odds_ratio", "log_odds", "log_odds_low")]
    return together.excess(_pairs(spark, sf_dir)).select("item_a", "item_b", "n_ab", "n_a", "n_b", *cols)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of recipes that share at least 6 ingredients and have Jaccard similarity of at least 0.7."""
    pairs = similar_sets.similar_pairs(table(spark, sf_dir, "recipe_ingredient_set"), threshold=(7, 10), least=6)
    return pairs.select(F.col("record_a").alias("recipe_id_a"), F.col("record_b").alias("recipe_id_b"))


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each linked recipe with the size of its class of equal sets and its number of links to other sets."""
    return similar_sets.linked_records(table(spark, sf_dir, "recipe_ingredient_set")).select(F.col("record").alias("recipe_id"), "copies", "links")


def p2_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes that a plan's shopping entries of one recipe are nearly the same as: a join between two tables."""
    entries = table(spark, sf_dir, "shopping_list_entry").select(F.concat_ws(" ", "plan_id", "recipe_id").alias("basket"), F.array("ingredient_id").alias("ids"))
    pairs = similar_sets.similar_between(table(spark, sf_dir, "recipe_ingredient_set"), entries, ("recipe_id", "ingredient_ids"), ("basket", "ids"))
    return pairs.select(F.col("record_a").alias("recipe_id"), F.col("record_b").alias("basket"), "common", "total")


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipe = table(spark, sf_dir, "recipe")
    step = recipe.select(F.explode("steps").alias("step"))
    names = table(spark, sf_dir, "ingredient").select("canonical_name")
    clean = [step.select("step.text"), step.select("step.heading"), recipe.select("name"), recipe.select("subtitle"), names]
    return scans.repair(table(spark, sf_dir, "ocr_line"), table(spark, sf_dir, "parsed_card_step"), clean, names)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each damaged record of the scanned cards and the kind of damage."""
    kinds = F.explode(F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in ("furniture", "hyphen", "misread")]), lambda x: x.isNotNull()))
    lines = _repaired(spark, sf_dir).select(F.col("kind").alias("record_kind"), "record_id", kinds.alias("defect"))
    cell = scans.cells(table(spark, sf_dir, "parsed_card_quantity")).filter("misread")
    return lines.unionByName(cell.select(F.lit("card_quantity").alias("record_kind"), "record_id", F.lit("misread").alias("defect"))).distinct()


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous paragraphs: body lines between breaks, cut words joined, misreads repaired."""
    return scans.paragraphs(materialize(_repaired(spark, sf_dir)))


def p3_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by kind, pattern and label, and how many of them the model decided, as their pattern alone is open or speaks for another label."""
    decided = F.col("label") != F.col("seed")
    return _repaired(spark, sf_dir).filter("trim(text) <> ''").groupBy("kind", "pattern", "label").agg(F.count("*").alias("lines"), F.count_if(decided).alias("by_model"))


def p3_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity cells in one form, with repaired readings."""
    return scans.cells(table(spark, sf_dir, "parsed_card_quantity"))


def _mapped(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """Both tables in one search, so that a name in both is searched once."""
    parts = [("parsed", "parsed_ingredient_line", "line_id"), ("edited", "edited_ingredient", "edit_id")]
    names = [table(spark, sf_dir, name).filter(F.col(key).isNotNull()).select(F.struct(F.lit(kind).alias("kind"), F.col(key).cast("bigint").alias("id")).alias("key"), "name") for kind, name, key in parts]
    found = canonical.map_to_list(names[0].unionByName(names[1]), "key", "name", table(spark, sf_dir, "ingredient"), table(spark, sf_dir, "ingredient_alias"), every=every)
    return found.withColumns({"record_kind": F.col("record_id.kind"), "record_id": F.col("record_id.id")})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingredient that each typed name means, or none."""
    return _mapped(spark, sf_dir).select("record_kind", "record_id", F.col("entry_id").alias("ingredient_id"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each kind were mapped at each distance, and how many of them have other entries in reach; -1 is none."""
    rows = _mapped(spark, sf_dir, every=True)
    others = F.exists("in_reach", lambda e: e["entry_id"] != F.col("entry_id"))
    return rows.groupBy("record_kind", "distance").agg(F.count("*").alias("records"), F.count_distinct("entry_id").alias("entries"), F.count_if(others).alias("with_others_in_reach"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that holds 13 consecutive words of a test item."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaked test item, in how many documents it leaked, and the best score."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"), F.round(F.max("score"), 6).alias("best_score"))


def _mixture(spark: SparkSession, sf_dir: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot reach their share."""
    m = _mixture(spark, sf_dir)
    return spark.createDataFrame([(t.source,) for t, short in zip(m.targets, m.shortfalls(), strict=True) if short], "source string")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, expected and actual share of each source in the mixture."""
    return _mixture(spark, sf_dir).report()


def p7_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mixture uses each document."""
    return _mixture(spark, sf_dir).copies()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that look the same but differ in their code points."""
    return lookalike.same_look_pairs(lookalike.same_look(table(spark, sf_dir, "documents"), "doc_id", "text"))


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One consistent text for each document."""
    return lookalike.one_form(table(spark, sf_dir, "documents"), "doc_id", "text")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_excess, p2_found, p2_links, p2_planned, p3_found, p3_paragraphs, p3_labels, p3_cells, p5_found, p5_report, p6_found, p6_items, p7_found, p7_report, p7_copies, p8_found, p8_clean)}

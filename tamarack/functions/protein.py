"""Protein class of a recipe from its ingredient names: keyword rules as columns and one aggregate."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Substitutes, species words, cuts and their usual species, species by priority, fish, contexts.
SUBSTITUTES = ["vegan", "meat-free", "meat free", "plant-based", "plant based", "plant mince", "meatless", "veggie mince", "quorn", "vivera", "linda mccartney"]
SPECIES = {
    "CHICKEN": ["chicken", "poussin"],
    "TURKEY": ["turkey"],
    "BEEF": ["beef", "veal", "brisket", "sirloin", "oxtail", "ox cheek"],
    "LAMB": ["lamb", "mutton"],
    "PORK": ["pork", "bacon", "gammon", "ham", "pancetta", "prosciutto", "chorizo", "salami", "pepperoni", "nduja"],
    "DUCK": ["duck"],
    "VENISON": ["venison"],
    "MEAT_OTHER": ["rabbit", "goat", "quail", "pheasant", "wild boar"],
}
CUTS = {"mince": "BEEF", "steak": "BEEF", "meatball": "BEEF", "burger": "BEEF", "sausage": "PORK", "escalope": "CHICKEN"}
PRIORITY = ["CHICKEN", "BEEF", "PORK", "LAMB", "TURKEY", "DUCK", "VENISON", "MEAT_OTHER"]
FISH = [
    "salmon", "cod", "tuna", "prawn", "shrimp", "haddock", "basa", "hake", "tilapia", "sea bass", "seabass", "bream", "barramundi",
    "trout", "mackerel", "anchovy", "crab", "scallop", "monkfish", "coley", "whiting", "seafood", "fish", "kipper", "sardine",
    "pollock", "plaice", "sole", "swordfish", "snapper", "mahi", "eel", "lobster", "mussel", "oyster", "squid", "octopus",
    "langoustine", "crayfish", "clam",
]
CONTEXTS = ["stock", "bouillon", "gravy", "cheese", "bun"]

_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def mentions(name: Column, word: str) -> Column:
    """Whether a lower-case name has the word (with plural) or phrase, outside a stock, cheese or bun."""
    has = F.contains(name, F.lit(word)) if " " in word else name.rlike(f"{_B}{re.escape(word)}(e?s)?{_E}")
    veto = name.rlike(f"{_B}{re.escape(word)}('s)?\\s+({'|'.join(CONTEXTS)})(e?s)?{_E}")
    return has & ~veto


def _any(name: Column, words: list[str]) -> Column:
    """Any of the words, as one alternation: a mention with a veto on the same word does not count.

    A veto holds for its word on the whole line, so the words are tested through one pattern each
    only where the cheap alternation finds something.
    """
    quick = name.rlike("|".join(re.escape(w) for w in words))
    out = mentions(name, words[0])
    for w in words[1:]:
        out = out | mentions(name, w)
    return quick & out


def line_species(name: Column) -> Column:
    """The species of one ingredient name (lower case): species words first, then cuts; null if none."""
    out = F.when(_any(name, SPECIES["CHICKEN"]), "CHICKEN")
    for species, words in list(SPECIES.items())[1:]:
        out = out.when(_any(name, words), species)
    for cut, species in CUTS.items():
        out = out.when(mentions(name, cut), species)
    return out


def protein_class(recipes: DataFrame, lines: DataFrame, key: str = "recipe_id") -> DataFrame:
    """(key, protein_class) for every recipe of ``recipes`` (key, meta); ``lines`` is (key, name).

    Fish wins over meat; among meats the most frequent line species, ties by priority; then a vegan
    marker in meta or lines; else vegetarian. Recipes without lines are UNKNOWN. Each distinct name is
    classified once, counts aggregate on the map side.
    """
    name = F.lower("name")
    distinct = lines.select("name").filter("name is not null").distinct()
    flagged = distinct.select(
        "name",
        name.rlike(f"{_B}vegan{_E}").alias("vegan"),
        name.rlike("|".join(re.escape(s) for s in SUBSTITUTES)).alias("skip"),
        _any(name, FISH).alias("fish"),
        line_species(name).alias("species"),
    )
    seen = lines.filter("name is not null").join(flagged, "name")
    counts = [F.count_if(~F.col("skip") & (F.col("species") == s)).alias(s) for s in PRIORITY]
    per = seen.groupBy(key).agg(F.count("*").alias("n"), F.bool_or("vegan").alias("vegan"), F.bool_or(F.col("fish") & ~F.col("skip")).alias("fish"), *counts)
    most = F.greatest(*PRIORITY)
    best = F.when(F.col(PRIORITY[0]) == most, PRIORITY[0])
    for s in PRIORITY[1:]:
        best = best.when(F.col(s) == most, s)
    marker = F.coalesce("vegan", F.lit(False)) | F.coalesce(F.lower("meta").rlike(f"{_B}vegan{_E}"), F.lit(False))
    out = F.when(F.col("n").isNull(), "UNKNOWN").when(F.col("fish"), "FISH").when(most > 0, best).when(marker, "VEGAN").otherwise("VEGETARIAN")
    return recipes.join(per, key, "left").select(key, out.alias("protein_class"))

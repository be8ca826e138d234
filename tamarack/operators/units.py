"""Quantities recorded in different units, brought to grams and millilitres.

Everything is SQL on columns: one pass of regular expressions takes number, unit and
pack size out of the text, the unit alias is resolved by a join with a small table,
missing parts are filled from the columns and then from a default of the source, and
factor and offset are applied. There is no Python in the plan and no shuffle except
the one that removes repeated rows of an id.

Defined results: null or empty text falls back to the columns; a row without a number,
without a unit, or with a unit of another kind (counts, lengths, pinches) is not
returned; an empty table gives an empty result; other columns are ignored, whatever
their names; of repeated rows of an id one counts,
the same on every run.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Base unit, factor to the base unit, offset, aliases (lower case, no full stop).
UNITS = [
    ("g", 0.001, 0.0, ["mg", "milligram", "milligrams", "milligramme", "milligrammes", "mgm"]),
    ("g", 1.0, 0.0, ["g", "gr", "grs", "gm", "gms", "grm", "grms", "gram", "grams", "gramme", "grammes", "gram(s)", "gramme(s)"]),
    ("g", 1000.0, 0.0, ["kg", "kgs", "kgm", "kilo", "kilos", "kilogram", "kilograms", "kilogramme", "kilogrammes", "kilogram(s)", "kilo(s)"]),
    ("g", 28.349523125, 0.0, ["oz", "ozs", "ounce", "ounces", "ounce(s)"]),
    ("g", 453.59237, 0.0, ["lb", "lbs", "lbr", "pound", "pounds", "pound(s)"]),
    ("ml", 1.0, 0.0, ["ml", "mls", "mlt", "millilitre", "millilitres", "milliliter", "milliliters", "milliliter(s)", "millilitre(s)", "cc"]),
    ("ml", 10.0, 0.0, ["cl", "cls", "clt", "centilitre", "centilitres", "centiliter", "centiliters", "centilitre(s)", "centiliter(s)"]),
    ("ml", 100.0, 0.0, ["dl", "dls", "dlt", "decilitre", "decilitres", "deciliter", "deciliters", "decilitre(s)", "deciliter(s)"]),
    ("ml", 1000.0, 0.0, ["l", "lt", "ltr", "ltrs", "litre", "litres", "liter", "liters", "litre(s)", "liter(s)"]),
    ("ml", 5.0, 0.0, ["tsp", "tsps", "teaspoon", "teaspoons", "tsp(s)", "teaspoon(s)", "teaspoonful", "teaspoonfuls"]),
    ("ml", 15.0, 0.0, ["tbsp", "tbsps", "tbs", "tblsp", "tblsps", "tablespoon", "tablespoons", "tbsp(s)", "tablespoon(s)", "tablespoonful", "tablespoonfuls"]),
    ("ml", 250.0, 0.0, ["cup", "cups", "cup(s)", "cupful", "cupfuls"]),
    ("ml", 28.4130625, 0.0, ["fl oz", "floz", "fluid ounce", "fluid ounces", "fluid ounce(s)", "fluid oz", "fl ounce", "fl ounces"]),
    ("ml", 568.26125, 0.0, ["pt", "pts", "pint", "pints", "pint(s)"]),
]
# Characters and words that stand for numbers.
FRACTIONS = {"¼": 1 / 4, "½": 1 / 2, "¾": 3 / 4, "⅓": 1 / 3, "⅔": 2 / 3, "⅛": 1 / 8, "⅜": 3 / 8, "⅝": 5 / 8, "⅞": 7 / 8, "⅕": 1 / 5, "⅖": 2 / 5, "⅗": 3 / 5, "⅘": 4 / 5, "⅙": 1 / 6, "⅚": 5 / 6}
WORDS = {"half": 0.5, "half a": 0.5, "half an": 0.5, "quarter": 0.25, "a quarter": 0.25, "quarter of a": 0.25, "a quarter of a": 0.25, "three quarters of a": 0.75, "a": 1.0, "an": 1.0, "one": 1.0, "two": 2.0, "three": 3.0, "four": 4.0, "five": 5.0, "six": 6.0, "seven": 7.0, "eight": 8.0, "nine": 9.0, "ten": 10.0, "eleven": 11.0, "twelve": 12.0, "one and a half": 1.5, "two and a half": 2.5, "a dozen": 12.0}

_V = "".join(FRACTIONS)
_WORDS = "|".join(sorted(WORDS, key=len, reverse=True))
_DIGITS = rf"\d+ \d+/\d+|\d+/\d+|\d+ ?[{_V}]|[{_V}]|\d{{1,3}}(?:,\d{{3}})+(?!\d)(?:\.\d+)?|\d+[.,]\d+|\d+|[.]\d+"
NUMBER = rf"(?:{_DIGITS}|(?:{_WORDS})(?= ))"


def _unit_pattern(aliases: list[str]) -> str:
    return "|".join(re.escape(a).replace(r"\ ", r"\.? ?") for a in sorted(aliases, key=len, reverse=True))


UNIT = rf"(?:{_unit_pattern([a for u in UNITS for a in u[3]])})(?![a-z(])"
_START = r"(?<![\w.,/])"
SIMPLE = rf"{_START}({NUMBER}) ?({UNIT})"
COMPOUND = rf"{_START}({NUMBER}) ?((?:lbs?|pounds?)(?![a-z]))\.?,? ?(?:and |& ?)?({NUMBER}) ?((?:ozs?|ounces?)(?![a-z]))"
PACK = rf"{_START}({NUMBER}) ?[x×*] ?({NUMBER}) ?-?({UNIT})"
BRACKET = rf"{_START}({NUMBER}) [a-z]+(?:\((?:s|es)\))? ?[(\[] ?({NUMBER}) ?-?({UNIT})"


def unit_table(spark: SparkSession) -> DataFrame:
    """(alias, base_unit, factor, offset); a fixed table of about a hundred rows."""
    rows = [(a, base, factor, offset) for base, factor, offset, aliases in UNITS for a in aliases]
    return spark.createDataFrame(rows, "alias string, base_unit string, factor double, offset double")


def tidy(text: Column) -> Column:
    """Lower case, every kind of space as one plain space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s  -   　]+", " "))


def number(token: Column) -> Column:
    """The value of a number token: whole, decimal, grouped, fraction, mixed, or a word. Null if it has none.

    ``token`` should be a plain column; it is used several times.
    """
    last = F.try_element_at(F.create_map(*[F.lit(x) for pair in FRACTIONS.items() for x in pair]), F.right(token, F.lit(1)))
    words = F.create_map(*[F.lit(x) for pair in WORDS.items() for x in pair])
    head = F.regexp_extract(token, rf"^(\d+) ?(?:[{_V}]|\d+/\d+)$", 1).try_cast("double")
    over = F.try_divide(F.regexp_extract(token, r"(\d+)/\d+$", 1).try_cast("double"), F.regexp_extract(token, r"\d+/(\d+)$", 1).try_cast("double"))
    grouped = token.rlike(r"^\d{1,3}(,\d{3})+(\.\d+)?$")
    decimal = F.when(grouped, F.replace(token, F.lit(","), F.lit(""))).otherwise(F.replace(token, F.lit(","), F.lit("."))).try_cast("double")
    return F.coalesce(decimal, F.coalesce(head, F.lit(0.0)) + F.coalesce(last, over), F.try_element_at(words, token))


def alias_key(unit: Column) -> Column:
    """The form in which the alias table has a tidy unit: no full stops, no remark behind it."""
    bare = F.regexp_replace(unit, r"\.", "")
    return F.nullif(F.trim(F.regexp_replace(bare, r"(/ea| ?\(level\)| each)$", "")), F.lit(""))


def measures(rows: DataFrame) -> DataFrame:
    """Adds what the text column ``t`` states: kind, tokens (times, value, second value), unit, more_unit.

    Each step is a projection of its own, so no step repeats the work of the one before.
    """
    t = F.col("t")
    kind = F.when(t.rlike(PACK), "pack").when(t.rlike(BRACKET), "bracket").when(t.rlike(COMPOUND), "compound").when(t.rlike(SIMPLE), "simple")
    rows = rows.withColumn("kind", kind)

    def part(**group: int) -> Column:
        patterns = {"pack": PACK, "bracket": BRACKET, "compound": COMPOUND, "simple": SIMPLE}
        first, *rest = [(F.col("kind") == k, F.trim(F.regexp_extract(t, patterns[k], g))) for k, g in group.items()]
        out = F.when(*first)
        for case in rest:
            out = out.when(*case)
        return out

    return rows.withColumns(
        {
            "tokens": F.array(part(pack=1, bracket=1), part(pack=2, bracket=2, compound=1, simple=1), part(compound=3)),
            "unit": part(pack=3, bracket=3, compound=2, simple=2),
            "more_unit": part(compound=4),
        }
    )


def to_base_units(
    df: DataFrame, id_col: str, text_col: str, quantity_col: str | None = None, unit_col: str | None = None, default_unit: str | None = None
) -> DataFrame:
    """(record_id, base_unit, amount): the amount of each row in grams or millilitres, as a double.

    The text comes first, as it is whole; then quantity column with the unit of column or
    text; then ``default_unit``, the unit of a source that never writes one (none by default).
    """
    quantity = F.col(f"`{quantity_col}`").cast("double") if quantity_col else F.lit(None).cast("double")
    unit = F.col(f"`{unit_col}`").cast("string") if unit_col else F.lit(None).cast("string")
    rows = df.select(F.col(f"`{id_col}`").alias("record_id"), F.col(f"`{text_col}`").cast("string").alias("t"), unit.alias("u"), quantity.alias("q"))
    rows = rows.filter(F.col("record_id").isNotNull())
    order = F.xxhash64("t", "u", "q")
    rows = rows.select("record_id", "q", tidy(F.col("t")).alias("t"), tidy(F.col("u")).alias("u"), order.alias("order"))
    column_pack = rf"^[x×*] ?({NUMBER}) ?({UNIT})"
    lone_unit = rf"(?:^|[\s,:-])({UNIT})"
    rows = measures(rows).withColumns({"tokens": F.concat("tokens", F.array(F.regexp_extract("u", column_pack, 1))), "pack_unit": F.regexp_extract("u", column_pack, 2)})
    rows = rows.withColumn("numbers", F.transform("tokens", number))
    times, value, more, pack_size = (F.get("numbers", F.lit(k)) for k in range(4))
    from_text = F.col("kind").isNotNull() & value.isNotNull()
    parsed = F.struct(
        "order",
        F.when(from_text, F.coalesce(times, F.lit(1.0)) * value).otherwise(F.col("q") * F.coalesce(pack_size, F.lit(1.0))).alias("value"),
        F.coalesce(
            F.when(from_text, alias_key(F.col("unit"))),
            F.when(pack_size.isNotNull(), alias_key(F.col("pack_unit"))),
            alias_key(F.col("u")),
            alias_key(F.regexp_extract("t", lone_unit, 1)),
            F.lit(default_unit).cast("string"),
        ).alias("alias"),
        F.when(from_text, more).alias("more"),
        F.when(from_text, alias_key(F.col("more_unit"))).alias("more_alias"),
    )
    # Parsed before the aggregate, so that no filter on a parsed value is pushed down and parsed again.
    rows = rows.groupBy("record_id").agg(F.min(parsed).alias("r")).select("record_id", "r.value", "r.alias", "r.more", "r.more_alias")
    rows = rows.filter(F.col("value").isNotNull() & F.col("alias").isNotNull())
    units = unit_table(df.sparkSession)
    second = units.select(F.col("alias").alias("more_alias"), F.col("factor").alias("more_factor"))
    amount = F.col("value") * F.col("factor") + F.col("offset") + F.coalesce(F.col("more") * F.col("more_factor"), F.lit(0.0))
    # The alias table is fixed, about a hundred rows.
    return rows.join(F.broadcast(units), "alias").join(F.broadcast(second), "more_alias", "left").select("record_id", "base_unit", amount.alias("amount"))


def amount_milli(amount: Column) -> Column:
    return F.floor(amount * 1000 + F.lit(0.5)).cast("bigint")

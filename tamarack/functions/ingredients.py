"""Ingredient lines: amount, unit and name, and the canonical form of a name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack.functions.text import NW, W, squeeze, strip

# Unit words of ingredient lines.
UNIT_WORDS = [
    "g", "grams", "gram", "kg", "kilograms", "ml", "millilitres", "milliliters", "l", "litre", "litres", "liter", "liters",
    "tbsp", "tbsps", "tablespoon", "tablespoons", "tsp", "tsps", "teaspoon", "teaspoons", "unit(s)", "units", "unit",
    "cup", "cups", "clove(s)", "cloves", "clove", "sachet(s)", "sachets", "sachet", "bunch(es)", "bunches", "bunch",
    "ball(s)", "balls", "ball", "pinch(es)", "pinches", "pinch", "pack(s)", "packs", "pack", "ounce(s)", "ounces", "ounce", "oz",
    "slice(s)", "slices", "slice", "piece(s)", "pieces", "piece", "block(s)", "blocks", "block", "fl oz", "carton(s)", "cartons",
    "carton", "milliliter(s)", "millilitre(s)", "pot(s)", "pots", "pot", "tin(s)", "tins", "tin", "jar(s)", "jars", "jar",
    "punnet(s)", "punnets", "punnet", "bottle(s)", "bottles", "bottle", "bag(s)", "bags", "bag", "handful(s)", "handfuls", "handful",
]
# Unit words that stand for a plain count.
COUNT_WORDS = ["unit(s)", "units", "unit"]
# Fraction characters.
FRACTIONS = {"¼": 0.25, "½": 0.5, "¾": 0.75, "⅓": 1 / 3, "⅔": 2 / 3, "⅛": 0.125, "⅜": 0.375, "⅝": 0.625, "⅞": 0.875}
# Words that end in s without being plurals.
INVARIANT = ["houmous", "hummus", "couscous", "asparagus", "molasses", "brussels", "manis"]

_V = "".join(FRACTIONS)
_LINE = rf"(?s)^(\d+(?:\.\d+)?(?:/\d+)?|\d*[{_V}]){W}+(.+)\z"


def quantity(token: Column) -> Column:
    """a/b, a fraction character with or without a whole number before it, or a decimal; else null. n/0 is null."""
    last = F.try_element_at(F.create_map(*[F.lit(x) for kv in FRACTIONS.items() for x in kv]), F.right(token, F.lit(1)))
    part = [F.regexp_extract(token, r"^(\d+)/(\d+)\z", i).try_cast("double") for i in (1, 2)]
    whole = F.coalesce(F.regexp_extract(token, rf"^(\d+)[{_V}]\z", 1).try_cast("double"), F.lit(0.0))
    return F.when(token.rlike(r"^\d+/\d+\z"), F.try_divide(*part)).when(token.rlike(rf"^\d*[{_V}]\z"), whole + last).when(token.rlike(r"^\d+(\.\d+)?\z"), token.try_cast("double"))


def parse_line(raw: Column) -> Column:
    """struct(quantity, unit, name) of an ingredient line.

    The amount must stand first with white space behind it. A unit is taken only if it is a known
    unit word, of two words or one; count words become no unit. Without an amount a leading unit
    word is still taken off the name.
    """
    text = strip(raw)
    amount = F.when(text.rlike(_LINE), quantity(F.regexp_extract(text, _LINE, 1)))
    rest = F.when(amount.isNotNull(), F.regexp_extract(text, _LINE, 2)).otherwise(text)
    two, one = rf"(?s)^({NW}+{W}+{NW}+){W}+(.+)\z", rf"(?s)^({NW}+){W}+(.+)\z"

    def pick(state: Column) -> Column:
        rest, has = state["rest"], state["amount"].isNotNull()
        long, short = F.lower(F.regexp_extract(rest, two, 1)), F.lower(F.regexp_extract(rest, one, 1))
        is_long = has & long.isin(UNIT_WORDS)
        is_short = short.isin(UNIT_WORDS)
        unit = F.when(is_long, long).when(is_short, short)
        name = F.when(is_long, strip(F.regexp_extract(rest, two, 2))).when(is_short, strip(F.regexp_extract(rest, one, 2))).otherwise(strip(rest))
        return F.struct(state["amount"].alias("quantity"), F.when(~unit.isin(COUNT_WORDS), unit).alias("unit"), name.alias("name"))

    # A one-element transform binds amount and rest once, so the plan does not repeat them.
    return F.when(raw.isNotNull(), F.get(F.transform(F.array(F.struct(amount.alias("amount"), rest.alias("rest"))), pick), F.lit(0)))


def singular(name: Column) -> Column:
    """The phrase with its last word in the singular, by ending; lengths are those of the whole phrase."""
    n = F.length(name)
    return (
        F.when(F.element_at(F.split(name, " "), -1).isin(INVARIANT), name)
        .when(F.endswith(name, F.lit("ies")) & (n > 5), F.concat(F.left(name, n - 3), F.lit("y")))
        .when(F.endswith(name, F.lit("oes")) & (n > 5), F.left(name, n - 2))
        .when(F.endswith(name, F.lit("s")) & ~F.endswith(name, F.lit("ss")) & (n > 4), F.left(name, n - 1))
        .otherwise(name)
    )


def canonical_name(name: Column) -> Column:
    """The form in which names of one ingredient agree: lower case, no marks, no purpose clause, singular."""
    t = squeeze(F.regexp_replace(F.lower(strip(name)), "[®™]", ""))
    t = F.regexp_replace(t, r"[.,]+\z", "")
    t = strip(F.regexp_replace(t, rf"{W}+for{W}+.+\z", ""))
    return singular(F.when(t.isin("boiled water", "boiling water"), F.lit("water")).otherwise(t))

"""Golden cases of the scalar functions, and a property test of the line parser."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamarack.functions import ingredients, protein, text


def values(spark, fn, inputs, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}").select("i", fn(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.i)]


def test_lines(spark):
    cases = {
        "1 unit(s) Garlic Clove": (1, None, "Garlic Clove"),
        "450 grams Potatoes": (450, "grams", "Potatoes"),
        "4 Chicken Thigh": (4, None, "Chicken Thigh"),
        "½ tbsp Oil": (0.5, "tbsp", "Oil"),
        "1½ tbsp Oil": (1.5, "tbsp", "Oil"),
        "1/2 cup Milk": (0.5, "cup", "Milk"),
        "2 fl oz Cream": (2, "fl oz", "Cream"),
        "unit(s) Turkey for 8-10p": (None, None, "Turkey for 8-10p"),
        "Salt": (None, None, "Salt"),
        "200g Chicken": (None, None, "200g Chicken"),
        "1 1/2 cup Milk": (1, None, "1/2 cup Milk"),
        "1.5/2 cup Milk": (None, None, "1.5/2 cup Milk"),
        "1/0 cup Milk": (None, None, "1/0 cup Milk"),
        "": (None, None, ""),
    }
    assert [tuple(r) for r in values(spark, ingredients.parse_line, cases)] == list(cases.values())
    assert values(spark, ingredients.parse_line, [None]) == [None]


def test_canonical_names(spark):
    cases = {"Garlic Cloves": "garlic clove", "Water for the Sauce": "water", "Boiling Water": "water", "Cherry Tomatoes": "cherry tomato", "Berries": "berry", "Couscous": "couscous", "Lemongrass": "lemongrass", "Eggs": "eggs", "Red Eggs": "red egg", "Salt.": "salt"}
    assert values(spark, ingredients.canonical_name, cases) == list(cases.values())


def test_fields(spark):
    assert values(spark, text.duration_minutes, ["PT35M", "PT1H10M", "PT90S", "PT0M", "PT", None, "x"]) == [35, 70, 2, 0, None, None, None]
    assert values(spark, text.calories, ["750 kcal", "1,200 kcal", ""]) == [750, 1, None]
    assert values(spark, text.grams, ["17.1 g"]) == [17.1]
    assert values(spark, text.servings, ["Serves 2", "4", "2.5"]) == [2, 4, 3]
    assert values(spark, text.number_or_null, ["", "abc", None, "1e400", " 7 "]) == [0.0, None, None, None, 7.0]
    assert values(spark, text.leading_int, ["400abc", "x1", "", None]) == [400, None, None, None]
    assert [tuple(r) for r in values(spark, text.title_parts, ["Korma   Salmon WITH Chips", "Within Reach"])] == [("Korma Salmon", "with Chips"), ("Within Reach", None)]
    assert values(spark, text.html_text, ["<p>a&amp;lt;b</p><br>c"]) == ["a<b\nc"]
    assert values(spark, text.slugify, ["Fish & Chips!"]) == ["fish-chips"]
    assert [tuple(r) for r in values(spark, text.url_ids, ["https://x.example/recipes/market/x-69e0c9b84af8f3547a64b22d", "https://x.example/recipes/old-1"])] == [("69e0c9b84af8f3547a64b22d", "x-69e0c9b84af8f3547a64b22d"), ("old-1", "old-1")]
    assert values(spark, text.plain_number, [2.0, 0.5, 1.005, 12.34, 0.1], "double") == ["2", "0.5", "1", "12.34", "0.1"]
    assert values(spark, text.usable_image, ["a/b.jpg", "a/", "", None]) == [True, False, False, False]
    assert values(spark, text.safe_path, ["a/b.png", "../x", "/etc", "", None]) == [True, False, False, False, False]
    assert values(spark, text.strip, [" \t a  "]) == ["a"]


def test_variant_text(spark):
    out = spark.sql("""select v from values ('0'), ('"0"'), ('" "'), ('" x "'), ('null') t(v)""").select(text.text_or_null(F.parse_json("v")).alias("r")).collect()
    assert [r.r for r in out] == [None, "0", None, "x", None]


def test_protein_classes(spark):
    cases = [([], "UNKNOWN"), (["Chicken Stock Pot", "Carrot"], "VEGETARIAN"), (["Burger Bun", "Onion Bhaji"], "VEGETARIAN"), (["Goat's Cheese"], "VEGETARIAN"), (["Pork Mince", "Chicken Stock"], "PORK"), (["Mince"], "BEEF"), (["Bacon", "Chicken Thigh"], "CHICKEN"), (["Bacon", "Ham", "Chicken Thigh"], "PORK"), (["Beef Steak", "Prawns"], "FISH"), (["Fish Sauce", "Tofu"], "FISH"), (["Vegan Mince", "Onion"], "VEGAN"), (["Quorn Mince"], "VEGETARIAN"), (["Caféham"], "PORK")]
    recipes = spark.createDataFrame([(i, "") for i in range(len(cases))], "recipe_id int, meta string")
    lines = spark.createDataFrame([(i, n) for i, (names, _) in enumerate(cases) for n in names], "recipe_id int, name string")
    out = {r.recipe_id: r.protein_class for r in protein.protein_class(recipes, lines).collect()}
    assert [out[i] for i in range(len(cases))] == [c for _, c in cases]


def reference_line(raw):
    """The rule stated again, one step after the other."""
    import re

    t = raw.strip()
    m = re.match(r"(\d+(?:\.\d+)?(?:/\d+)?|\d*[½¼])\s+(.+)\Z", t, re.S)
    q, rest = None, t
    if m:
        tok = m[1]
        if re.fullmatch(r"\d+/\d+", tok):
            a, b = map(int, tok.split("/"))
            q = a / b if b else None
        elif tok[-1] in "½¼":
            q = int(tok[:-1] or 0) + {"½": 0.5, "¼": 0.25}[tok[-1]]
        elif re.fullmatch(r"\d+(\.\d+)?", tok):
            q = float(tok)
        rest = m[2] if q is not None else t
    words = rest.split()
    for n in (2, 1) if q is not None else (1,):
        u = " ".join(words[:n]).lower()
        if len(words) > n and u in ingredients.UNIT_WORDS:
            return q, None if u in ingredients.COUNT_WORDS else u, " ".join(words[n:])
    return q, None, " ".join(words)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["1", "2.5", "1/2", "½", "3½", "g", "fl", "oz", "unit(s)", "cup", "Red", "Onion", "5/0", "200g"]), min_size=1, max_size=5).map(" ".join), min_size=20, max_size=40))
def test_lines_like_the_rule(spark, raws):
    assert [tuple(r) for r in values(spark, ingredients.parse_line, raws)] == [reference_line(r) for r in raws]

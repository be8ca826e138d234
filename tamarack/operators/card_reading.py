"""Reading a whole scanned card: template, title, ingredients, nutrition, steps and warnings in one plan.

A card is one row. What OCR read in each of its crops is an array of lines (text, x, y, red), a few
dozen at most, so tables are aligned with higher-order functions and nothing is shuffled or handed to Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.ingredients import parse_line
from tamarack.functions.text import strip
from tamarack.operators import cards as C

LINE = "struct<text:string,x:double,y:double,red:boolean>"
# Least letters of a row label, least width of a label column and its distance from the values, columns of a plain and of a double table.
LEAST_LETTERS, LEAST_WIDTH, LABEL_GAP, PLAIN_COLUMNS, DOUBLE_COLUMNS = 3, 0.02, 0.005, 2, 4


def name_lines(lines: Column) -> Column:
    """Lines of the name column: short continuations joined to the line before, headings and what follows the table left out."""

    def join(acc: Column, l: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(strip(F.concat_ws(" ", last["text"], l["text"])).alias("text"), last["x"].alias("x"), last["y"].alias("y"), last["red"].alias("red"))
        continues = (F.size(acc) > 0) & l["text"].rlike(r"^[\d\s|).]{1,6}\z")
        return F.when(continues, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(l)))

    merged = F.aggregate(lines, F.array().cast(f"array<{LINE}>"), join)
    kept = C.ingredient_lines(F.transform(merged, lambda l: l["text"]))
    # The kept texts stand in the order of their lines; the first line of each text is its own.
    state = F.struct(F.array().cast(f"array<{LINE}>").alias("out"), kept.alias("left"))

    def take(s: Column, l: Column) -> Column:
        own = F.coalesce(F.get(s["left"], F.lit(0)) == l["text"], F.lit(False))
        return F.struct(F.when(own, F.concat(s["out"], F.array(l))).otherwise(s["out"]).alias("out"), F.when(own, F.slice(s["left"], 2, F.size(s["left"]))).otherwise(s["left"]).alias("left"))

    return F.aggregate(merged, state, take, lambda s: s["out"])


def ingredient_table(names: Column, columns: Column) -> Column:
    """array of struct(name, cells): each quantity column aligned with the names; a cell has quantity, unit and raw_text, "" where it is missing."""
    matched = F.transform(columns, lambda lines: C.match_nearest(names, lines))

    def cell(text: Column) -> Column:
        q = C.quantity_cell(text)
        return F.struct(q["quantity"].alias("quantity"), q["unit"].alias("unit"), F.coalesce(text, F.lit("")).alias("raw_text"))

    return F.transform(names, lambda n, i: F.struct(n["text"].alias("name"), F.transform(matched, lambda m: cell(F.get(m, i))).alias("cells")))


def ingredient_list(lines: Column) -> Column:
    """The same of a flat list, one ingredient and one cell a line: bullets off, a missing space between number and unit put in; lines without a name are left out."""

    def row(t: Column) -> Column:
        raw = F.regexp_replace(C.bullet(t), rf"^{C.NUMBER}(?=[a-zA-Z])", "$1 ")
        p = parse_line(raw)
        return F.struct(p["name"].alias("name"), F.array(F.struct(p["quantity"].alias("quantity"), p["unit"].alias("unit"), raw.alias("raw_text"))).alias("cells"))

    kept = C.ingredient_lines(F.transform(lines, lambda l: l["text"]), table=False)
    return F.filter(F.transform(kept, row), lambda r: F.coalesce(r["name"] != "", F.lit(False)))


def label_lines(lines: Column) -> Column:
    """Row labels of a nutrition table: lines with three letters outside of brackets."""
    return F.filter(lines, lambda l: F.length(F.regexp_replace(F.regexp_replace(l["text"], r"\([^)]*\)", ""), "[^a-zA-Z]", "")) >= LEAST_LETTERS)


def value_lines(lines: Column) -> Column:
    """Cells of a value column: lines that begin with a digit, without a lone kilojoule row."""
    return F.filter(lines, lambda l: l["text"].rlike(r"^\d") & ~F.coalesce(C.lone_energy_row(l["text"]), F.lit(False)))


def nutrition_table(labels: Column, values: Column, wider: Column) -> Column:
    """struct of the nutrients of a table. ``wider`` is a second reading of the values with more room at the top.

    It counts where the first has fewer rows than there are labels and the second has more. The first row
    is the energy row if its label names no other nutrient.
    """
    rows, own, more = label_lines(labels), value_lines(values), value_lines(wider)
    chosen = F.when((F.size(own) < F.size(rows)) & (F.size(F.coalesce(more, F.array())) > F.size(own)), more).otherwise(own)
    matched = C.match_nearest(rows, chosen)
    field = F.transform(rows, lambda l, i: F.when((i == 0) & C.nutrient_of(l["text"]).isNull(), "calories").otherwise(C.nutrient_of(l["text"])))
    pairs = F.filter(F.arrays_zip(field.alias("field"), matched.alias("value")), lambda p: p["value"].isNotNull())

    def value(name: str) -> Column:
        cell = F.try_element_at(F.filter(pairs, lambda p: p["field"] == name), F.lit(-1))["value"]
        return C.energy_kcal(cell).cast("double") if name == "calories" else F.regexp_extract(cell, C.NUMBER, 1).try_cast("double")

    return F.struct(*[value(k).alias(k) for k in C.NUTRIENTS])


def nutrition(layout: Column, labels: Column, values: Column, wider: Column, block: Column, fields: list[str]) -> Column:
    """struct of the nutrients by the card's layout: ``table``, ``labeled`` or ``positional`` (``fields`` names its columns)."""
    by_place = C.positional_nutrition(block, fields) if fields else None
    numbers = {k: by_place[k] if k in fields else F.lit(None).cast("double") for k in C.NUTRIENTS}
    placed = F.struct(*[(F.floor(v + 0.5).cast("double") if k == "calories" else v).alias(k) for k, v in numbers.items()])
    return F.when(layout == "table", nutrition_table(labels, values, wider)).when(layout == "labeled", C.labeled_nutrition(block)).when(layout == "positional", placed)


def corrected_regions(label: Column, value: Column, found: Column, expected: Column, columns: Column) -> Column:
    """struct(label, value, second): regions of a nutrition table moved by the distance of its heading from where it is expected.

    Regions are structs (left, top, width, height) in fractions of the page, ``found`` (null where the heading was not
    read) and ``expected`` are points (left, top), ``columns`` the x of the column headings. Two or more of them fix the
    value column and bound the label column; with four the third is a second value column.
    """

    def moved(r: Column) -> Column:
        dx, dy = (F.coalesce(found[k] - expected[k], F.lit(0.0)) for k in ("left", "top"))
        return F.struct(C.shift(r["left"], dx, r["width"]).alias("left"), C.shift(r["top"], dy, r["height"]).alias("top"), r["width"].alias("width"), r["height"].alias("height"))

    def with_parts(r: Column, **parts: Column) -> Column:
        return F.struct(*[parts.get(k, r[k]).alias(k) for k in ("left", "top", "width", "height")])

    a, b, n, x = moved(label), moved(value), F.coalesce(F.size(columns), F.lit(0)), F.get(columns, F.lit(0))
    narrow = F.least(a["width"], F.greatest(F.lit(LEAST_WIDTH), x - a["left"] - LABEL_GAP))
    return F.struct(
        F.when(n >= PLAIN_COLUMNS, with_parts(a, width=narrow)).otherwise(a).alias("label"),
        F.when(n >= PLAIN_COLUMNS, with_parts(b, left=x)).otherwise(b).alias("value"),
        F.when(n >= DOUBLE_COLUMNS, with_parts(b, left=F.get(columns, F.lit(2)))).alias("second"),
    )


def grid_steps(steps: Column) -> Column:
    """array of struct(heading, text) of the crops of single steps (arrays of lines)."""

    def step(lines: Column) -> Column:
        texts = F.filter(F.transform(lines, lambda l: strip(l["text"])), lambda t: t != "")
        heading = C.step_heading(F.get(texts, F.lit(0)))
        rest = F.when(heading.isNotNull(), F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(0)))).otherwise(texts)
        return F.struct(heading.alias("heading"), F.array_join(rest, " ").alias("text"))

    return F.transform(steps, step)


def serving(cells: Column, at: Column) -> Column:
    """The cell of the wanted serving column, else the first one, else null."""
    return F.coalesce(F.get(cells, at), F.get(cells, F.lit(0)))


def draft_record(parsed: DataFrame) -> DataFrame:
    """A parsed card as it is stored: without binary columns, and steps with nothing but heading and text."""
    keep = [f.name for f in parsed.schema.fields if f.dataType.simpleString() != "binary"]
    steps = F.transform("steps", lambda s: F.struct(s["heading"].alias("heading"), s["text"].alias("text")))
    return parsed.select(*[c for c in keep if c != "steps"], steps.alias("steps"))


def read_cards(cards: DataFrame, fields: list[str] = (), logo: tuple[str, ...] = ()) -> DataFrame:
    """(card_id, error, template, name, subtitle, cook_minutes, ingredients, nutrition, optional_nutrition, steps, warnings), one row a card.

    ``cards``: card_id, pages, titles array<struct<template,title,time>> in the order in which templates are tried,
    ingredient_layout (table or list), names, columns array<array<line>>, nutrition_layout, labels, values, wider,
    second_values (null without a second column), block, step_layout (grid or flowing), step_crops array<array<line>>,
    step_columns array<string>. A card with fewer than two pages or without a template that fits has an error and nothing else.
    """
    named = F.transform("titles", lambda t: F.struct(t["template"].alias("template"), C.card_title(t["title"], logo).alias("title"), C.card_minutes(t["time"]).alias("minutes")))
    fits = F.get(F.filter(named, lambda t: F.coalesce((F.size(F.split(strip(t["title"]["name"]), r"\s+")) >= 2) & t["minutes"].isNotNull(), F.lit(False))), F.lit(0))
    rows = cards.withColumn("fit", fits).withColumn("kept_names", name_lines(F.col("names")))
    error = F.when(F.coalesce(F.col("pages"), F.lit(0)) < 2, "fewer than two pages").when(F.col("fit").isNull(), "unknown layout")
    table, grid = F.col("ingredient_layout") == "table", F.col("step_layout") == "grid"
    flowing = F.transform(C.flowing_steps(F.col("step_columns")), lambda t: F.struct(F.lit(None).cast("string").alias("heading"), t.alias("text")))
    rows = rows.select(
        "*",
        error.alias("error"),
        F.when(table, ingredient_table(F.col("kept_names"), F.col("columns"))).otherwise(ingredient_list(F.flatten("columns"))).alias("ingredients"),
        nutrition(F.col("nutrition_layout"), F.col("labels"), F.col("values"), F.col("wider"), F.col("block"), list(fields)).alias("nutrition"),
        F.when(F.col("second_values").isNotNull(), nutrition_table(F.col("labels"), F.col("second_values"), F.col("second_values"))).alias("optional_nutrition"),
        F.when(grid, grid_steps(F.col("step_crops"))).otherwise(flowing).alias("steps"),
    )

    def each(on: Column, items: Column) -> Column:
        return F.when(F.coalesce(on, F.lit(False)), items).otherwise(F.array().cast("array<string>"))

    n_names = F.size("kept_names")
    short = F.transform(F.filter("columns", lambda c: F.size(c) < n_names), lambda c: F.concat(F.lit("quantity column with "), F.size(c).cast("string"), F.lit(" of "), n_names.cast("string"), F.lit(" rows")))
    red_names = F.transform(F.filter("kept_names", lambda l: F.coalesce(l["red"], F.lit(False))), lambda l: F.concat(F.lit("red ingredient: "), l["text"]))
    step_no = F.transform("step_crops", lambda ls, i: F.struct((i + 1).cast("string").alias("n"), F.exists(ls, lambda l: F.coalesce(l["red"], F.lit(False))).alias("red")))
    red_steps = F.transform(F.filter(step_no, lambda s: s["red"]), lambda s: F.concat(F.lit("red text in step "), s["n"]))
    blank = F.filter(F.transform("steps", lambda s, i: F.when(s["text"] == "", F.concat(F.lit("no text in step "), (i + 1).cast("string")))), lambda w: w.isNotNull())
    warnings = F.concat(
        each(table, short),
        each(table, red_names),
        each(F.size("ingredients") == 0, F.array(F.lit("no ingredients"))),
        each(F.col("nutrition.calories").isNull(), F.array(F.lit("no calories"))),
        each(F.col("optional_nutrition").isNotNull(), F.array(F.lit("second nutrition column"))),
        each(grid, red_steps),
        each(grid, blank),
        each(~grid & (F.size("steps") == 0), F.array(F.lit("no steps"))),
    )
    ok = F.col("error").isNull()
    parts = {"template": F.col("fit.template"), "name": F.col("fit.title.name"), "subtitle": F.col("fit.title.subtitle"), "cook_minutes": F.col("fit.minutes"), **{c: F.col(c) for c in ("ingredients", "nutrition", "optional_nutrition", "steps")}, "warnings": warnings}
    return rows.select("card_id", "error", *[F.when(ok, c).alias(k) for k, c in parts.items()])

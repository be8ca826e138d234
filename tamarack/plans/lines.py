"""Queries of scalar functions on the project's texts; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarack.functions import ingredients as I
from tamarack.functions import protein as P
from tamarack.functions import text as T
from tamarack.operators import browse, ingest, state
from tamarack.plans.baskets import _entries, _sets
from tamarack.session import table


def parse_lines(spark, sf_dir):
    """Amount, unit and name of every raw line."""
    lines = table(spark, sf_dir, "parsed_ingredient_line").select("line_id", I.parse_line(F.col("raw_text")).alias("p")).distinct()
    return lines.select("line_id", F.round("p.quantity", 9).alias("quantity"), "p.unit", "p.name")


def canonical_names(spark, sf_dir):
    """Canonical form of every typed name."""
    return table(spark, sf_dir, "edited_ingredient").select("name").distinct().select("name", I.canonical_name(F.col("name")).alias("canonical"))


def title_parts(spark, sf_dir):
    """names with their subtitles put behind, split again."""
    now = browse.current(table(spark, sf_dir, "recipe"), "name", "subtitle")
    full = T.title_parts(F.concat_ws("  ", "name", F.regexp_replace("subtitle", "^with", "WITH")))
    return now.select("id", full["name"].alias("name"), full["subtitle"].alias("subtitle"))


def url_ids(spark, sf_dir):
    """Id, slug and cache key of every page."""
    urls = table(spark, sf_dir, "parsed_ingredient_line").select("page_url").distinct()
    return urls.select("page_url", T.url_ids(F.col("page_url")).alias("i"), T.cache_key(F.col("page_url")).alias("cache_key")).select("page_url", "i.ext_id", "i.slug", "cache_key")


def slugs(spark, sf_dir):
    """Slug and capitalised form of every distinct typed name."""
    return table(spark, sf_dir, "edited_ingredient").select("name").distinct().select("name", T.slugify(F.col("name")).alias("slug"), T.capitalize(F.col("name")).alias("capital"))


def unique_slugs(spark, sf_dir):
    """free slugs for all recipes that are named by their category, the slugs of two of them being taken."""
    now = browse.current(table(spark, sf_dir, "recipe"), "category").select("id", F.coalesce("category", F.lit("No category")).alias("name"))
    taken = spark.createDataFrame([("bake",), ("bake-3",), ("soup-2",)], "slug string")
    return state.unique_slugs(now, taken)


def field_numbers(spark, sf_dir):
    """Durations, calories, grams, servings and prefixes read from text made of the columns."""
    now = browse.current(table(spark, sf_dir, "recipe"), "cook_minutes", "calories", "fat_grams", "servings")
    minutes = F.concat(F.lit("PT"), (F.col("cook_minutes") / 60).cast("int").cast("string"), F.lit("H"), (F.col("cook_minutes") % 60).cast("string"), F.lit("M"))
    return now.select(
        "id",
        T.duration_minutes(minutes).alias("minutes"),
        T.calories(F.concat(F.col("calories").cast("string"), F.lit(" kcal"))).alias("kcal"),
        T.grams(F.concat(F.col("fat_grams").cast("string"), F.lit(" g"))).alias("fat"),
        T.servings(F.concat(F.lit("Serves "), F.col("servings").cast("string"))).alias("servings"),
        T.leading_int(F.concat(F.lit("  "), F.col("calories").cast("string"), F.lit("abc"))).alias("prefix"),
    )


def html_texts(spark, sf_dir):
    """Step texts wrapped in HTML and read back."""
    now = browse.current(table(spark, sf_dir, "recipe"), "steps")
    html = F.concat(F.lit("<p> "), F.replace(F.replace(F.col("x.text"), F.lit("&"), F.lit("&amp;")), F.lit("'"), F.lit("&#39;")), F.lit("</p><br/> <b>x&nbsp;</b>"))
    return now.select("id", F.posexplode("steps").alias("pos", "x")).select("id", "pos", T.html_text(html).alias("text"))


def plain_numbers(spark, sf_dir):
    """Quantities as text with at most two decimals."""
    return _entries(spark, sf_dir).select("entry_id", F.concat_ws(" ", T.plain_number(F.col("quantity")), F.nullif("unit", F.lit(""))).alias("label"))


def protein_classes(spark, sf_dir):
    """Protein class of every recipe from its canonical ingredient names."""
    names = table(spark, sf_dir, "ingredient").select(F.col("id").alias("ingredient_id"), F.col("canonical_name").alias("name"))
    lines = _sets(spark, sf_dir).select("recipe_id", F.explode("ingredient_ids").alias("ingredient_id")).join(names, "ingredient_id").select("recipe_id", "name")
    now = browse.current(table(spark, sf_dir, "recipe"), "name", "category", "cuisine").select(F.col("id").alias("recipe_id"), F.concat_ws(" ", "name", "category", "cuisine").alias("meta"))
    return P.protein_class(now, lines)


def resolve_names(spark, sf_dir):
    """Every distinct typed name resolved to an ingredient id, new where nothing fits."""
    args = table(spark, sf_dir, "edited_ingredient"), table(spark, sf_dir, "ingredient_alias"), table(spark, sf_dir, "ingredient")
    return state.resolve_names(*args, I.canonical_name(F.col("name"))).select("name", F.when(~F.col("is_new"), F.col("ingredient_id")).alias("ingredient_id"), "is_new")


def form_rows(spark, sf_dir):
    """Edit forms as parallel arrays, zipped back into rows."""
    rows = table(spark, sf_dir, "edited_ingredient").select("edit_id", "recipe_id", "row_no", "name", "unit").distinct()
    forms = rows.groupBy("recipe_id").agg(F.array_sort(F.collect_list(F.struct("row_no", "edit_id", "name", "unit"))).alias("f"))
    forms = forms.select("recipe_id", F.col("f.name").alias("name"), F.col("f.unit").alias("unit"))
    return ingest.form_rows(forms, "recipe_id", ["name", "unit"])


QUERIES = [parse_lines, canonical_names, title_parts, url_ids, slugs, unique_slugs, field_numbers, html_texts, plain_numbers, protein_classes, resolve_names, form_rows]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def _canonical_sql(c: str) -> str:
    """SQL of the canonical name, without the plural rule, which needs the result twice."""
    w = T.W
    t = f"regexp_replace(lower(regexp_replace({c}, '^{w}+|{w}+$', '', 'g')), '[®™]', '', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '{w}+', ' ', 'g'), '^ | $', '', 'g')"
    t = f"regexp_replace({t}, '[.,]+$', '')"
    t = f"regexp_replace(regexp_replace({t}, '{w}+for{w}+.+$', ''), '^ +| +$', '', 'g')"
    return f"CASE WHEN {t} IN ('boiled water', 'boiling water') THEN 'water' ELSE {t} END"


def _singular_sql(c: str) -> str:
    invariant = ", ".join(f"'{x}'" for x in I.INVARIANT)
    return f"CASE WHEN string_split({c}, ' ')[-1] IN ({invariant}) THEN {c} WHEN suffix({c}, 'ies') AND length({c}) > 5 THEN left({c}, length({c}) - 3) || 'y' WHEN suffix({c}, 'oes') AND length({c}) > 5 THEN left({c}, length({c}) - 2) WHEN suffix({c}, 's') AND NOT suffix({c}, 'ss') AND length({c}) > 4 THEN left({c}, length({c}) - 1) ELSE {c} END"


def oracle_sql() -> dict[str, str]:
    w, nw, v = T.W, T.NW, "".join(I.FRACTIONS)
    units = ", ".join(f"'{u}'" for u in I.UNIT_WORDS)
    counts = ", ".join(f"'{u}'" for u in I.COUNT_WORDS)
    line = rf"(?s)^(\d+(?:\.\d+)?(?:/\d+)?|\d*[{v}]){w}+(.+)$"
    two, one = rf"(?s)^({nw}+{w}+{nw}+){w}+(.+)$", rf"(?s)^({nw}+){w}+(.+)$"
    fraction = " ".join(f"WHEN '{c}' THEN {x!r}::DOUBLE" for c, x in I.FRACTIONS.items())
    strip = lambda c: f"regexp_replace({c}, '^{w}+|{w}+$', '', 'g')"

    def word(n: str, ws: str) -> str:
        has = f"contains({n}, '{ws}')" if " " in ws else f"regexp_matches({n}, '\\b{ws}(e?s)?\\b')"
        return f"({has} AND NOT regexp_matches({n}, '\\b{ws}(''s)?\\s+({'|'.join(P.CONTEXTS)})(e?s)?\\b'))"

    any_of = lambda n, ws: "(" + " OR ".join(word(n, x) for x in ws) + ")"
    species = "CASE " + " ".join(f"WHEN {any_of('x', ws)} THEN '{s}'" for s, ws in P.SPECIES.items()) + " " + " ".join(f"WHEN {word('x', c)} THEN '{s}'" for c, s in P.CUTS.items()) + " END"
    skip = " OR ".join(f"contains(x, '{s}')" for s in P.SUBSTITUTES)
    best = "CASE " + " ".join(f"WHEN {s} = greatest({', '.join(P.PRIORITY)}) THEN '{s}'" for s in P.PRIORITY) + " END"
    slug = lambda c: f"regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    h = "floor(quantity * 100 + 0.5)::BIGINT"
    number = f"CASE WHEN {h} % 100 = 0 THEN ({h} // 100)::VARCHAR ELSE ({h} // 100)::VARCHAR || '.' || rtrim(lpad(({h} % 100)::VARCHAR, 2, '0'), '0') END"
    from tamarack.plans.baskets import CUR, SETS, E

    return {
        "parse_lines": f"""WITH l AS (SELECT DISTINCT line_id, {strip('raw_text')} AS t FROM parsed_ingredient_line),
q AS (SELECT *, regexp_extract(t, '{line}', 1) AS tok, regexp_extract(t, '{line}', 2) AS tail FROM l),
a AS (SELECT *, CASE WHEN regexp_matches(tok, '^\\d+/\\d+$') THEN try_cast(split_part(tok, '/', 1) AS DOUBLE) / nullif(try_cast(split_part(tok, '/', 2) AS DOUBLE), 0)
 WHEN regexp_matches(tok, '^\\d*[{v}]$') THEN coalesce(try_cast(left(tok, length(tok) - 1) AS DOUBLE), 0) + CASE right(tok, 1) {fraction} END
 WHEN regexp_matches(tok, '^\\d+(\\.\\d+)?$') THEN tok::DOUBLE END AS quantity FROM q),
r AS (SELECT *, CASE WHEN quantity IS NULL THEN t ELSE tail END AS rest FROM a),
u AS (SELECT *, lower(regexp_extract(rest, '{two}', 1)) AS u2, lower(regexp_extract(rest, '{one}', 1)) AS u1 FROM r),
p AS (SELECT *, CASE WHEN quantity IS NOT NULL AND u2 IN ({units}) THEN u2 WHEN u1 IN ({units}) THEN u1 END AS unit FROM u)
SELECT line_id, round(quantity, 9) AS quantity, CASE WHEN unit NOT IN ({counts}) THEN unit END AS unit,
 CASE WHEN quantity IS NOT NULL AND u2 IN ({units}) THEN {strip(f"regexp_extract(rest, '{two}', 2)")} WHEN u1 IN ({units}) THEN {strip(f"regexp_extract(rest, '{one}', 2)")} ELSE {strip('rest')} END AS name FROM p""",
        "canonical_names": f"WITH c AS (SELECT DISTINCT name, {_canonical_sql('name')} AS c FROM edited_ingredient) SELECT name, {_singular_sql('c')} AS canonical FROM c",
        "title_parts": f"WITH {CUR} SELECT id, name, subtitle FROM cur",
        "url_ids": "WITH u AS (SELECT DISTINCT page_url, regexp_extract(page_url, '([^/]+)/*$', 1) AS slug FROM parsed_ingredient_line) SELECT page_url, slug, coalesce(nullif(regexp_extract(slug, '(?i)-([0-9a-f]{16,})$', 1), ''), slug) AS ext_id, regexp_replace(regexp_replace(page_url, '^https?://[^/]+/+', ''), '[^A-Za-z0-9._-]+', '_', 'g') AS cache_key FROM u",
        "slugs": f"SELECT DISTINCT name, {slug('name')} AS slug, upper(left(name, 1)) || substring(name, 2) AS capital FROM edited_ingredient",
        "unique_slugs": f"""WITH {CUR}, b AS (SELECT id, {slug("coalesce(category, 'No category')")} AS base FROM cur), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS n FROM b),
k AS (SELECT n.id, base, CASE WHEN base = 'bake' THEN CASE WHEN n.n = 1 THEN 2 ELSE n.n + 2 END WHEN base = 'soup' AND n.n > 1 THEN n.n + 1 ELSE n.n END AS k FROM n)
SELECT id, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS slug FROM k""",
        "field_numbers": f"WITH {CUR} SELECT id, cook_minutes AS minutes, calories AS kcal, fat_grams AS fat, servings, calories AS prefix FROM cur",
        "html_texts": f"WITH {CUR}, x AS (SELECT id, unnest(steps).text AS t, generate_subscripts(steps, 1) - 1 AS pos FROM cur) SELECT id, pos::INTEGER AS pos, trim(t) || chr(10) || 'x' AS text FROM x WHERE t IS NOT NULL",
        "plain_numbers": f"WITH {E} SELECT entry_id, concat_ws(' ', {number}, nullif(unit, '')) AS label FROM e",
        "protein_classes": f"""WITH {CUR}, {SETS}, l AS (SELECT recipe_id, lower(canonical_name) AS x FROM (SELECT recipe_id, unnest(ingredient_ids) AS i FROM s) u JOIN ingredient g ON g.id = u.i),
f AS (SELECT DISTINCT x, ({skip}) AS skip, regexp_matches(x, '\\bvegan\\b') AS vegan, {any_of('x', P.FISH)} AS fish, {species} AS species FROM (SELECT DISTINCT x FROM l)),
c AS (SELECT recipe_id, count(*) AS n, bool_or(vegan) AS vegan, bool_or(fish AND NOT skip) AS fish, {', '.join(f"count(*) FILTER (NOT skip AND species = '{s}') AS {s}" for s in P.PRIORITY)} FROM l JOIN f USING (x) GROUP BY 1)
SELECT id AS recipe_id, CASE WHEN n IS NULL THEN 'UNKNOWN' WHEN c.fish THEN 'FISH' WHEN greatest({', '.join(P.PRIORITY)}) > 0 THEN {best} WHEN coalesce(c.vegan, false) OR regexp_matches(lower(concat_ws(' ', name, category, cuisine)), '\\bvegan\\b') THEN 'VEGAN' ELSE 'VEGETARIAN' END AS protein_class FROM cur LEFT JOIN c ON c.recipe_id = cur.id""",
        "resolve_names": f"""WITH c AS (SELECT DISTINCT name, {_canonical_sql('name')} AS c FROM edited_ingredient), d AS (SELECT name, {_singular_sql('c')} AS canonical FROM c)
SELECT d.name, coalesce(a.ingredient_id, i.id) AS ingredient_id, coalesce(a.ingredient_id, i.id) IS NULL AS is_new FROM d LEFT JOIN ingredient_alias a ON lower(a.raw_text) = lower(trim(d.name, ' ')) LEFT JOIN ingredient i ON i.canonical_name = d.canonical""",
        "form_rows": f"""WITH r AS (SELECT DISTINCT edit_id, recipe_id, row_no, name, unit FROM edited_ingredient)
SELECT recipe_id, (row_number() OVER (PARTITION BY recipe_id ORDER BY row_no, edit_id) - 1)::INTEGER AS row_no, name, unit FROM r""",
    }

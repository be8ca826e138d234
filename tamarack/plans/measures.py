"""Queries of problem 4: quantities recorded in different units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators.units import FRACTIONS, UNITS, WORDS, amount_milli, to_base_units
from tamarack.session import table


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = to_base_units(table(spark, sf_dir, "parsed_ingredient_line"), "line_id", "raw_text", "quantity", "unit")
    shopping = to_base_units(table(spark, sf_dir, "shopping_list_entry"), "entry_id", "raw_text", "quantity", "unit")
    return parsed.withColumn("record_kind", F.lit("parsed")).unionByName(shopping.withColumn("record_kind", F.lit("shopping")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record that states a mass or a volume."""
    return _amounts(spark, sf_dir).select("record_kind", "record_id", "base_unit", amount_milli(F.col("amount")).alias("amount_milli"))


def p4_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ingredient's shopping total in common units, whatever units the entries use."""
    entries = table(spark, sf_dir, "shopping_list_entry")
    amounts = to_base_units(entries, "entry_id", "raw_text", "quantity", "unit").select(F.col("record_id").alias("entry_id"), "base_unit", amount_milli(F.col("amount")).alias("milli"))
    owner = entries.groupBy("entry_id").agg(F.min("ingredient_id").alias("ingredient_id"))
    return owner.join(amounts, "entry_id").groupBy("ingredient_id", "base_unit").agg(F.count("*").alias("entries"), F.sum("milli").alias("total_milli"))


def queries() -> dict:
    return {"p4_found": p4_found, "p4_totals": p4_totals}


def _amounts_sql() -> str:
    """The rule in DuckDB's dialect: patterns without look-around, numbers as one CASE."""
    v = "".join(FRACTIONS)
    words = "|".join(sorted(WORDS, key=len, reverse=True))
    num = rf"(?:\d+ \d+/\d+|\d+/\d+|\d+ ?[{v}]|[{v}]|\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|\d+[.,]\d+|\d+|[.]\d+|(?:{words}) )"
    names = sorted((a for u in UNITS for a in u[3]), key=len, reverse=True)
    unit = "(?:" + "|".join(a.replace("(", r"\(").replace(")", r"\)").replace(" ", r"\.? ?") for a in names) + ")"
    start, end = r"(?:^|[^\w.,/])", r"(?:[^a-z(]|$)"
    pack = rf"{start}({num}) ?[x×*] ?({num}) ?-?({unit}){end}"
    bracket = rf"{start}({num}) ?[a-z]+(?:\((?:s|es)\))? ?[(\[] ?({num}) ?-?({unit}){end}"
    compound = rf"{start}({num}) ?(lbs?|pounds?)\.?,? ?(?:and |& ?)?({num}) ?(ozs?|ounces?)(?:[^a-z]|$)"
    simple = rf"{start}({num}) ?({unit}){end}"
    column = rf"^[x×*] ?({num}) ?({unit}){end}"

    def value(c: str) -> str:
        t = f"trim({c})"
        frac = " ".join(f"WHEN '{k}' THEN {x!r}::DOUBLE" for k, x in FRACTIONS.items())
        word = " ".join(f"WHEN '{k}' THEN {x!r}::DOUBLE" for k, x in WORDS.items())
        slash = f"regexp_extract({t}, '(\\d+)/\\d+$', 1)::DOUBLE / regexp_extract({t}, '/(\\d+)$', 1)::DOUBLE"
        head = f"coalesce(try_cast(nullif(regexp_extract({t}, '^(\\d+) ?(?:[{v}]|\\d+/\\d+)$', 1), '') AS DOUBLE), 0)"
        return (
            f"CASE WHEN regexp_matches({t}, '[{v}]$') THEN {head} + CASE right({t}, 1) {frac} END WHEN regexp_matches({t}, '\\d/\\d+$') THEN {head} + {slash} "
            f"WHEN regexp_matches({t}, '^\\d{{1,3}}(,\\d{{3}})+(\\.\\d+)?$') THEN replace({t}, ',', '')::DOUBLE WHEN regexp_matches({t}, '^[\\d.,]+$') THEN try_cast(replace({t}, ',', '.') AS DOUBLE) ELSE CASE {t} {word} END END"
        )

    def tidy(c: str) -> str:
        return f"trim(regexp_replace(lower({c}), '[\\s\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))"

    def key(c: str) -> str:
        return f"nullif(trim(regexp_replace(replace({c}, '.', ''), '(/ea| ?\\(level\\)| each)$', '')), '')"

    rows = " UNION ALL ".join(f"SELECT DISTINCT ON ({i}) '{k}' AS record_kind, {i} AS record_id, raw_text AS t, quantity AS q, unit AS u FROM {t}" for k, t, i in (("parsed", "parsed_ingredient_line", "line_id"), ("shopping", "shopping_list_entry", "entry_id")))
    alias = ", ".join(f"('{a}', '{base}', {factor!r}::DOUBLE)" for base, factor, _, aliases in UNITS for a in aliases)
    pick = lambda **g: "CASE kind " + " ".join(f"WHEN '{k}' THEN regexp_extract(t, '{p}', {g[k]})" for k, p in (("pack", pack), ("bracket", bracket), ("compound", compound), ("simple", simple)) if k in g) + " END"
    return f"""WITH r AS ({rows}), a AS (SELECT record_kind, record_id, q, {tidy('t')} AS t, {tidy('u')} AS u FROM r),
k AS (SELECT *, CASE WHEN regexp_matches(t, '{pack}') THEN 'pack' WHEN regexp_matches(t, '{bracket}') THEN 'bracket' WHEN regexp_matches(t, '{compound}') THEN 'compound' WHEN regexp_matches(t, '{simple}') THEN 'simple' END AS kind FROM a),
p AS (SELECT *, {pick(pack=1, bracket=1)} AS n1, {pick(pack=2, bracket=2, compound=1, simple=1)} AS n2, {pick(pack=3, bracket=3, compound=2, simple=2)} AS u1, {pick(compound=3)} AS n3, {pick(compound=4)} AS u2, regexp_extract(u, '{column}', 1) AS n4, regexp_extract(u, '{column}', 2) AS u4 FROM k),
v AS (SELECT *, {value('n1')} AS v1, {value('n2')} AS v2, {value('n3')} AS v3, {value('n4')} AS v4 FROM p),
f AS (SELECT record_kind, record_id, CASE WHEN v2 IS NOT NULL THEN coalesce(v1, 1) * v2 ELSE q * coalesce(v4, 1) END AS amount,
 CASE WHEN v2 IS NOT NULL THEN {key('u1')} WHEN v4 IS NOT NULL THEN {key('u4')} ELSE coalesce({key('u')}, {key(f"regexp_extract(t, '(?:^|[ ,:-])({unit}){end}', 1)")}) END AS alias, v3 AS more, {key('u2')} AS more_alias FROM v),
n(alias, base_unit, factor) AS (VALUES {alias})
SELECT record_kind, record_id, x.base_unit, floor((amount * x.factor + coalesce(more * y.factor, 0)) * 1000 + 0.5)::BIGINT AS amount_milli FROM f JOIN n x ON x.alias = f.alias LEFT JOIN n y ON y.alias = f.more_alias WHERE amount IS NOT NULL"""


def oracle_sql() -> dict[str, str]:
    found = _amounts_sql()
    owner = "SELECT entry_id, min(ingredient_id) AS ingredient_id FROM shopping_list_entry GROUP BY 1"
    totals = f"SELECT ingredient_id, base_unit, count(*) AS entries, sum(amount_milli)::BIGINT AS total_milli FROM ({found}) m JOIN ({owner}) o ON o.entry_id = m.record_id WHERE m.record_kind = 'shopping' GROUP BY 1, 2"
    return {"p4_found": found, "p4_totals": totals}

"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

from tamarack.llm.lookalike import TWINS

_ITEMS = "i AS (SELECT DISTINCT recipe_id AS r, unnest(ingredient_ids) AS x FROM recipe_ingredient_set)"
_PAIRS = f"""WITH {_ITEMS}, n AS (SELECT count(DISTINCT recipe_id) AS n FROM recipe_ingredient_set),
c AS (SELECT x, count(*) AS k FROM i GROUP BY x),
p AS (SELECT a.x AS item_a, b.x AS item_b, count(*) AS n_ab FROM i a JOIN i b ON a.r = b.r AND a.x < b.x GROUP BY 1, 2),
q AS (SELECT item_a, item_b, n_ab, ca.k AS n_a, cb.k AS n_b, n FROM p JOIN c ca ON ca.x = item_a JOIN c cb ON cb.x = item_b, n
      WHERE n_ab >= 6 AND 500 * n_ab >= n)"""
_SPACES = "".join(chr(c) for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000))
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
_GONE = r"[\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}]"
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def _look(text: str) -> str:
    out = f"regexp_replace({text}, '{_GONE}', '', 'g')"
    for a, b in _LIGATURES.items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"nfc_normalize(translate({out}, '{_SPACES + _FULL + ''.join(TWINS)}', '{' ' * len(_SPACES) + _HALF + ''.join(TWINS.values())}'))"


def _words(text: str) -> str:
    return f"regexp_extract_all({_look(f'lower({_look(text)})')}, '[\\p{{L}}\\p{{M}}\\p{{Nd}}]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"{_PAIRS} SELECT item_a AS ingredient_id_a, item_b AS ingredient_id_b FROM q WHERE n_ab * n >= 3 * n_a * n_b",
        "p1_excess": f"""{_PAIRS}, e AS (SELECT *, n_a::DOUBLE * n_b / n AS x, (n_ab + 0.5::DOUBLE) * (n - n_a - n_b + n_ab + 0.5::DOUBLE) / ((n_a - n_ab + 0.5::DOUBLE) * (n_b - n_ab + 0.5::DOUBLE)) AS o,
sqrt(1 / (n_ab + 0.5::DOUBLE) + 1 / (n_a - n_ab + 0.5::DOUBLE) + 1 / (n_b - n_ab + 0.5::DOUBLE) + 1 / (n - n_a - n_b + n_ab + 0.5::DOUBLE)) AS s FROM q)
SELECT item_a, item_b, n_ab, n_a, n_b, round(x, 6) AS expected, round(n_ab / x, 6) AS lift, round(o, 6) AS odds_ratio, round(ln(o), 6) AS log_odds, round(ln(o) - 1.96::DOUBLE * s, 6) AS log_odds_low FROM e""",
        "p2_found": f"""WITH {_ITEMS}, c AS (SELECT r, count(*) AS k FROM i GROUP BY r),
p AS (SELECT a.r AS ra, b.r AS rb, count(*) AS n FROM i a JOIN i b ON a.x = b.x AND a.r < b.r GROUP BY 1, 2 HAVING count(*) >= 6)
SELECT ra AS recipe_id_a, rb AS recipe_id_b FROM p JOIN c ca ON ca.r = ra JOIN c cb ON cb.r = rb WHERE 10 * n >= 7 * (ca.k + cb.k - n)""",
        "p2_links": f"""WITH {_ITEMS}, c AS (SELECT r, count(*) AS k, string_agg(x, ',' ORDER BY x) AS s FROM i GROUP BY r HAVING count(*) >= 6),
p AS (SELECT a.r AS ra, b.r AS rb, count(*) AS n FROM i a JOIN i b ON a.x = b.x AND a.r <> b.r GROUP BY 1, 2 HAVING count(*) >= 6),
l AS (SELECT ra, count(*) AS links FROM p JOIN c ca ON ca.r = ra JOIN c cb ON cb.r = rb WHERE 10 * n >= 7 * (ca.k + cb.k - n) AND ca.s <> cb.s GROUP BY 1)
SELECT * FROM (SELECT r AS recipe_id, count(*) OVER (PARTITION BY s) AS copies, coalesce(links, 0) AS links FROM c LEFT JOIN l ON l.ra = r) WHERE copies > 1 OR links > 0""",
        "p2_planned": f"""WITH {_ITEMS}, j AS (SELECT DISTINCT plan_id || ' ' || recipe_id AS r, ingredient_id AS x FROM shopping_list_entry),
c AS (SELECT r, count(*) AS k FROM i GROUP BY r), d AS (SELECT r, count(*) AS k FROM j GROUP BY r),
p AS (SELECT i.r AS ra, j.r AS rb, count(*) AS n FROM i JOIN j ON i.x = j.x GROUP BY 1, 2 HAVING count(*) >= 6)
SELECT ra AS recipe_id, rb AS basket, n::INTEGER AS common, (c.k + d.k - n)::INTEGER AS total FROM p JOIN c ON c.r = ra JOIN d ON d.r = rb WHERE 10 * n >= 7 * (c.k + d.k - n)""",
        # Every run of 13 words of the documents against every run of the items; the index and its thresholds have no part in it.
        "p6_found": f"""WITH d AS (SELECT doc_id, {_words('text')} AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
i AS (SELECT item_id, {_words('text')} AS w FROM (SELECT DISTINCT item_id, text FROM eval_item)),
g AS (SELECT doc_id, array_to_string(w[k:k + 12], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)),
h AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 12], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM g JOIN h USING (run)""",
        # Shortfalls do not depend on the tokenizer, so characters stand for tokens.
        "p7_found": r"""WITH d AS (SELECT DISTINCT doc_id, replace(lower(trim(source)), '-', '_') AS s, coalesce(length(text), 0) AS n FROM documents WHERE trim(coalesce(source, '')) <> ''),
t AS (SELECT sum(n) AS n FROM d), k AS (SELECT s, sum(n) AS n FROM d GROUP BY s)
SELECT m.source FROM mix_target m LEFT JOIN k ON k.s = m.source, t WHERE coalesce(k.n, 0) * m.max_repeats < m.target_share * t.n""",
        "p8_found": f"""WITH d AS (SELECT DISTINCT doc_id, text, {_look('text')} AS form FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM d a JOIN d b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text WHERE regexp_matches(a.form, '\\S')""",
    }

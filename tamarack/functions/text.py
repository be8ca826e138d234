"""Scalar functions on text: plain ``Column -> Column`` expressions that stay inside the JVM.

White space is Unicode white space throughout, as in the pages' own language, and rounding is
half up towards positive infinity. Null in gives null out unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(\d+(?:\.\d+)?)"
# White space of any alphabet, written so that Java and RE2 read it alike.
_SPACE = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
W, NW = f"[{_SPACE}]", f"[^{_SPACE}]"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, rf"^{W}+|{W}+\z", "")


def squeeze(c: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, f"{W}+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def round_half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5)).cast("int")


def first_number(c: Column) -> Column:
    """The first number in a text, as a double; null if there is none."""
    return F.regexp_extract(c, NUMBER, 1).try_cast("double")


def text_or_null(v: Column) -> Column:
    """A variant as trimmed text. Null, a numeric zero and blank text are null; the text "0" stays."""
    zero = F.schema_of_variant(v).isin("BIGINT", "DOUBLE", "DECIMAL(1,0)", "INT") & (F.try_variant_get(v, "$", "double") == 0)
    return F.when(~F.coalesce(zero, F.lit(False)), blank_to_null(F.try_variant_get(v, "$", "string")))


def number_or_null(c: Column) -> Column:
    """Text as a finite number; blank is 0, anything else that is not a number is null."""
    t = strip(c)
    n = F.when(t == "", F.lit(0.0)).when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    return F.when(F.abs(n) < float("inf"), n)


def form_number(c: Column) -> Column:
    """A form field as a number: blank or malformed is null, 0 stays."""
    return F.when(strip(c) != "", number_or_null(c))


def duration_minutes(c: Column) -> Column:
    """Minutes of an ISO 8601 duration of days, hours, minutes and seconds; null if it names none of them."""
    t = strip(c)
    shape = r"^P(?:(\d+)D)?T?(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?\z"
    parts = [F.regexp_extract(t, shape, i).try_cast("double") for i in (1, 2, 3, 4)]
    weights = (1440.0, 60.0, 1.0, 1 / 60)
    total = sum((F.coalesce(p, F.lit(0.0)) * w for p, w in zip(parts, weights, strict=True)), F.lit(0.0))
    return F.when(F.coalesce(*parts).isNotNull(), round_half_up(total))


def calories(c: Column) -> Column:
    return round_half_up(first_number(c))


def grams(c: Column) -> Column:
    return first_number(c)


def servings(c: Column) -> Column:
    """First number of a yield such as "Serves 2", rounded."""
    return round_half_up(first_number(c))


def title_parts(c: Column) -> Column:
    """struct(name, subtitle): split at the first free-standing "with", whose clause becomes the subtitle."""
    t = squeeze(c)
    shape = r"(?is)^(.*?)\swith\s(.+)\z"
    return F.struct(
        F.when(t.rlike(shape), strip(F.regexp_extract(t, shape, 1))).otherwise(t).alias("name"),
        F.when(t.rlike(shape), F.concat(F.lit("with "), strip(F.regexp_extract(t, shape, 2)))).alias("subtitle"),
    )


# Entities in the order in which they are decoded.
ENTITIES = [("&amp;", "&"), ("&#39;", "'"), ("&apos;", "'"), ("&quot;", '"'), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">")]


def html_text(c: Column) -> Column:
    """Plain text of an HTML fragment: a line for each paragraph or break, blank lines dropped."""
    t = F.regexp_replace(F.regexp_replace(c, r"(?i)</p>|<br\s*/?>", "\n"), r"<[^>]+>", "")
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    lines = F.filter(F.transform(F.split(t, "\n"), strip), lambda x: x != "")
    return F.array_join(lines, "\n")


def url_ids(c: Column) -> Column:
    """struct(ext_id, slug): last path segment, and the hexadecimal id that ends it, else the whole segment."""
    path = F.regexp_replace(F.regexp_replace(F.try_parse_url(c, F.lit("PATH")), "^/recipes/", ""), "/+$", "")
    slug = F.element_at(F.split(path, "/"), -1)
    found = F.regexp_extract(slug, r"(?i)-([0-9a-f]{16,})$", 1)
    return F.struct(F.when(found != "", found).otherwise(slug).alias("ext_id"), slug.alias("slug"))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def capitalize(c: Column) -> Column:
    """First letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def plain_number(c: Column) -> Column:
    """A number with at most two decimals and no trailing zeros."""
    hundredths = F.floor(c * 100 + F.lit(0.5)).cast("bigint")
    whole, part = F.floor(hundredths / 100).cast("bigint"), F.pmod(hundredths, F.lit(100))
    return F.concat(whole.cast("string"), F.when(part == 0, "").otherwise(F.concat(F.lit("."), F.regexp_replace(F.lpad(part.cast("string"), 2, "0"), "0$", ""))))


def leading_int(c: Column) -> Column:
    """The integer that a text begins with ("400abc" is 400), else null."""
    return F.regexp_extract(c, rf"^{W}*([+-]?\d+)", 1).try_cast("int")


def cache_key(url: Column) -> Column:
    """A file name for a URL: its path, other characters than letters, digits, dot, dash and underscore as underscore."""
    return F.regexp_replace(F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), "^/+", ""), "[^A-Za-z0-9._-]+", "_")


def safe_path(c: Column) -> Column:
    """Whether a relative path stays inside its folder."""
    return F.coalesce((c != "") & ~c.rlike(r"(^/)|(^|/)\.\.(/|$)|\\|\x00"), F.lit(False))


def usable_image(c: Column) -> Column:
    """Whether an image URL is there and names a file."""
    return F.coalesce((F.length(c) > 0) & ~F.endswith(c, F.lit("/")), F.lit(False))


def without_param(url: Column, name: str) -> Column:
    """The address without this query parameter; the others keep their order."""
    head = F.substring_index(url, "?", 1)
    rest = F.when(F.contains(url, F.lit("?")), F.substring(url, F.length(F.substring_index(url, "?", 1)) + 2, F.length(url)))
    kept = F.filter(F.split(rest, "&"), lambda p: F.substring_index(p, "=", 1) != name)
    return F.when(F.size(kept) > 0, F.concat(head, F.lit("?"), F.array_join(kept, "&"))).otherwise(head)


def redacted(url: Column) -> Column:
    """The address with the password before its host starred out."""
    return F.regexp_replace(url, ":[^:@]+@", ":***@")


def safe_segments(parts: Column) -> Column:
    """Whether path segments stay inside their root: there are some, and none holds "..", a slash or a backslash."""
    bad = F.exists(parts, lambda p: F.coalesce(F.contains(p, F.lit("..")) | F.contains(p, F.lit("/")) | F.contains(p, F.lit("\\")), F.lit(True)))
    return F.coalesce((F.size(F.filter(parts, lambda p: ~p.isin("", "."))) > 0) & ~bad, F.lit(False))

"""Visually identical text with different characters (problem 8).

Method: normalization quick check. One compiled character class holds every code point
that is not stable: those that a mapping changes, that Unicode's NFC quick check does not
pass, or that combine with what stands before them. Only runs of such characters, with the
one stable character before each run as boundary context, are normalised; the results are
spliced into the unchanged text. Text that is all ASCII passes the quick check as a whole.

What does not show and is brought to one form: width and presentation forms, composed and
decomposed accents, invisible characters, kinds of space (one for one), look-alike letters
of other alphabets (see ``ALPHABETS``). What shows and stays: case, accents, digits, fractions,
punctuation, line breaks, tabs and the number of spaces.

Defined results: null text gives a null form and no pair; blank text (nothing but white
space and invisible characters) gives no pair; texts are processed whole; repeated rows of
an id count once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.session import spread

# Look-alike letters of other alphabets and their Latin twins; first and last code point of the alphabet.
CYRILLIC = "АВЕЅІЈКМНОРСТУХԚԜаеѕіјорсухһԁԛԝѵӏӀү"
CYRILLIC_TWIN = "ABESIJKMHOPCTYXQWaesijopcyxhdqwvlIy"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹοϲϳν"
GREEK_TWIN = "ABEZHIKMNOPTYXCocjv"
ARMENIAN = "ՍՏՕհոսօ"
ARMENIAN_TWIN = "USOhnuo"
CHEROKEE = "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦᏴ"
CHEROKEE_TWIN = "DRTAJEWMHGZVSLCPKB"
LISU = "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
LISU_TWIN = "BPDTGKJCZFMNLSRVHWXYAEIOU"
ALPHABETS = [("Ѐ", "ԯ", CYRILLIC, CYRILLIC_TWIN), ("Ͱ", "Ͽ", GREEK, GREEK_TWIN), ("Ա", "֏", ARMENIAN, ARMENIAN_TWIN), ("Ꭰ", "ᏽ", CHEROKEE, CHEROKEE_TWIN), ("ꓐ", "꓿", LISU, LISU_TWIN)]
TWINS = {a: b for _, _, letters, twins in ALPHABETS for a, b in zip(letters, twins, strict=True)}

# Invisible characters (default ignorable code points), as ranges.
INVISIBLE = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF)]
FORMS = {"<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>"}
LIGATURES = range(0xFB00, 0xFB50)


_GONE = frozenset(cp for a, b in INVISIBLE for cp in range(a, b + 1))


def _one(ch: str) -> str:
    """What one code point becomes before composition."""
    if ord(ch) in _GONE:
        return ""
    if unicodedata.category(ch) == "Zs":
        return " "
    kind = unicodedata.decomposition(ch).partition(" ")[0]
    if kind in FORMS or ord(ch) in LIGATURES:
        ch = unicodedata.normalize("NFKC", ch)
    return "".join(TWINS.get(c, c) for c in unicodedata.normalize("NFD", ch))


@lru_cache(maxsize=1)
def _quick_check() -> tuple[tuple[re.Pattern, ...], dict[int, str]]:
    """The patterns of unstable runs (without and with astral code points), and the mapping of single code points."""
    # What the quick check answers with maybe: second parts of compositions, which may well not combine by class.
    pairs = (unicodedata.normalize("NFD", chr(cp)) for cp in range(0x80, 0x30000) if not 0xAC00 <= cp < 0xE000 and unicodedata.is_normalized("NFC", chr(cp)))
    maybe = {c for pair in pairs for c in pair[1:]}
    unstable, table = [], {}
    for cp in range(0x80, 0x30000):
        if 0xD800 <= cp < 0xE000 or 0xAC00 <= cp < 0xD7A4 or 0x3400 <= cp < 0xA000:
            continue  # surrogates; composed Hangul and ideographs are stable
        ch = chr(cp)
        one = _one(ch)
        if one != unicodedata.normalize("NFD", ch) or unicodedata.combining(ch) or ch in maybe or not unicodedata.is_normalized("NFC", ch) or 0x1160 < cp < 0x1200:
            unstable.append(cp)
            table[cp] = one
    for a, b in INVISIBLE:
        unstable += range(max(a, 0x30000), b + 1)
        table |= dict.fromkeys(range(max(a, 0x30000), b + 1), "")
    return tuple(re.compile(f"[{_ranges([cp for cp in unstable if low <= cp < high])}]+") for low, high in ((0, 0x10000), (0, 0x110000))), table


def _ranges(points: list[int]) -> str:
    """The body of a character class that holds these code points, in rising order."""
    runs: list[list[int]] = []
    for cp in points:
        if runs and runs[-1][1] == cp - 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs)


def look(text: str) -> str:
    """The one form that all texts which look like this one share."""
    if text.isascii():
        return text
    (plain, wide), table = _quick_check()
    # A class without astral code points is a bitmap, which is much faster.
    pattern = plain if max(text) < "\U00010000" else wide
    out, done = [], 0
    for m in pattern.finditer(text):
        start = max(m.start() - 1, done)  # the boundary context: a stable character may compose with what follows
        out += (text[done:start], unicodedata.normalize("NFC", text[start : m.end()].translate(table)))
        done = m.end()
    return "".join(out) + text[done:] if out else text


_WORD = re.compile(r"[^\W\d_]+")
# For each alphabet, Latin twins back to its letters; of several letters with one twin the first.
_BACK = [{latin: c for c, latin in reversed(list(zip(letters, twins, strict=True)))} for _, _, letters, twins in ALPHABETS]
LATIN = len(ALPHABETS)
_OWN = re.compile("|".join(f"([{first}-{last}])" for first, last, _, _ in ALPHABETS))
_TURN = [str.maketrans(b) for b in _BACK] + [{}]


@lru_cache(maxsize=1 << 16)
def _script(word: str) -> int:
    """The alphabet of a word of the shared form; -1 if look-alikes leave it open."""
    if m := _OWN.search(word):
        return m.lastindex - 1
    letters = set(word)
    return -1 if any(letters <= back.keys() for back in _BACK) else LATIN


def readable(form: str) -> str:
    """The shared form with every word in one alphabet, for output.

    A word with a letter that only one other alphabet has gets its look-alikes in that alphabet;
    a word of look-alikes only follows the other words of the text. It is a function of the
    shared form alone, so texts that look the same stay the same.
    """
    if not _OWN.search(form):
        return form  # every word is Latin, or follows Latin ones
    seen = [_script(w) for w in _WORD.findall(form)]
    usual = max((LATIN, *range(LATIN)), key=seen.count)

    def turned(m: re.Match) -> str:
        k = _script(m[0])
        if k < 0:  # a word that the usual alphabet cannot write as a whole stays Latin
            k = usual if usual != LATIN and set(m[0]) <= _BACK[usual].keys() else LATIN
        return m[0].translate(_TURN[k])

    return _WORD.sub(turned, form)


def _mapped(fn: Callable[[str], str]) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(lambda t: None if t is None else fn(t))

    return apply


def _unless_ascii(fn: Callable[[str], str], text: Column) -> Column:
    """Text that is all ASCII, as many bytes as characters, is not handed to Python."""
    return F.coalesce(_mapped(fn)(F.when(F.octet_length(text) != F.length(text), text)), text)


def look_form(text: Column) -> Column:
    """The shared form of a text column, for comparisons. Null stays null."""
    return _unless_ascii(look, text)


def clean_form(text: Column) -> Column:
    """The shared form with words in one alphabet, for output. Null stays null."""
    return _unless_ascii(lambda t: readable(look(t)), text)


def one_row_each(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): of several rows of a key the least value. Rows whose key stands once are not shuffled.

    A first pass over the keys alone marks those that repeat in a bitmap of 2^23 bits, at most 131,072
    rows of 64 bits, which is what is broadcast. A key that shares its bit with a repeated one only takes the longer way.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(1 << 23))
    word, place = F.shiftright(bit, 6), F.pmod(bit, F.lit(64)).cast("int")
    repeated = df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    marks = repeated.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), place)).alias("_marks"))
    rows = df.withColumns({"_word": word, "_place": place}).join(F.broadcast(marks), "_word", "left")
    several = F.coalesce(F.call_function("shiftright", F.col("_marks"), F.col("_place")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    rows = rows.select(key, value, several.alias("_several"))
    return rows.filter("not _several").select(key, value).unionByName(rows.filter("_several").groupBy(key).agg(F.min(value).alias(value)))


def one_form(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, clean_text, changed): one consistent text for each id.

    Of several rows of an id the least text counts. ``changed`` tells whether any code point differs.
    Texts are shuffled only if their id repeats, or to spread an input of few partitions.
    """
    rows = one_row_each(df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).filter("doc_id is not null"), "doc_id", "text")
    return rows.select("doc_id", "text", clean_form(F.col("text")).alias("clean_text")).select("doc_id", "clean_text", (~F.col("text").eqNullSafe(F.col("clean_text"))).alias("changed"))


def same_look(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, look_class, text_class): membership for every id whose text looks like another, different text.

    Texts are compared through 128-bit digests, so only digests are shuffled. Copies of one text
    are one ``text_class``. Counting distinct texts in a class aggregates on the map side.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = spread(rows).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_class"), look_form(F.col("text")).alias("form"))
    rows = rows.filter(F.col("form").rlike(r"\S")).select("doc_id", F.md5(F.col("form").cast("binary")).alias("look_class"), "text_class")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("look_class", "text_class")).alias("c")).select("doc_id", "c.look_class", "c.text_class")
    several = rows.groupBy("look_class").agg(F.min("text_class").alias("a"), F.max("text_class").alias("b")).filter("a <> b").select("look_class")
    return rows.join(several, "look_class", "left_semi").select("doc_id", "look_class", "text_class")


def same_look_pairs(members: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: all pairs of ids that look the same but differ.

    The join runs over distinct texts first, so a text with very many copies costs one row;
    copies meet only the documents of other texts, which are rows of the result.
    """
    texts = members.select("look_class", "text_class").distinct()
    other = texts.select("look_class", F.col("text_class").alias("other_class"))
    pairs = texts.join(other, "look_class").filter("text_class < other_class")
    left = members.select(F.col("doc_id").alias("a"), "look_class", "text_class")
    right = members.select(F.col("doc_id").alias("b"), "look_class", F.col("text_class").alias("other_class"))
    found = pairs.join(left, ["look_class", "text_class"]).join(right, ["look_class", "other_class"])
    return found.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()

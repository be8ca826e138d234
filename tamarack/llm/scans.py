"""Noise in text from scanned pages (problem 3).

Method: sequence labelling of lines with a hidden Markov model whose states are header (running
headers and page numbers), body and break (titles, headings, step numbers, "Serves n").
Observations are layout features of a line: its pattern, its place on the page, how its number
relates to the page number, whether it repeats the title. The model is trained on the corpus
itself: lines whose pattern is decisive give first counts, one round of Viterbi training over all
lines gives the final ones; all counts are distributed aggregates. Every line is then decoded: its pattern
is evidence that place and neighbours can outweigh (a lone number at the foot of a page is a page number, in
the middle a step number). Paragraphs are the body lines between two breaks, headers left out.

A word cut at a line end is joined with the first word of the next body line, on the next page
if need be. Misread characters are found with a lexicon of words: clean texts of the same
domain, and words of the running titles. A word that is not in it but becomes one of its words
when confusions are undone is a misread; so is a letter and digit mix and a stray mark. Beside the usual
confusions those count that the corpus itself shows for ``LEAST_SHOWN`` different words (``shown_confusions``).

What reaches the driver: model counts, confusions, the lexicon (every distinct clean word, checked against
``MOST_WORDS``) and the running titles (checked against ``MOST``).
All lines are sorted by kind, draft, page and line over the cluster and cut into blocks of ``BLOCK`` lines,
whatever drafts or pages they belong to, so no draft, page or missing number gathers in one task. A block sees
``CONTEXT`` lines on either side of it, and paragraphs are numbered over all blocks of a draft.

Defined results: null, empty and blank texts have no defect; a missing page or line number sorts
first; of repeated rows of an id the least text counts; empty tables give an empty result; other
columns are ignored; very long lines are processed whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.llm.canonical import CONTAINERS
from tamarack.operators.units import UNITS
from tamarack.session import by_key, materialize, numbered

BLOCK, CONTEXT = 4096, 128
LEAST_SHOWN = 8
MOST = 1_000_000
MOST_WORDS = 5_000_000
SHORT = 200  # letters of a line that is remembered
LONG_WORD = 40  # letters; in longer words one confusion is undone, not two
LEAST_TITLE = 4  # letters; fewer are left of page numbers and their misreads
STATES = ("header", "body", "break")
# Marks that cut a word at a line end; marks that scanning adds.
CUTS = "-\xad¬‐‑–"
STRAYS = "~¢»«|®@_°•^©*†¦"
ODD = "0123456789@¢†ƒ|!$€£_~»«®©°^*"
# What is read, and what may have been printed.
CONFUSED = {"0": "o", "1": "li", "|": "lit", "!": "lit", "5": "s", "@": "a", "¢": "c", "†": "t", "ƒ": "f", "9": "g", "8": "b", "7": "t", "6": "gb", "c": "eo", "b": "h", "$": "s", "€": "e", "£": "e", "3": "e", "4": "a", "2": "z", "l": "i", "i": "l", "f": "t", "]": "l", "[": "l", "h": "b", "u": "v", "v": "u", "e": "c", "o": "a", "t": "f", "q": "g", "g": "q", "y": "v", "n": "h"}
CONFUSED_TWO = {"ri": "n", "rn": "m", "ii": "u", "cl": "d", "vv": "w", "li": "h", "nn": "m", "in": "m", "iu": "m", "ni": "m", "lc": "k", "fi": "h", "tl": "d", "ti": "n", "il": "u", "li": "u"}
CONFUSED_WIDE = {"m": ["in", "rn", "nn", "ni"], "n": ["ri"], "d": ["cl"], "w": ["vv"], "u": ["ii"], "h": ["li"]}
_D = "0-9OoQlI|!SsBZzGg"
_PAGE = re.compile(rf"^(?:\[[{_D}]+/[{_D}]+\]|[-–—] ?[{_D}]+ ?[-–—]|[Pp]age [{_D}]+ of [{_D}]+|[Pp]\. ?[{_D}]+)$")
_LOOSE_PAGE = re.compile(r"^P\w{2,4} \S{1,4} [o0]\S \S{1,4}$")
_BARE = re.compile(rf"^(?:[0-9]{{1,3}}|[lI|!])[.]?$")
_NUMBERED = re.compile(r"^[0-9lI|]{1,2}[.)]? +[^a-z\s]")
_SERVES = re.compile(r"^\S{5,7} [0-9lI|OSo]{1,2}$")
_TOKEN = re.compile(r"\S+")
_EDGE = "".join(re.escape(c) for c in ".,;:()\"?“”[]")


_FOLDED = str.maketrans("01|!5@¢†ƒ987$", "olllsactfgbts")
_NO_LETTERS = re.compile(r"[^a-z]+")


def fold(text: str) -> str:
    """Letters only, with single-character confusions undone, for comparing titles."""
    return _NO_LETTERS.sub("", text.lower().translate(_FOLDED))


def _fold_column(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(text), "01|!5@¢†ƒ987$", "olllsactfgbts"), "[^a-z]+", "")


def _title_part(text: Column) -> Column:
    """A line without card and page numbers and the marks between."""
    t = F.regexp_replace(text, r" *[·—] *[Nn]o\. *\S+ *$", "")
    t = F.regexp_replace(t, r"^\S{1,3} *\| *| *\| *\S{1,3}$| +[·—] +\S{1,3}$| {2,}\S{1,3}$", "")
    return F.trim(t)


_CARD_NUMBER = re.compile(r" *[·—] *[Nn]o\. *\S+ *$")
_PAGE_NUMBER = re.compile(r"^\S{1,3} *\| *| *\| *\S{1,3}$| +[·—] +\S{1,3}$| {2,}\S{1,3}$")


def title_part(text: str) -> str:
    return _PAGE_NUMBER.sub("", _CARD_NUMBER.sub("", text)).strip()


@lru_cache(maxsize=1 << 16)
def _letter_set(text: str) -> int:
    out = 0
    for c in text:
        out |= 1 << (ord(c) - 97)
    return out


def _close(a: str, b: str) -> bool:
    """Whether two folded titles are the same but for a few misreads."""
    most = max(1, min(len(a), len(b)) // 7) + (len(a) >= 8)
    # An edit adds or takes away at most two letters of the set.
    if abs(len(a) - len(b)) > most or (_letter_set(a) ^ _letter_set(b)).bit_count() > 2 * most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


class Confusions:
    """What is read, and what may have been printed, one or two characters for one or two."""

    def __init__(self, shown: list[tuple[str, str]] = ()):
        pairs = dict.fromkeys([(r, p) for r, ps in CONFUSED.items() for p in ps])
        pairs |= dict.fromkeys(CONFUSED_TWO.items()) | dict.fromkeys((r, p) for r, ps in CONFUSED_WIDE.items() for p in ps)
        self.printed: dict[str, list[str]] = {}
        for r, p in dict.fromkeys([*pairs, *shown]):
            self.printed.setdefault(r, []).append(p)

    def undone(self, word: str) -> Iterator[str]:
        """All words that one undone confusion makes of this one."""
        for i in range(len(word)):
            for n in (1, 2):
                for p in self.printed.get(word[i : i + n], ()) if i + n <= len(word) else ():
                    yield word[:i] + p + word[i + n :]


USUAL = Confusions()


def shown_confusions(lines: DataFrame, words: set[str]) -> list[tuple[str, str]]:
    """(read, printed) that explain at least ``LEAST_SHOWN`` different unknown tokens, each of a word of five letters or more.

    Tokens and words that are the same but for one character, two for one or one for two, meet in a join on
    what they share; both are distinct and few beside the corpus. A token that several known words explain is left out,
    and so is a pair that is as common the other way round, as the letters of different words are.
    """
    spark = lines.sparkSession
    known = spark.createDataFrame([(w,) for w in sorted(words) if len(w) >= 5 and w.isalpha()], "w string")
    token = F.explode(F.split(F.lower("text"), r"[\s" + _EDGE.replace("\\[", "").replace("\\]", "") + r"\[\]]+"))
    tokens = lines.filter("text is not null").select(token.alias("w")).filter(F.length("w").between(5, 40)).distinct()
    unknown = tokens.join(known, "w", "left_anti")

    def keyed(df: DataFrame, name: str) -> DataFrame:
        place = F.sequence(F.lit(1), F.length("w"))

        def cut(n: int) -> Column:
            return F.transform(place, lambda i: F.struct(F.concat(F.substring("w", F.lit(1), i - 1), F.lit("\n"), F.substring("w", i + n, F.length("w"))).alias("rest"), F.substring("w", i, F.lit(n)).alias("c")))

        rows = df.select("w", F.explode(F.concat(cut(1), cut(2))).alias("p")).select(F.col("w").alias(name), F.col("p.rest").alias("rest"), F.col("p.c").alias(f"{name}_c"))
        return rows.distinct()

    met = keyed(unknown, "read").hint("merge").join(keyed(known, "printed").hint("merge"), "rest").filter("read_c <> printed_c and length(read_c) + length(printed_c) < 4")
    # The shortest pair that explains a token; those of one letter less on both sides only repeat it.
    met = met.groupBy("read").agg(F.count_distinct("printed").alias("n"), F.min(F.struct(F.length("read_c") + F.length("printed_c"), "read_c", "printed_c")).alias("p")).filter("n = 1")
    pairs = met.groupBy("p.read_c", "p.printed_c").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_SHOWN).limit(MOST + 1).collect()
    if len(pairs) > MOST:
        raise ValueError("too many confusions")
    times = {(r.read_c, r.printed_c): r.n for r in pairs}
    return sorted(k for k, n in times.items() if n > 2 * times.get(k[::-1], 0))


class Lexicon:
    """Known words, and what an unknown one was before it was misread."""

    def __init__(self, words: set[str], confusions: Confusions = USUAL):
        self.words, self.confusions, self.memory, self.texts = words, confusions, {}, {}

    def known(self, word: str) -> bool:
        """Known as a whole, or made of known parts joined by hyphens."""
        return word in self.words or ("-" in word and all(p in self.words for p in word.split("-") if p))

    def original(self, word: str) -> str | None:
        """The word as printed, if ``word`` is unknown and one or two undone confusions make a known one."""
        if word not in self.memory:
            if len(self.memory) > 200_000:
                self.memory.clear()
            self.memory[word] = self._original(word)
        return self.memory[word]

    def _original(self, word: str) -> str | None:
        unconfused = self.confusions.undone
        if self.known(word) or not word:
            return None
        if "-" in word.strip("-"):
            parts = [p if not p or self.known(p) else self.original(p) for p in word.split("-")]
            return "-".join(parts) if all(p is not None for p in parts) else None
        first = [w for w in dict.fromkeys(unconfused(word)) if w in self.words]
        if first:
            return first[0]
        odd = not word.isalpha()
        if (len(word) >= 5 or odd) and len(word) <= LONG_WORD:
            for w in dict.fromkeys(unconfused(word)):
                for v in unconfused(w):
                    if v in self.words and len(v) >= (3 if odd else 5):
                        return v
        return None


def _core(token: str) -> str:
    return token.strip(".,;:()\"?“”").lower()


def _number_like(core: str) -> bool:
    return bool(re.fullmatch(rf"[{_D}]+", core)) and any(c.isdigit() for c in core)


def _most_edits(length: int) -> int:
    """No two folded titles that are ``_close`` and one of which has this length are further apart."""
    return max(1, length // 7) + 1


def _remembered(memory: dict, key, make, most: int = 50_000):
    """``make()`` for this key, from memory if it is there; the memory is bounded."""
    if key not in memory:
        if len(memory) >= most:
            memory.clear()
        memory[key] = make()
    return memory[key]


class Titles:
    """Running titles of the corpus, compared with tolerance for misreads.

    Misread titles that stand on several pages are titles too, so their number grows with the corpus. A title is cut into one
    piece more than the edits that it may be apart from a text, so one piece stands in a close text unchanged, at most so many
    places off; a text is compared only with titles of which it has a piece.
    """

    def __init__(self, keys: list[str]):
        self.keys, self.memory, self.looks = sorted(keys), {}, {}
        self.exact = set(keys)
        self.pieces: dict[str, list[tuple[int, str]]] = {}
        for k in self.keys:
            n = min(_most_edits(len(k)) + 1, len(k))
            ends = [len(k) * i // n for i in range(n + 1)] if n else []
            for i, j in zip(ends, ends[1:], strict=False):
                self.pieces.setdefault(k[i:j], []).append((i, k))
        self.sizes = sorted({len(p) for p in self.pieces})
        self.lengths = {n for k in self.exact for n in range(len(k) - 4, len(k) + 5)}

    def has(self, text: str) -> bool:
        key = fold(title_part(text))
        if key in self.exact:
            return True
        if len(key) < LEAST_TITLE or len(key) not in self.lengths:
            return False
        return _remembered(self.memory, key, lambda: any(_close(key, k) for k in self._near(key)))

    def _near(self, key: str) -> Iterator[str]:
        """Titles of about this length of which the key has a piece where it may stand; all that are close are among them."""
        done = set()
        for size in self.sizes:
            for at in range(len(key) - size + 1):
                for start, k in self.pieces.get(key[at : at + size], ()):
                    if k not in done and abs(len(k) - len(key)) <= 4 and abs(start - at) <= _most_edits(len(k)):
                        done.add(k)
                        yield k


_STRAY_FIRST = re.compile(rf"^[{re.escape(STRAYS)}]+ +(?=\S)")
_STRAY_LAST = re.compile(rf"(?<=\S) +[{re.escape(STRAYS)}]+$")


def strip_strays(text: str) -> tuple[str, bool]:
    """The text without stray marks at its ends, and whether there were any."""
    t = text.strip()
    out = t
    while m := _STRAY_FIRST.match(out):
        out = out[m.end() :]
    while m := _STRAY_LAST.search(out):
        out = out[: m.start()]
    return out, out != t


def _look(t: str, titles: Titles, names: set[str]) -> tuple[str, bool]:
    """The pattern of a line without stray marks, and whether it numbers pages in a style of its own."""

    def name_like(part: str) -> bool:
        k = fold(part)
        return k in names or (len(k) > 6 and any(fold(w) in names for w in USUAL.undone(part.lower())))

    bare = title_part(t)
    words = re.split(r" [wWvV]\S{1,3}[hHbB] ", bare, maxsplit=1)
    two_names = len(words) == 2 and len(bare) < 90 and bare[:1].upper() == bare[:1] and name_like(words[0]) and name_like(words[1])
    if not t:
        p = "text"
    elif _PAGE.match(t) or _LOOSE_PAGE.match(t):
        p = "page"
    elif _BARE.match(t):
        p = "bare"
    elif titles.has(t):
        p = "series"
    elif " — " in t and len(t) < 100 and re.match(r"^\S{3,5} \S+ — ", t):
        p = "card"
    elif re.search(r" +· +\S{1,3}$| · [Nn]o\.", t):
        p = "title+number"
    elif two_names:
        p = "title" if bare == t else "title+number"
    elif _SERVES.match(t) and fold(t.split(" ")[0]) in ("serves", "servcs", "scrves", "scrvcs"):
        p = "serves"
    elif _NUMBERED.match(t) and len(t) < 40 and not t.endswith((".", ",")):
        p = "heading"
    elif len(t) < 40 and sum(c.isalpha() for c in t) > 3 and not any(c.islower() for c in re.sub(r"[a-z](?=[^a-z]|$)", "", t)) and sum(c.isupper() for c in t) > sum(c.islower() for c in t):
        p = "heading"
    else:
        p = "text"
    own = p == "page" or (p in ("series", "title+number") and bool(re.search(r"(?:^|[\s|·])\d{1,3}(?:\s*\||$)", t)) and " No" not in t)
    return p, own


def features(pdf: pd.DataFrame, titles: Titles, names: set[str], inside: bool) -> list[tuple[str, str, str, str]]:
    """(pattern, place, number, seed) of the lines of one block in reading order."""
    texts = [strip_strays(t or "")[0] for t in pdf["text"]]
    pages = pdf["page"].tolist()
    n = len(texts)
    first = [i == 0 or pages[i] != pages[i - 1] for i in range(n)]
    last = [i == n - 1 or pages[i] != pages[i + 1] for i in range(n)]
    looks = [_remembered(titles.looks, t, lambda: _look(t, titles, names)) if len(t) <= SHORT else _look(t, titles, names) for t in texts]
    patterns = [p for p, _ in looks]
    own_style = any(own for _, own in looks)
    seen: list[str] = []
    out = []
    for i, (t, p) in enumerate(zip(texts, patterns, strict=True)):
        place = "inside" if inside else "only" if first[i] and last[i] else "first" if first[i] else "last" if last[i] else "middle"
        number, seed = "none", ""
        if p == "title":
            key = fold(t)
            known = any(_close(key, s) for s in seen)
            again = known or inside or (i + 1 < n and patterns[i + 1] == "title" and _close(key, fold(texts[i + 1])))
            if not known:
                seen.append(key)
            late = place == "first" and pages[i] is not None and pages[i] > 1
            number, seed = ("again", "header") if again else ("late", "header") if late else ("new", "break")
        elif p in ("page", "series", "card", "title+number"):
            seed = "header"
            digits = re.findall(r"\d+", t)
            number = "equal" if pages[i] is not None and str(int(pages[i])) in digits else "other" if digits else "none"
        elif p == "bare":
            d = re.sub(r"\D", "", t.translate(str.maketrans("lI|!", "1111")))
            number = "equal" if pages[i] is not None and not inside and d == str(int(pages[i])) else "other"
            if own_style and not inside:
                number = "other"
            seed = "header" if inside else "break" if place == "middle" else ""
        elif p in ("heading", "serves"):
            seed = "" if inside else "break"
        elif t:
            seed = "body"
        out.append((p, place, number, seed))
    return out


def sign(pattern: str, place: str, number: str) -> str:
    """What a line looks like: its pattern, for titles and numbers how they stand to others, and for a lone number also its place."""
    return f"{pattern} {number} {place}" if pattern == "bare" else f"{pattern} {number}" if pattern == "title" else pattern


# What is known before any count, worth two lines each. A lone number at the edge of a page that is the page's own number is none of its text.
PRIOR = [("pattern", "header", f"bare equal {place}", 2) for place in ("first", "last", "only")] + [("place", "header", place, 2) for place in ("first", "last")]


class Model:
    """Transition and emission probabilities, from counts with ``PRIOR`` and a tenth of a line for every value."""

    def __init__(self, counts: list[tuple[str, str, str, int]]):
        values: dict[str, set[str]] = {}
        table: dict[tuple[str, str, str], int] = {}
        for factor, state, value, n in [*PRIOR, *counts]:
            values.setdefault(factor, set()).add(value)
            table[factor, state, value] = table.get((factor, state, value), 0) + n
        self.logs = {}
        for factor, vs in values.items():
            for s in STATES:
                total = sum(table.get((factor, s, v), 0) for v in vs)
                for v in vs:
                    self.logs[factor, s, v] = math.log((table.get((factor, s, v), 0) + 0.1) / (total + 0.1 * len(vs)))
        self.emissions, self.pages = {}, {}
        self.trans = np.array([[self.logs.get(("next", a, b), -3.0) for b in STATES] for a in STATES])

    def emission(self, pattern: str, place: str, number: str) -> np.ndarray:
        look = (pattern, place, number)
        return _remembered(self.emissions, look, lambda: np.array([self.logs.get(("pattern", s, sign(*look)), -12.0) + self.logs.get(("place", s, place), -8.0) for s in STATES]))

    def decode(self, lines: list[tuple[str, str, str]]) -> list[str]:
        """The most probable states of one page; pages that look the same are decoded once."""
        return _remembered(self.pages, tuple(lines), lambda: self._decode(lines), 5_000) if len(lines) <= 64 else self._decode(lines)

    def _decode(self, lines: list[tuple[str, str, str]]) -> list[str]:
        """Viterbi."""
        if not lines:
            return []
        score = self.emission(*lines[0])
        back = []
        for line in lines[1:]:
            step = score[:, None] + self.trans
            back.append(step.argmax(axis=0))
            score = step.max(axis=0) + self.emission(*line)
        k = int(score.argmax())
        path = [k]
        for b in reversed(back):
            k = int(b[k])
            path.append(k)
        return [STATES[k] for k in reversed(path)]


def scan_lines(ocr: DataFrame | None, steps: DataFrame | None) -> DataFrame:
    """(kind, record_id, draft, page, line, text): one row for each printed line of both tables."""
    parts = []
    if ocr is not None:
        rows = ocr.select(F.lit("ocr_line").alias("kind"), F.col("line_id").cast("bigint").alias("record_id"), F.coalesce("draft_id", F.lit("")).alias("draft"), F.col("page_no").cast("bigint").alias("page"), F.col("line_no").cast("bigint").alias("line"), "text")
        parts.append(rows.filter("record_id is not null").groupBy("kind", "record_id").agg(F.min(F.struct("text", "draft", "page", "line")).alias("r")).select("kind", "record_id", "r.draft", "r.page", "r.line", "r.text"))
    if steps is not None:
        rows = steps.select(F.col("step_id").cast("bigint").alias("record_id"), F.coalesce("draft_id", F.lit("")).alias("draft"), F.col("step_no").cast("bigint").alias("page"), "text").filter("record_id is not null")
        rows = rows.groupBy("record_id").agg(F.min(F.struct("text", "draft", "page")).alias("r")).select("record_id", "r.*")
        lines = rows.select(F.lit("card_step").alias("kind"), "record_id", "draft", "page", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("line", "text"))
        parts.append(lines.select("kind", "record_id", "draft", "page", F.col("line").cast("bigint").alias("line"), "text"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def running_titles(lines: DataFrame, names: set[str] = frozenset()) -> list[str]:
    """Folded texts that stand at the edges of several pages, of one draft or more, and hardly anywhere else.

    Pages are the evidence, so the own title of a single draft counts too; only one made of ``names``
    (folded) is left to ``features``, as it is also the title of the card where it stands first.
    """
    # Short keys, as of page numbers, are left out only after the edges are found.
    every_line = lines.filter("kind = 'ocr_line' and text is not null").withColumn("key", _fold_column(_title_part(F.col("text"))))
    ocr = every_line.filter(F.length("key") >= LEAST_TITLE)
    edge = every_line.groupBy("draft", "page").agg(F.min_by("key", "line").alias("a"), F.max_by("key", "line").alias("b"))
    edge = edge.select("draft", F.explode(F.array_distinct(F.array("a", "b"))).alias("key")).filter(F.length("key") >= LEAST_TITLE).groupBy("key").agg(F.count("*").alias("n_edge"), F.count_distinct("draft").alias("drafts")).filter("n_edge >= 3")
    every = ocr.join(edge.select("key"), "key", "left_semi").groupBy("key").agg(F.count_distinct("draft", "page").alias("n"))
    found = edge.join(every, "key").filter("n_edge >= 0.8 * n").select("key", "drafts").limit(MOST + 1).collect()
    if len(found) > MOST:
        raise ValueError("too many running titles to broadcast")

    def of_names(key: str) -> bool:
        left, _, right = key.partition("with")
        return bool(right) and (right in names or any(left[i:] in names for i in range(len(left))))

    return [r["key"] for r in found if r["drafts"] > 1 or not of_names(r["key"])]


def lexicon_words(clean: list[Column | DataFrame], lines: DataFrame, titles: list[str], most: int = MOST_WORDS) -> set[str]:
    """Words of the clean texts, and words of the running titles that are not misreads of others.

    ``clean`` are data frames of one text column. Every distinct word of them is kept, however rare.
    Raises ValueError if there are more than ``most``, rather than leave any out.
    """
    texts = None
    for df in clean:
        one = df.select(F.col(df.columns[0]).alias("text"))
        texts = one if texts is None else texts.unionByName(one)
    words: set[str] = {"serves", "page", "of", "card", "no", "p", "with"}

    def counted(df: DataFrame) -> DataFrame:
        token = F.explode(F.split(F.lower("text"), r"[\s" + _EDGE.replace("\\[", "").replace("\\]", "") + r"\[\]]+"))
        return df.filter("text is not null").select(token.alias("w")).filter(F.col("w").rlike(r"^[\p{L}][\p{L}'’-]*$")).groupBy("w").count()

    if texts is not None:
        found = counted(texts).select("w").limit(most + 1).collect()
        if len(found) > most:
            raise ValueError("too many clean words to broadcast")
        for r in found:
            words.add(r["w"])
            words.update(p for p in r["w"].split("-") if p)
    spark = lines.sparkSession
    keys = spark.createDataFrame([(k,) for k in titles], "key string")
    at_edge = lines.filter("kind = 'ocr_line'").withColumn("key", _fold_column(_title_part(F.col("text")))).join(F.broadcast(keys), "key", "left_semi")
    rows = counted(at_edge.select(_title_part(F.col("text")).alias("text"))).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many words of titles")
    own = {r["w"]: r["count"] for r in rows}
    for w, n in sorted(own.items(), key=lambda x: -x[1]):
        if not any(v in words or own.get(v, 0) > 4 * n for v in USUAL.undone(w)):
            words.add(w)
    return words


def _own_part(lead: str, part: str, rest: str, lexicon: Lexicon) -> str | None:
    """What this piece of a word cut at a line end was in print; None if the word is not known."""
    for join in ("", "-"):
        whole = join.join(p for p in (lead, part, rest) if p)
        if lexicon.known(whole) if join == "" else whole in lexicon.words:
            return part
    pieces = [[p] + ([o] if (o := lexicon.original(p)) else []) for p in (lead, part, rest) if p]
    at = 1 if lead else 0
    for first in pieces[0]:
        for second in pieces[1]:
            if "-".join([first, second]) in lexicon.words:
                return (first, second)[at]
    printed = lexicon.original(lead + part + rest)
    if printed is None:
        return None
    start = lead if printed.startswith(lead) else None
    end = rest if printed.endswith(rest) else None
    if start is not None and end is not None:
        return printed[len(start) : len(printed) - len(end)]
    # Another piece is damaged; this one is sound if the word has it in its place.
    return part if (printed.endswith(part) if lead and not rest else printed.startswith(part) if rest and not lead else part in printed) else None


def misreads(text: str, lexicon: Lexicon, head: str = "", tail: str = "", is_page: bool = False) -> tuple[bool, str]:
    """(whether something is misread, the corrected text). ``head`` and ``tail`` are the other halves of cut words at either end."""
    stripped, stray = strip_strays(text)
    bad, out = stray, []
    tokens = _TOKEN.findall(stripped)
    for i, token in enumerate(tokens):
        core = _core(token)
        fixed = token
        whole, lead, rest = core, "", ""
        if i == 0 and head:
            lead = _core(head).rstrip(CUTS)
            whole = lead + core
        if i == len(tokens) - 1 and tail:
            rest = _core(tail)
            whole = (whole[:-1] if whole[-1:] in CUTS else whole.rstrip(CUTS)) + rest
        part = core[:-1] if rest and core[-1:] in CUTS else core
        if not core or lexicon.known(whole) or whole.replace("'", "") in lexicon.words:
            pass
        elif re.fullmatch(r"[\d./,]+|[&·—|–-]+", core):
            # A lone bar is a separator only in running titles, and strays at the ends are gone.
            bad |= core == "|" and not is_page
        elif is_page and re.fullmatch(rf"[{_D}/-]+", core):
            bad |= not re.fullmatch(r"[\d/-]+", core)
        elif _number_like(core):
            bad = True
        elif lead or rest:
            mine = _own_part(lead, part, rest, lexicon)
            if mine is not None and mine != part:
                bad, fixed = True, token.lower().replace(part, mine)
            elif mine is None and any(c in ODD for c in part):
                bad = True
        elif (printed := lexicon.original(core)) is not None:
            bad, fixed = True, token.lower().replace(core, printed)
            if token.isupper():
                fixed = fixed.upper()
            elif token[:1].isupper() or (i and tokens[i - 1].endswith(".")):
                fixed = fixed[:1].upper() + fixed[1:]
        elif re.search(r"[a-z]", core) and any(c in ODD for c in core) and not re.fullmatch(r"\d+(?:g|kg|ml|l|cm|mm|p)?|\d+-\d+p?", core):
            bad = True
        elif core in STRAYS:
            bad = True
        out.append(fixed)
    return bad, " ".join(out)


def _defects(pdf: pd.DataFrame, labels: list[str], patterns: list[str], lexicon: Lexicon) -> list[tuple]:
    """Per line of one draft: furniture, hyphen, misread, paragraphs that begin with it, repaired text, whether it joins the next one."""
    texts = [t or "" for t in pdf["text"]]
    bare = [strip_strays(t)[0] for t in texts]
    kinds, records = pdf["kind"].tolist(), pdf["record_id"].tolist()
    body = [i for i, s in enumerate(labels) if s == "body" and bare[i]]
    following = {i: j for i, j in zip(body, body[1:], strict=False) if kinds[i] == "ocr_line" or records[i] == records[j]}
    head, tail, hyphen = {}, {}, set()
    joined = set()
    for i, j in following.items():
        last = _TOKEN.findall(bare[i])[-1]
        if len(last) < 2 or last[-1] not in CUTS or not last[-2].isalnum() and last[-2] not in STRAYS + "!":
            continue
        nxt = _TOKEN.findall(bare[j])[0]
        left, right = _core(last[:-1]), _core(nxt)
        tail[i], head[j] = nxt, last[:-1]
        whole, compound = left + right, left + "-" + right
        if lexicon.known(whole) or whole in lexicon.words:
            cut = True
        elif compound in lexicon.words or (left in lexicon.words and right in lexicon.words):
            cut = False
        elif lexicon.original(whole):
            cut = True
        elif "-" in left and lexicon.known(whole):
            cut = True
        else:
            own = lexicon.original(left) or left
            other = lexicon.original(right) or right
            cut = not (own in lexicon.words and other in lexicon.words and own + "-" + other in lexicon.words)
        if cut:
            hyphen.add(i)
        joined.add(i)
    out = []
    for i, t in enumerate(texts):
        step = int(labels[i] == "break") + int(i > 0 and labels[i - 1] == "break") + int(i > 0 and kinds[i] == "card_step" and records[i] != records[i - 1])
        page = patterns[i] in ("page", "bare", "series", "card", "title+number")
        if i in head or i in tail or len(t) > SHORT:
            bad, fixed = misreads(t, lexicon, head.get(i, ""), tail.get(i, ""), page)
        else:
            bad, fixed = _remembered(lexicon.texts, (t, page), lambda: misreads(t, lexicon, is_page=page))
        if i in joined:
            fixed = fixed[:-1] if i in hyphen else fixed
        out.append((labels[i] == "header" and bool(bare[i]), i in hyphen, bad and bool(t.strip()), step, fixed, i in joined))
    return out


def in_blocks(lines: DataFrame, size: int = BLOCK, context: int = CONTEXT) -> DataFrame:
    """Lines with ``seq``, their place in reading order over all drafts, once for each ``block`` of ``size`` lines that they are in or, with ``context`` set, near to."""
    # Range partitions share out a hot draft too, as the id is the last key.
    rows, total = numbered(lines, "kind", "draft", "page", "line", "record_id")

    def block(seq: Column) -> Column:
        return F.floor(seq / size).cast("bigint")

    near = F.array_distinct(F.array(*[block(F.col("seq") + d) for d in (0, -context, context)]))
    rows = rows.withColumn("block", F.explode(F.filter(near, lambda b: (b >= 0) & (b <= (max(total, 1) - 1) // size))))
    return rows.withColumn("context", F.col("block") != block(F.col("seq")))


def _by_block(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole blocks of a partition in which the rows of each block stand together."""
    rest = None
    for part in parts:
        if not len(part):
            continue
        part = part if rest is None else pd.concat([rest, part], ignore_index=True)
        block = part["block"].to_numpy()
        ends = [*np.flatnonzero(block[1:] != block[:-1]) + 1]
        for a, b in zip([0, *ends], ends, strict=False):
            yield part.iloc[a:b].reset_index(drop=True)
        rest = part.iloc[ends[-1] :].reset_index(drop=True) if ends else part
    if rest is not None:
        yield rest


def _runs(pdf: pd.DataFrame, *columns: str) -> Iterator[tuple[int, int]]:
    """Start and end of each run of rows that agree in these columns; missing values agree."""
    if len(pdf):
        change = np.zeros(len(pdf), bool)
        for c in columns:
            v = pdf[c]
            change |= ((v != v.shift()) & ~(v.isna() & v.shift().isna())).to_numpy()
        change[0] = True
        starts = np.flatnonzero(change)
        yield from zip(starts, [*starts[1:], len(pdf)], strict=True)


def _labels(pdf: pd.DataFrame, model: Model) -> list[str]:
    """The states of the lines of a block, page by page; each record of a card step is a page."""
    out: list[str] = []
    lines = list(zip(pdf["pattern"], pdf["place"], pdf["number"], strict=True))
    record = pdf["record_id"].where(pdf["kind"] == "card_step", 0)
    for a, b in _runs(pdf.assign(record=record), "kind", "draft", "page", "record"):
        out += model.decode(lines[a:b])
    return out


def _counts(rows: DataFrame) -> list[tuple[str, str, str, int]]:
    """(factor, state, value, n) of lines with ``state`` and the state ``before`` them on their page."""
    looks = F.when(F.col("pattern") == "bare", F.concat_ws(" ", "pattern", "number", "place")).when(F.col("pattern") == "title", F.concat_ws(" ", "pattern", "number")).otherwise(F.col("pattern"))
    three = [("pattern", F.col("state"), looks), ("place", F.col("state"), F.col("place")), ("next", F.col("before"), F.col("state"))]
    factor = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), s.alias("s"), v.alias("v")) for f, s, v in three]))
    counts = rows.select(factor.alias("x")).filter("x.s <> '' and x.v <> ''").groupBy("x").count().collect()
    return [(r.x.f, r.x.s, r.x.v, r["count"]) for r in counts]


def repair(ocr: DataFrame | None, steps: DataFrame | None, clean: list[DataFrame], names: DataFrame, block: int = BLOCK, context: int = CONTEXT) -> DataFrame:
    """(kind, record_id, draft, block, seq, page, line, pattern, seed, label, furniture, hyphen, misread, step, text, joins): every printed line.

    ``clean`` are data frames of one column of well-printed text of the same domain; ``names`` has one
    column with the names that titles are made of. ``step`` is how many paragraphs end before the line.
    """
    sc = (ocr if ocr is not None else steps).sparkSession.sparkContext
    lines = materialize(scan_lines(ocr, steps))
    name_rows = names.select(F.col(names.columns[0]).alias("n")).filter("n is not null").distinct().limit(MOST + 1).collect()
    if len(name_rows) > MOST:
        raise ValueError("too many names to broadcast")
    folded = {fold(r["n"]) for r in name_rows}
    titles = running_titles(lines, folded)
    words = lexicon_words([*clean, names], lines, titles)
    shared = sc.broadcast((titles, folded, words, shown_confusions(lines, words)))
    memory: dict = {}

    def tools() -> tuple[Titles, set[str], Lexicon]:
        if "tools" not in memory:
            t, n, w, c = shared.value
            memory["tools"] = (Titles(t), n, Lexicon(w, Confusions(c)))
        return memory["tools"]

    def observe(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable").reset_index(drop=True)
        t, n, _ = tools()
        found = [f for a, b in _runs(pdf, "kind", "draft") for f in features(pdf.iloc[a:b], t, n, pdf["kind"].iloc[a] == "card_step")]
        pdf["pattern"], pdf["place"], pdf["number"], pdf["seed"] = zip(*found, strict=True)
        same = np.zeros(len(pdf), bool)
        for a, b in _runs(pdf, "kind", "draft", "page"):
            same[a + 1 : b] = True
        pdf["before"] = np.where(same, pdf["seed"].shift().fillna(""), "")
        return pdf

    schema = "kind string, record_id bigint, draft string, page bigint, line bigint, text string, seq bigint, block bigint, context boolean, pattern string, place string, number string, seed string, before string"
    blocks = by_key(in_blocks(lines, block, context), "block").groupBy("block").applyInPandas(observe, schema)
    observed = materialize(blocks)
    first = Model(_counts(observed.filter("not context").withColumnRenamed("seed", "state")))

    def label(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _by_block(parts):
            states = pd.Series(_labels(pdf, first))
            before = np.array([""] * len(pdf), dtype=object)
            for a, b in _runs(pdf, "kind", "draft", "page"):
                before[a + 1 : b] = states[a : b - 1]
            yield pdf[["pattern", "place", "number"]].assign(state=states, before=before)[~pdf["context"]]

    model = Model(_counts(observed.mapInPandas(label, "pattern string, place string, number string, state string, before string")))
    kept = ["kind", "record_id", "draft", "block", "seq", "page", "line", "pattern", "seed"]

    def decide(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _by_block(parts):
            labels, patterns = _labels(pdf, model), pdf["pattern"].tolist()
            rows = [r for a, b in _runs(pdf, "kind", "draft") for r in _defects(pdf.iloc[a:b], labels[a:b], patterns[a:b], tools()[2])]
            out = pdf[kept].assign(label=labels)
            out["furniture"], out["hyphen"], out["misread"], out["step"], out["text"], out["joins"] = zip(*rows, strict=True)
            yield out[~pdf["context"]]

    out = "kind string, record_id bigint, draft string, block bigint, seq bigint, page bigint, line bigint, pattern string, seed string, label string, furniture boolean, hyphen boolean, misread boolean, step int, text string, joins boolean"
    return observed.drop("before").mapInPandas(decide, out)


def paragraphs(repaired: DataFrame) -> DataFrame:
    """(kind, draft, para, paragraph): body lines between breaks as one text, over all blocks and pages of a draft."""
    own = repaired.select("kind", "draft", "block", "seq", "step", "label", "text", "joins")
    own = own.withColumn("within", F.sum("step").over(Window.partitionBy("kind", "draft", "block").orderBy("seq")))
    # One row for each block of a draft.
    sums = own.groupBy("kind", "draft", "block").agg(F.sum("step").alias("steps"))
    sums = sums.withColumn("earlier", F.coalesce(F.sum("steps").over(Window.partitionBy("kind", "draft").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("steps")
    rows = own.join(sums, ["kind", "draft", "block"]).filter("label = 'body' and trim(text) <> ''").withColumn("para", F.col("earlier") + F.col("within"))
    pieces = F.array_sort(F.collect_list(F.struct("seq", F.concat("text", F.when(F.col("joins"), "").otherwise(" ")).alias("piece"))))
    return rows.groupBy("kind", "draft", "para").agg(F.trim(F.array_join(F.transform(pieces, lambda p: p["piece"]), "")).alias("paragraph"))


# ---- cells of ingredient tables -------------------------------------------------------------

_AMOUNT = r"(?:\d*[¼½¾⅓⅔⅛⅜⅝⅞]|\d+(?:[.,/]\d+)?(?![¼½¾⅓⅔⅛⅜⅝⅞]))"


def sound_units(candidates: list[tuple[str, int]], fixed: set[str]) -> set[str]:
    """Units that are not misreads of others, of (unit, evidence): the fixed ones, and from the best attested on those that no known one explains.

    A unit is explained if usual confusions undone make it a known one, if it is a known one behind
    misread digits ("2o g", "1OO grams", "5 s ml"), or if its first letter went to the number ("15achet").
    """
    known = set(fixed)
    for unit, _ in sorted(candidates, key=lambda c: (-c[1], c[0])):
        if unit in known:
            continue
        lexicon = Lexicon(known)
        rests = [unit[m.end() :] for n in range(1, 9) if (m := re.match(rf"(?:[oslizbg] ?){{{n}}}", unit))]
        ways = [unit, *filter(None, rests)]
        if not any(w in known or lexicon.original(w) is not None for w in ways) and not any(c + unit in known for c in "oslizbg"):
            known.add(unit)
    return known


def cells(quantities: DataFrame, least_drafts: int = 3) -> DataFrame:
    """(record_id, misread, clean): cells of the quantity column. A cell is sound if it is an amount and a known unit.

    Units are known from the unit tables, or because cells of at least ``least_drafts`` distinct drafts
    (cells, where no drafts are given) have them and ``sound_units`` finds no other unit behind them.
    The share of all cells does not count. Empty cells are sound. Raises ValueError if there are more
    than ``MOST`` candidates.
    """
    draft = F.coalesce(F.col("draft_id").cast("string"), F.lit("")) if "draft_id" in quantities.columns else F.col("cell_id").cast("string")
    rows = quantities.select(F.col("cell_id").cast("bigint").alias("record_id"), F.col("raw_text").alias("t"), draft.alias("d")).filter("record_id is not null")
    rows = rows.groupBy("record_id").agg(F.trim(F.min("t")).alias("t"), F.min_by("d", "t").alias("d"))
    unit = F.regexp_extract("t", rf"^{_AMOUNT} ?(\D.*)$", 1)
    rows = materialize(rows.withColumn("unit", F.lower(unit)))
    fixed = {a for u in UNITS for a in u[3]} | set(CONTAINERS)
    often = rows.filter((F.col("unit") != "") & F.col("unit").rlike(r"^[a-z][a-z ()]*$")).select("unit", "d").distinct().groupBy("unit").count().filter(F.col("count") >= least_drafts).limit(MOST + 1).collect()
    if len(often) > MOST:
        raise ValueError("too many units to broadcast")
    sound = sound_units([(r["unit"], r["count"]) for r in often], fixed)
    known = rows.sparkSession.createDataFrame([(u,) for u in sorted(sound)], "unit string").withColumn("ok", F.lit(True))
    out = rows.join(F.broadcast(known), "unit", "left")
    blank = F.coalesce("t", F.lit("")) == ""
    bare_number = F.col("t").rlike(rf"^{_AMOUNT}$")
    bad = ~blank & ~bare_number & ~F.coalesce("ok", F.lit(False))
    t = F.regexp_replace("t", r"^[~¢»|®@_°•e]+ *(?=[\d¼½¾IlOS])| *[~¢»|®@_°•]+$", "")
    split = r"^([0-9OoIl|!S]*?)(Y[ae24]|[¼½¾⅓⅔%])? *([a-z][a-z0-9() ]*|)$"
    amount = F.translate(F.regexp_extract(t, split, 1), "OoIl|!S", "0011115")
    half = F.when(F.regexp_extract(t, split, 2).rlike("^Y|%"), F.lit("½")).otherwise(F.regexp_extract(t, split, 2))
    word = F.translate(F.regexp_extract(t, split, 3), "015", "ols")
    clean = F.when(t.rlike(split), F.trim(F.concat(amount, half, F.lit(" "), word))).otherwise(t)
    return out.select("record_id", bad.alias("misread"), F.when(blank, F.lit("")).when(bad, clean).otherwise(F.regexp_replace("t", rf"^({_AMOUNT})(?=[a-z])", "$1 ")).alias("clean"))

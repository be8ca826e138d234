"""Mapping free-entered values to a canonical list (problem 5).

Method: the reference entries and their aliases stand in one trie, held as arrays; typed values are
searched with a Levenshtein automaton that runs along the trie. The automaton is the bit-parallel
non-deterministic one: one integer for each number of edits, whose bits are the positions in
the value that are alive; a branch of the trie is left as soon as no bit of the last integer
is set, or if all its entries are too short or too long. Transposed neighbours count as one edit.
Many values go down the trie together, one level at a time. ``within`` gives all entries within a distance that
depends on the value's length; a value means the nearest of them whose edits look like slips.

Before the search a value is brought to a few readings: amounts, packs, decorations, brand and
preparation remarks are taken off, inverted forms ("oil, olive"; "radish (island)") are put in
order, a plural ending is dropped. Every part of a value between marks is read, and pairs of parts
fewer than ``PAIR_REACH`` apart. Letters are compared without spaces, hyphens and accents, so
joined or split words cost nothing. The reading with the least distance wins.

Remarks are learned from the values themselves: words that stand before ``LEAST_NAMED`` or more different
entries, where the whole is no entry, say something about a thing and do not name it.

The reference list is small by nature; its size is checked against ``max_entries``. It is built
once and broadcast. Every distinct value is searched once; its answer is joined to its records, so a
hot value costs one search, and AQE splits its join.

Defined results: every distinct id gets one row; null, empty and blank values, and values that
are near nothing, are reported as ``none``; of repeated rows of an id the least value counts;
ties go to the longest entry, then to the one whose
spelling with spaces is nearest, then to the least id; an empty
reference list maps everything to ``none``; other columns are ignored. The automaton's
integers are as long as the value; values of more than 200 letters after cleaning cannot be
near an entry of usual length and are reported as ``none`` unless an entry is that long.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions.ingredients import UNIT_WORDS
from tamarack.llm.lookalike import look
from tamarack.operators.units import NUMBER, UNIT, UNITS
from tamarack.session import by_key, materialize

NONE = "none"
# Fixed value: parts of a name this far apart are not read as one name.
PAIR_REACH = 5
LEAST_NAMED = 5
MOST_REMARKS = 100_000
# Words that say in what or how a thing is sold, not what it is: the unit words of ingredient lines that are no measures.
_MEASURES = {a for u in UNITS for a in u[3]}
CONTAINERS = [*(w for w in UNIT_WORDS if w not in _MEASURES), "can(s)", "cans", "can", "cm", "mm"]
# Remarks of quality and size that may stand before a name.
REMARKS = ["extra", "fresh", "ripe", "large", "small", "medium", "good quality", "our own", "our", "own", "1st class", "approx", "organic quality"]

_CONTAINER = "|".join(re.escape(c) for c in sorted(CONTAINERS, key=len, reverse=True))
_MEASURE = rf"(?:(?:{UNIT})\.?|(?:{_CONTAINER})(?![a-z(]))"
_SIZE = rf"{NUMBER} ?-?(?:{UNIT})\.?"
_AMOUNT = re.compile(rf"(?<![\w.,/])(?:approx\.? ?)?{NUMBER}(?!(?:st|nd|rd|th)\b)(?: ?[x×*] ?{NUMBER})? ?(?:{_MEASURE})?(?: ?(?:{_CONTAINER})(?![a-z(]))?(?: ?[(\[] ?{_SIZE}(?: each)? ?[)\]])?(?: of(?: \d+)?(?![a-z]))?")
_BRACKET_SIZE = re.compile(rf"[(\[] ?{_SIZE}(?: each)? ?[)\]]")
_NUMBERED = re.compile(r"\(?\bno\. ?\d+\)?|\bfor \d+ ?- ?\d+ ?p\b")
_LONE = re.compile(rf"^\W*(?:(?:(?:and|of|x|×)(?![a-z(])|{_MEASURE})\W*)+(?=[a-z0-9])")
_FOR = re.compile(r"\bfor ?-?the\b.*|\bto serves?\b.*|\bas needed\b.*|\bplus extra\b.*|\bat room\b.*|\(?\b(?:optionals?|or ?similars?|see ?notes?)\b\)?")
_SEGMENT = re.compile(r"[,;:()\[\]•·~!*®™]+|(?<!\w)-+|-+(?!\w)|\?{2,}")
_WORDS = re.compile(r"[a-z0-9]+")


def letters(text: str) -> str:
    """Lower case, shared look-alike form, without accents."""
    text = unicodedata.normalize("NFD", look(text).casefold().replace("\t", " "))
    return unicodedata.normalize("NFC", "".join(c for c in text if not unicodedata.combining(c)))


def _near(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` edits, exchanges of neighbours included, lie between; for the short fixed remarks."""
    if abs(len(a) - len(b)) > most:
        return False
    last, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                new[-1] = min(new[-1], last[j - 2] + 1)
        last, row = row, new
    return row[-1] <= most


def remark_list(learned: list[str] = ()) -> list[tuple[int, tuple[str, ...]]]:
    """The fixed and the learned remarks as letters, by their number of words."""
    by_words: dict[int, list[str]] = {}
    for r in dict.fromkeys([*REMARKS, *sorted(learned)]):
        by_words.setdefault(r.count(" ") + 1, []).append(r.replace(" ", ""))
    return [(n, tuple(rs)) for n, rs in sorted(by_words.items())]


def _slips(length: int) -> int:
    """How many edits a mistyped remark may have."""
    return 0 if length < 6 else 2 if length > 9 else 1


@lru_cache(maxsize=1 << 17)
def _said(part: str, remarks: tuple[str, ...]) -> bool:
    """Whether these letters are one of the remarks, or a slip of one."""
    return any(_near(part, r, _slips(len(r))) for r in remarks)


def _bare(ws: list[str], remarks: list[tuple[int, tuple[str, ...]]]) -> list[str]:
    """Without remarks at either end; remarks may be mistyped too."""
    again = True
    while again and len(ws) > 1:
        again = False
        for n, said in remarks:
            if len(ws) > n:
                front = _said("".join(ws[:n]), said)
                if front or _said("".join(ws[-n:]), said):
                    ws, again = (ws[n:] if front else ws[:-n]), True
                    break
    return ws


def _singular(w: str) -> Iterator[str]:
    if len(w) > 3 and w.endswith("s"):
        yield w[:-1]
        if w.endswith("es"):
            yield w[:-2]
        if w.endswith("ies"):
            yield w[:-3] + "y"


def plain_words(value: str) -> list[str]:
    """Words of a value without amounts and marks."""
    return _WORDS.findall(_AMOUNT.sub(" ", letters(value).replace("’", "'").replace("'", "")))


def readings(value: str, remarks: list[tuple[int, tuple[str, ...]]], longest: int) -> list[str]:
    """The ways a typed value may be read, as letters without spaces, the likeliest first.

    A reading marked with = counts only as it is, one marked with - has lost a plural ending. ``longest`` is the length of the longest entry.
    """
    t = letters(value).replace("’", "'").replace("'", "")
    t = re.sub(r"\s+", " ", t.replace("_", " ").replace("/", "/")).strip()
    t = _BRACKET_SIZE.sub(" ", _NUMBERED.sub(" ", t))
    variants = [_AMOUNT.sub(" ", t).strip()]
    variants.append(_LONE.sub("", variants[0]))
    out: dict[str, None] = {}
    for v in dict.fromkeys(variants):
        v = _FOR.sub(" ", v)
        parts = [p for s in _SEGMENT.split(v) if (p := _bare([w for w in _WORDS.findall(s) if w not in ("of",)], remarks))]
        orders = [p for p in ([w for q in parts for w in q], *parts) if p]
        # All pairs of a usual value; of one with many parts each with its next ones, so that their number grows with the parts only.
        orders += [p + q for i, p in enumerate(parts) for j, q in enumerate(parts) if i != j and abs(i - j) < PAIR_REACH]
        for ws in orders:
            ws = _bare(ws, remarks)
            out.setdefault("".join(ws))
            for base in _singular("".join(ws)):
                out.setdefault("-" + base)
            joined = "".join(ws)
            for r in (r for _, said in remarks for r in said if joined.startswith(r)):  # a remark joined to the name
                if len(joined) > len(r) + 2:
                    out.setdefault("=" + joined[len(r) :])
            if len(ws) == 1 and len(parts) == 1:  # two words joined in the wrong order
                for w in (w for w in (ws[0], *_singular(ws[0])) if len(w) <= longest):
                    for i in range(3, len(w) - 2):
                        out.setdefault("=" + w[i:] + w[:i])
            if 1 < len(ws) <= 4:
                turned = [ws[-1], *ws[:-1]]
                out.setdefault("".join(turned))
                for w in _singular(ws[-1]):
                    out.setdefault("-" + w + "".join(ws[:-1]))
                if len(ws) > 2:
                    out.setdefault("".join([*ws[1:], ws[0]]))
    return [r for r in out if r]


def allowed(length: int) -> int:
    """The distance within which an entry counts as meant."""
    return 0 if length < 4 else 1 if length < 8 else 2 if length < 12 else 3


def _spread_out(value: str, entry: str) -> bool:
    """Whether the edits are spread whichever neighbour an extra letter is counted to."""
    return _spread(value, entry, 0) and _spread(value, entry, 1)


def _spread(value: str, entry: str, lean: int) -> bool:
    """Whether no single word of the entry bears more edits than its length allows: 1, from 5 letters 2, from 9 letters 3.

    A different word in a familiar phrase has all its edits in one place; slips of the pen are spread.
    """
    key = entry.replace(" ", "")
    table = [list(range(len(key) + 1))]
    for i, x in enumerate(value, 1):
        row = [i]
        for j, y in enumerate(key, 1):
            best = min(table[-1][j] + 1, row[-1] + 1, table[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == key[j - 2] and value[i - 2] == y:
                best = min(best, table[-2][j - 2] + 1)
            row.append(best)
        table.append(row)
    edits, i, j = [0] * len(key), len(value), len(key)
    while i or j:
        d = table[i][j]
        if i and j and d == table[i - 1][j - 1] + (value[i - 1] != key[j - 1]):
            edits[j - 1] += value[i - 1] != key[j - 1]
            i, j = i - 1, j - 1
        elif i > 1 and j > 1 and value[i - 1] == key[j - 2] and value[i - 2] == key[j - 1] and d == table[i - 2][j - 2] + 1:
            edits[j - 1] += 1
            i, j = i - 2, j - 2
        elif j and d == table[i][j - 1] + 1:
            edits[j - 1] += 1
            j -= 1
        else:
            edits[max(0, min(j - lean, len(key) - 1))] += 1
            i -= 1
    at = 0
    for w in entry.split(" "):
        if sum(edits[at : at + len(w)]) > (1 if len(w) < 5 else 2 if len(w) < 9 else 3):
            return False
        at += len(w)
    return True


class Trie:
    """Reference entries by their letters, as arrays: nodes in order of depth, the children of a node side by side."""

    LONGEST = 62  # letters of a value whose positions fit one machine integer; longer ones are searched by themselves

    def __init__(self, entries: list[tuple[str, str]]):
        self.exact: dict[str, list[tuple[str, str]]] = {}
        for ident, text in sorted(entries):
            words = _WORDS.findall(letters(text))
            if words:
                self.exact.setdefault("".join(words), []).append((ident, " ".join(words)))
        self.keys = sorted(self.exact)
        self.alphabet = {c: k for k, c in enumerate(sorted({c for key in self.keys for c in key}))}
        self.longest = max(map(len, self.keys), default=0)
        # A node is a range of sorted keys with a common prefix.
        low, high, char, starts, ends, key = [0], [len(self.keys)], [-1], [], [], []
        depth, level = 0, [0]
        while level:
            following = []
            for node in level:
                at = low[node]
                key.append(at if at < high[node] and len(self.keys[at]) == depth else -1)
                at += key[-1] >= 0
                starts.append(len(low))
                while at < high[node]:
                    c, end = self.keys[at][depth], at
                    while end < high[node] and self.keys[end][depth] == c:
                        end += 1
                    following.append(len(low))
                    low.append(at)
                    high.append(end)
                    char.append(self.alphabet[c])
                    at = end
                ends.append(len(low))
            depth, level = depth + 1, following
        self.char, self.key = np.array(char, np.int32), np.array(key, np.int32)
        self.starts, self.ends = np.array(starts, np.int32), np.array(ends, np.int32)
        lengths = np.array([len(k) for k in self.keys] or [0], np.int32)
        self.shortest = np.array([lengths[a:b].min() if a < b else 0 for a, b in zip(low, high, strict=True)], np.int32)
        self.most = np.array([lengths[a:b].max() if a < b else 0 for a, b in zip(low, high, strict=True)], np.int32)

    def within(self, values: list[str], k: int) -> list[list[tuple[int, str]]]:
        """For each value (distance, entry letters) of all entries within ``k`` edits."""
        out: list[list[tuple[int, str]]] = [[] for _ in values]
        short = []
        for n, v in enumerate(values):
            if k == 0:
                out[n] = [(0, v)] if v in self.exact else []
            elif len(v) <= min(self.LONGEST, self.longest + k):
                short.append(n)
            elif len(v) <= self.longest + k:
                out[n] = [(d, key) for key in self.keys if abs(len(key) - len(v)) <= k and (d := _edits(v, key)) <= k]
        at_once = (4096, 1024, 256)[min(k, 3) - 1] if k else 1
        for i in range(0, len(short), at_once):
            some = short[i : i + at_once]
            for n, key, d in zip(*self._descend([values[n] for n in some], k), strict=True):
                out[some[n]].append((int(d), self.keys[key]))
        return out

    def _descend(self, values: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(value, key, distance): all values go down the trie together. Bit i of a row of j edits: i letters are read with j edits."""
        one = np.uint64(1)
        length = np.array([len(v) for v in values], np.int32)
        masks = np.zeros((len(values), len(self.alphabet)), np.uint64)
        for n, v in enumerate(values):
            for i, c in enumerate(v):
                if (a := self.alphabet.get(c)) is not None:
                    masks[n, a] |= np.uint64(1 << i + 1)
        end = np.left_shift(one, length.astype(np.uint64))
        inside = (end << one) - one
        value, node = np.arange(len(values)), np.zeros(len(values), np.int32)
        rows = [np.full(len(values), (1 << j + 1) - 1, np.uint64) for j in range(k + 1)]
        before, last, found = None, None, []
        while len(node):
            # Every child of every node that is still alive and has entries of a length in reach.
            n = self.ends[node] - self.starts[node]
            parent = np.repeat(np.arange(len(node)), n)
            child = np.arange(len(parent)) - np.repeat(np.cumsum(n) - n, n) + self.starts[node][parent]
            who = value[parent]
            fits = (self.shortest[child] <= length[who] + k) & (self.most[child] >= length[who] - k)
            parent, child, who = parent[fits], child[fits], who[fits]
            mask = masks[who, self.char[child]]
            old = [r[parent] for r in rows]
            new = [(old[0] << one) & mask]
            for j in range(1, k + 1):
                bits = ((old[j] << one) & mask) | old[j - 1] | (old[j - 1] << one) | (new[j - 1] << one)
                if before is not None:
                    # Two letters exchanged: the entry's last two in the value's order.
                    bits |= (((before[j - 1][parent] << one) & mask) << one) & last[parent]
                new.append(bits)
            alive = (new[k] & inside[who]) != 0
            here = np.flatnonzero(alive & (self.key[child] >= 0))
            distance = np.full(len(here), k + 1)
            for j in range(k, -1, -1):
                distance[(new[j][here] & end[who[here]]) != 0] = j
            hit = distance <= k
            found.append((who[here][hit], self.key[child[here]][hit], distance[hit]))
            before, last = [r[alive] for r in old], mask[alive]
            value, node, rows = who[alive], child[alive], [r[alive] for r in new]
        return tuple(np.concatenate([f[i] for f in found]) if found else np.empty(0, int) for i in range(3))


def _edits(a: str, b: str) -> int:
    """Edits between two long values, exchanges of neighbours included."""
    last, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                new[-1] = min(new[-1], last[j - 2] + 1)
        last, row = row, new
    return row[-1]


class Resolver:
    """What typed values mean, many at a time."""

    def __init__(self, trie: Trie, learned: list[str] = ()):
        self.trie, self.remarks = trie, remark_list(learned)

    def matches(self, values: list[str]) -> list[list[tuple[int, str, str]]]:
        """For each value (distance, entry id, entry) of the nearest entries within the allowed distance of a reading, the likeliest first."""
        out: list[list] = [[] for _ in values]
        # A guess marked = holds only if it is exact; a dropped plural ending, marked -, uses up one edit of more than one.
        ways = [[(w.lstrip("=-"), w[0] if w[0] in "=-" else "") for w in readings(v, self.remarks, self.trie.longest)] for v in values]
        open_ones = list(range(len(values)))
        for k in range(4):
            asked = {n: [w for w, mark in ways[n] if k <= _most(w, mark)] for n in open_ones}
            texts = list(dict.fromkeys(w for ws in asked.values() for w in ws))
            near = dict(zip(texts, self.trie.within(texts, k), strict=True))
            for n, ws in asked.items():
                best: dict[str, int] = {}
                for w in ws:
                    for d, key in near[w]:
                        if d < best.get(key, 9) and (d < 2 or _spread_out(w, self.trie.exact[key][0][1])):
                            best[key] = d
                out[n] = sorted(((d, ident, text) for key, d in best.items() for ident, text in self.trie.exact[key]), key=lambda f: (f[0], -len(f[2]), f[1]))
            open_ones = [n for n in open_ones if not out[n]]
        return out

    def resolve(self, values: list[str | None]) -> list[tuple[str, int]]:
        """For each value (entry id or none, distance)."""
        some = [n for n, v in enumerate(values) if v and v.strip()]
        out = [(NONE, -1)] * len(values)
        for n, found in zip(some, self.matches([values[n] for n in some]), strict=True):
            if found:
                first = [f for f in found if f[0] == found[0][0] and len(f[2]) == len(found[0][2])]
                if len(first) > 1:
                    plain = " ".join(_WORDS.findall(letters(values[n])))
                    first.sort(key=lambda f: (_distance(plain, f[2]), f[1]))
                out[n] = first[0][1], first[0][0]
        return out

    def in_reach(self, values: list[str | None]) -> list[list[tuple[str, int]]]:
        """For each value (entry id, least distance) of all entries within the allowed distance of any of its readings, nearest first."""
        ways = [[(w, most) for r in readings(v, self.remarks, self.trie.longest) if (most := _most(w := r.lstrip("=-"), r[0] if r[0] in "=-" else "")) >= 0] if v and v.strip() else [] for v in values]
        near = {}
        for k in range(4):
            texts = list(dict.fromkeys(w for ws in ways for w, most in ws if most == k))
            near |= {(w, k): f for w, f in zip(texts, self.trie.within(texts, k), strict=True)}
        out = []
        for ws in ways:
            best: dict[str, int] = {}
            for way in ws:
                for d, key in near[way]:
                    for ident, _ in self.trie.exact[key]:
                        best[ident] = min(d, best.get(ident, 9))
            out.append(sorted(best.items(), key=lambda e: (e[1], e[0])))
        return out


def _most(letters_: str, mark: str) -> int:
    """The distance allowed to a reading with this mark."""
    most = allowed(len(letters_))
    return 0 if mark == "=" else most - 1 if mark and most > 1 else most


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def learn_remarks(values: DataFrame, known) -> list[str]:
    """Words of up to three that stand before ``LEAST_NAMED`` or more different entries; ``known`` is a broadcast of the entries' letters.

    Raises ValueError beyond ``MOST_REMARKS`` of them.
    """
    measures = {w for a in (*_MEASURES, *CONTAINERS) for w in a.split()} | {"and", "of", "x", "no"}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = set()
            for v in part["value"]:
                ws = plain_words(v)
                if len(ws) > 1 and "".join(ws) not in known.value:
                    for n in range(1, min(4, len(ws))):
                        if (rest := "".join(ws[n:])) in known.value and len("".join(ws[:n])) > 3 and not measures.issuperset(ws[:n]):
                            rows.add((" ".join(ws[:n]), rest))
            yield pd.DataFrame(sorted(rows), columns=["remark", "entry"])

    found = values.filter("value is not null").mapInPandas(run, "remark string, entry string").distinct().groupBy("remark").count().filter(F.col("count") >= LEAST_NAMED)
    rows = found.limit(MOST_REMARKS + 1).collect()
    if len(rows) > MOST_REMARKS:
        raise ValueError(f"more than {MOST_REMARKS} remarks before names")
    # A slip of a commoner remark is known as such, and of several remarks in a row each is taken off by itself.
    kept: dict[str, str] = {r: r.replace(" ", "") for r in REMARKS}

    def made_of_kept(ws: list[str]) -> bool:
        return not ws or any((" ".join(ws[:n]) in kept or (n == 1 and ws[0] in measures)) and made_of_kept(ws[n:]) for n in range(1, len(ws) + 1))

    for r in sorted(rows, key=lambda r: (-r["count"], r["remark"])):
        joined = r["remark"].replace(" ", "")
        if not made_of_kept(r["remark"].split(" ")) and not any(_near(joined, k, _slips(len(k))) for k in kept.values()):
            kept[r["remark"]] = joined
    return sorted(kept.keys() - set(REMARKS))


def map_to_list(df: DataFrame, id_col: str, value_col: str, reference: DataFrame, aliases: DataFrame | None = None, reference_id: str = "id", reference_text: str = "canonical_name", alias_id: str = "ingredient_id", alias_text: str = "raw_text", max_entries: int = 2_000_000, every: bool = False) -> DataFrame:
    """(record_id, entry_id, distance): the meant entry of each value, or ``none`` with distance -1.

    With ``every`` also ``in_reach``, an array of (entry_id, distance) of all entries within the allowed distance.
    Ids keep their type. Raises ValueError if reference list and aliases have more than ``max_entries`` rows.
    """
    entries = reference.select(F.col(f"`{reference_id}`").cast("string").alias("i"), F.col(f"`{reference_text}`").alias("t"))
    if aliases is not None:
        entries = entries.unionByName(aliases.select(F.col(f"`{alias_id}`").cast("string").alias("i"), F.col(f"`{alias_text}`").alias("t")))
    entries = entries.filter("i is not null and t is not null").distinct()
    found = entries.limit(max_entries + 1).collect()
    if len(found) > max_entries:
        raise ValueError(f"the reference list has more than {max_entries} entries")
    sc = df.sparkSession.sparkContext
    built = Trie([(r.i, r.t) for r in found])
    trie, known = sc.broadcast(built), sc.broadcast(frozenset(built.exact))
    rows = df.select(F.col(f"`{id_col}`").alias("record_id"), F.col(f"`{value_col}`").cast("string").alias("value")).filter("record_id is not null")
    rows = materialize(rows.groupBy("record_id").agg(F.min("value").alias("value")))
    values = materialize(by_key(rows.select("value").distinct(), "value"))
    learned = learn_remarks(values, known)

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        resolver = Resolver(trie.value, learned)
        for part in parts:
            texts = part["value"].tolist()
            out = pd.DataFrame(resolver.resolve(texts), columns=["entry_id", "distance"])
            if every:
                out["in_reach"] = [[{"entry_id": i, "distance": d} for i, d in e] for e in resolver.in_reach(texts)]
            yield out.assign(value=texts)

    more = ", in_reach array<struct<entry_id: string, distance: int>>" if every else ""
    answers = values.mapInPandas(search, f"value string, entry_id string, distance int{more}")
    # Null values have an answer too.
    out = rows.join(answers.withColumnRenamed("value", "_value"), F.col("value").eqNullSafe(F.col("_value")))
    return out.select("record_id", "entry_id", "distance", *(["in_reach"] if every else []))

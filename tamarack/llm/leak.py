"""Evaluation texts leaking into training text (problem 6).

Method: BM25 inverted index of the test items, searched with block-max WAND, then an exact
check. Every document is cut into passages of ``2 n - 1`` words, one every ``n`` words, so
each run of ``n`` words lies whole in one passage. Every passage is a query. The index has a posting
list for each word, in blocks of ``BLOCK`` postings with their greatest impact. The cursors of a
passage's words are kept in order of their items; the pivot is the first item that the greatest
impacts of the words up to there can lift over the threshold. If the block maxima cannot, all items
up to the end of the nearest block are skipped, else the pivot is scored.

The threshold loses nothing: an item's threshold is the least score of any of its own runs of
``n`` words, and impacts are never negative, so a passage that holds such a run scores at
least as much. Impacts are divided by their item's threshold, so that one threshold, 1, holds for
all lists and blocks. What passes is verified word by word.

Long items stand in the index as pieces of ``PIECE`` words that overlap by ``n - 1``. An item set of more
than ``max_index_words`` words is indexed in parts of about that size, each built, broadcast and
searched on its own with document frequencies of the whole set, so results and scores do not depend
on the number of parts. Corpus documents are never gathered: a search is one pass over the corpus without a shuffle.

Defined results: null, blank and short texts give nothing; an item with fewer than ``n``
words cannot be found; repeated rows of an id count once; an empty table on either side gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.lookalike import look
from tamarack.session import materialize, spread

RUN = 13
BLOCK = 64
PIECE = 512
K1, B = 1.2, 0.75
_WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, in the consistent form and without case."""
    return [] if not text else _WORD.findall(look(look(text).casefold()))


def pieces(ws: list[str], run: int, size: int = PIECE) -> list[list[str]]:
    """An item's words in pieces that hold each of its runs; none if it is shorter than a run."""
    step = size - run + 1
    return [ws[i : i + size] for i in range(0, max(1, len(ws) - run + 1), step)] if len(ws) >= run else []


class Index:
    """Posting lists over pieces of items, in rising order of the piece, with block maxima; impacts are shares of the piece's threshold.

    ``df`` has the number of pieces with each word, ``n`` and ``mean`` number and mean length of all pieces.
    """

    def __init__(self, entries: list[tuple[int, list[str]]], df: dict[str, int], n: int, mean: float, run: int = RUN, block: int = BLOCK):
        self.run, self.block, self.ids = run, block, [i for i, _ in entries]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in entries for w in ws}))}
        lists: list[list[tuple[int, float]]] = [[] for _ in self.vocabulary]
        self.threshold, self.text = [], []
        for k, (_, ws) in enumerate(entries):
            impact = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ws) / mean)) for w, tf in Counter(ws).items()}
            total = np.concatenate([[0.0], np.cumsum([impact[w] for w in ws])])
            threshold = float((total[run:] - total[:-run]).min())
            self.threshold.append(threshold)
            self.text.append(np.array([self.vocabulary[w] for w in ws], np.int32).tobytes())
            for w, x in impact.items():
                lists[self.vocabulary[w]].append((k, x / threshold))
        self.docs, self.impacts, self.starts = array("i"), array("d"), array("q", [0])
        self.block_max, self.block_starts = array("d"), array("q", [0])
        for postings in lists:
            self.docs.extend(k for k, _ in postings)
            self.impacts.extend(x for _, x in postings)
            self.block_max.extend(max(x for _, x in postings[j : j + block]) for j in range(0, len(postings), block))
            self.starts.append(len(self.docs))
            self.block_starts.append(len(self.block_max))
        # The greatest impact of each word; the last one is of words that no item has.
        self.most = np.array([max(self.block_max[a:b]) for a, b in zip(self.block_starts, self.block_starts[1:], strict=False)] + [0.0])

    def wand(self, terms: Counter, least: float = 1 - 1e-9) -> Iterator[tuple[int, float]]:
        """(piece, score as a share of its threshold) of all pieces that reach the threshold, by block-max WAND."""
        docs, impacts, starts, block_max, size = self.docs, self.impacts, self.starts, self.block_max, self.block
        # A cursor: item it stands at, place in the postings, their start and end, times in the passage, greatest impact, first block.
        cursors = [[docs[starts[t]], starts[t], starts[t], starts[t + 1], m, m * float(self.most[t]), self.block_starts[t]] for t, m in terms.items()]

        def advance(some: list[list], to: int) -> None:
            for c in some:
                c[1] = bisect_left(docs, to, c[1], c[3])
                c[0] = docs[c[1]] if c[1] < c[3] else -1

        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for pivot, c in enumerate(cursors):
                bound += c[5]
                if bound >= least:
                    break
            if bound < least:
                return
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            ahead = cursors[: pivot + 1]
            bound, end = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 60
            for c in ahead:
                place = bisect_left(docs, item, c[1], c[3])
                if place < c[3]:
                    block = (place - c[2]) // size
                    bound += c[4] * block_max[c[6] + block]
                    end = min(end, docs[min(c[2] + (block + 1) * size, c[3]) - 1] + 1)
            if bound < least:  # nothing up to the end of the nearest block can reach it
                advance(ahead, max(end, item + 1))
            elif ahead[0][0] == item:
                score = sum(c[4] * impacts[c[1]] for c in ahead)
                if score >= least:
                    yield item, score
                advance(ahead, item + 1)
            else:
                advance([c for c in ahead if c[0] < item], item)
            cursors = [c for c in cursors if c[0] >= 0]

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, float]]:
        """(position of the text, item_id, score of a passage) where the text holds a run of an item's words."""
        unknown, width, run = len(self.vocabulary), 2 * self.run - 1, self.run
        for n, ws in ((n, ws) for n, t in enumerate(texts) if len(ws := words(t)) >= run):
            terms = np.fromiter((self.vocabulary.get(w, unknown) for w in ws), dtype=np.int32, count=len(ws))
            # Only a run of known words whose greatest impacts reach the threshold can make an item a pivot that holds it;
            # passages without one need no cursors.
            known, most = (np.concatenate([[0], np.cumsum(x)]) for x in (terms != unknown, self.most[terms]))
            able = np.concatenate([[0], np.cumsum((known[run:] - known[:-run] == run) & (most[run:] - most[:-run] >= 1 - 1e-6))])
            starts = np.arange(0, len(ws) - run + 1, run)
            ends = np.minimum(starts + width, len(ws))
            for k in np.flatnonzero(able[ends - run + 1] > able[starts]):
                passage = terms[starts[k] : ends[k]]
                for piece, score in self.wand(Counter(t for t in passage.tolist() if t != unknown)):
                    if any(self._holds(piece, passage[j : j + run].tobytes()) for j in range(len(passage) - run + 1)):
                        yield n, self.ids[piece], score * self.threshold[piece]

    def _holds(self, piece: int, run: bytes) -> bool:
        """Whether the piece has these words one after another."""
        text, at = self.text[piece], -1
        while (at := text.find(run, at + 1)) >= 0:
            if at % 4 == 0:
                return True
        return False


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", run: int = RUN, max_index_words: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, score): every document that holds ``run`` consecutive words of a test item.

    ``max_index_words`` bounds what is broadcast at once: with more words the corpus is searched once for each part of the items.
    """
    spark = documents.sparkSession

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, ws) for i, t in zip(part["i"], part["t"], strict=True) for ws in pieces(words(t), run)]
            yield pd.DataFrame(rows, columns=["item", "ws"])

    rows = items.select(F.col(f"`{item_id}`").cast("bigint").alias("i"), F.col(f"`{item_text}`").alias("t")).filter("i is not null and t is not null").distinct()
    entries = materialize(rows.mapInPandas(cut, "item bigint, ws array<string>"))
    size = entries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("ws")), F.lit(0)).alias("words")).first()
    n_parts = -(-size["words"] // max_index_words)
    docs = spread(documents.select(F.col(f"`{doc_id}`").cast("bigint").alias("d"), F.col(f"`{doc_text}`").alias("t")).filter("d is not null and t is not null"))
    schema = "doc_id bigint, item_id bigint, score double"
    hits = []
    if n_parts > 1:
        frequency = materialize(entries.select(F.explode(F.array_distinct("ws")).alias("w")).groupBy("w").agg(F.count("*").alias("df")))
    for part in range(n_parts):
        own = entries.filter(F.pmod(F.xxhash64("item", "ws"), F.lit(n_parts)) == part)
        texts = sorted((r["item"], r["ws"]) for r in own.collect())
        if n_parts > 1:
            df = {r["w"]: r["df"] for r in own.select(F.explode("ws").alias("w")).distinct().join(frequency, "w").collect()}
        else:
            df = Counter(w for _, ws in texts for w in set(ws))
        index = spark.sparkContext.broadcast(Index(texts, df, size["n"], size["words"] / max(size["n"], 1), run))
        hits.append(docs.mapInPandas(_searcher(index), schema))
    if not hits:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, hits).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def _searcher(index):
    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids = part["d"].to_numpy()
            rows = [(ids[n], i, s) for n, i, s in index.value.search(part["t"].tolist())]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score"]).astype({"doc_id": "int64", "item_id": "int64", "score": "float64"})

    return search

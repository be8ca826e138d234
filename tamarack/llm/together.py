"""Items that appear together (problem 1).

Method: external sort of packed 64-bit pair codes. Items get dense 32-bit codes; every pair
of a record is one 64-bit integer, smaller code first. Each task sorts its pair codes in
bounded buffers and writes run-length counted, sorted runs. Runs are partitioned by code and
merged by Spark's external sorter, which spills sorted runs and merges them multiway; a last
pass over the sorted codes adds up the run lengths. Then come expected counts, lift and odds
ratios with the Haldane-Anscombe continuity correction.

Pruning is exact: a pair occurs no more often than its rarer item, so items below the least
pair count are left out before any pair is made. With a least share of all records the number
of items left is at most (mean distinct items of a record) / (least share), whatever the size
of the data. Codes are numbers in order over the whole cluster; they are broadcast if their count
allows, else joined.

A pair code carries everything about its pair, so a hot item spreads over as many partitions
as it has partners, and counts are combined before the shuffle. The items of a record with more than
``LONG`` of them are dealt into that many groups of about ``LONG``, and each pair of groups is a task's work of its own.

Defined results: a null record id or a null item is ignored; a record counts once for each
item however often it repeats it; rows of one record are taken together; empty and null lists
count in the number of records; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.session import materialize, numbered, small_or_join, spread

BUFFER = 1 << 21  # pair codes that a task sorts at once, 16 MB
LONG = 4096  # items of a record whose pairs are made at once


def record_items(df: DataFrame, record_col: str, items_col: str) -> DataFrame:
    """(record, item), distinct. Deduplicated by a map-side aggregate, so a repeated record costs nothing."""
    return (
        df.select(F.col(f"`{record_col}`").cast("string").alias("record"), F.explode(F.col(f"`{items_col}`")).alias("item"))
        .select("record", F.col("item").cast("string").alias("item"))
        .filter("record is not null and item is not null")
        .distinct()
    )


def _runs(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and how often each occurs."""
    if not len(codes):
        return codes, np.empty(0, np.int64)
    if counts is None:
        codes = np.sort(codes, kind="quicksort")
    start = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    length = np.diff(np.append(start, len(codes))) if counts is None else np.add.reduceat(counts, start)
    return codes[start], length


def _record_codes(items: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Packed codes of all pairs of one record, in pieces of about ``most``, so that a very long list fits."""
    items = np.sort(items.astype(np.int64))
    n, i = len(items), 0
    while i < n - 1:
        rows = max(1, min(n - 1 - i, most // max(1, n - 1 - i)))
        left = np.arange(i, i + rows)
        reps = n - 1 - left
        a = np.repeat(left, reps)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(reps) - reps, reps)
        yield (items[a] << 32) | items[b]
        i += rows


def _cross_codes(a: np.ndarray, b: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Packed codes of all pairs of one item of each group, in pieces of about ``most``."""
    a, b = a.astype(np.int64)[:, None], b.astype(np.int64)[None, :]
    rows = max(1, most // max(1, b.shape[1]))
    for i in range(0, len(a), rows):
        yield ((np.minimum(a[i : i + rows], b) << 32) | np.maximum(a[i : i + rows], b)).ravel()


def _pair_runs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of the pair codes of lists, or of two lists (``codes`` and ``others``) that share no item."""
    buffer: list[np.ndarray] = []
    size = 0

    def batch() -> pa.RecordBatch:
        code, n = _runs(np.concatenate(buffer))
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    for part in parts:
        lists = [(c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()) for c in part.columns]
        for k in range(part.num_rows):
            own = [v[o[k] : o[k + 1]] for v, o in lists]
            for codes in _record_codes(own[0], BUFFER) if len(own) == 1 or not len(own[1]) else _cross_codes(*own, BUFFER):
                buffer.append(codes)
                size += len(codes)
                if size >= BUFFER:
                    yield batch()
                    buffer, size = [], 0
    if buffer:
        yield batch()


def _merge_runs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up run lengths over codes that arrive sorted; the last code of a batch waits for the next one."""
    last, count = None, 0
    for part in parts:
        code, n = _runs(part.column(0).to_numpy(), part.column(1).to_numpy())
        if not len(code):
            continue
        n = n.copy()
        if last is not None:
            if code[0] == last:
                n[0] += count
            else:
                code, n = np.concatenate([[last], code]), np.concatenate([[count], n])
        last, count = code[-1], n[-1]
        yield pa.RecordBatch.from_arrays([pa.array(code[:-1].astype(np.int64)), pa.array(n[:-1].astype(np.int64))], names=["code", "n"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([int(last)], pa.int64()), pa.array([int(count)], pa.int64())], names=["code", "n"])


RUNS = "code bigint, n bigint"


def short_runs(coded: DataFrame) -> DataFrame:
    """(code, n): sorted runs of the pair codes of (record, code), for records of bounded length."""
    return coded.groupBy("record").agg(F.collect_list("code").alias("codes")).select("codes").filter(F.size("codes") > 1).mapInArrow(_pair_runs, RUNS)


def pair_runs(coded: DataFrame, long: int = LONG) -> DataFrame:
    """The same for records of any length."""
    sizes = materialize(coded.groupBy("record").agg(F.count("*").alias("size")).filter(F.col("size") > long))
    short = short_runs(coded.join(sizes, "record", "left_anti"))
    groups = F.ceil(F.col("size") / long).cast("int")
    dealt = coded.join(sizes, "record").select("record", "code", groups.alias("groups"), F.pmod(F.xxhash64("code"), groups).cast("int").alias("own"))
    each = dealt.select("record", "code", "own", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    blocks = each.groupBy("record", low.alias("low"), high.alias("high")).agg(F.collect_list(F.when(F.col("own") == F.least("own", "other"), F.col("code"))).alias("codes"), F.collect_list(F.when(F.col("own") != F.least("own", "other"), F.col("code"))).alias("others"))
    # A block of one group has no others: its pairs are those within. A block of two needs items on both sides.
    blocks = blocks.filter("low = high or (size(codes) > 0 and size(others) > 0)")
    return short.unionByName(blocks.select("codes", "others").mapInArrow(_pair_runs, RUNS))


def together(df: DataFrame, record_col: str = "recipe_id", items_col: str = "ingredient_ids", least: int = 6, least_share: tuple[int, int] = (1, 500), long: int = LONG) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n): all pairs with n_ab >= least and n_ab >= n * least_share.

    ``least_share`` is an exact fraction. Raises ValueError if the items left after pruning have no 31-bit codes.
    """
    p, q = least_share
    # Empty lists count, so the number of records comes from all rows; so does a bound of a record's number of items.
    records = df.groupBy(F.col(f"`{record_col}`").cast("string").alias("record")).agg(F.sum(F.size(F.col(f"`{items_col}`"))).alias("size")).filter("record is not null")
    n, most = records.agg(F.count("*"), F.max("size")).first()
    pairs = materialize(record_items(spread(df), record_col, items_col))
    frequent = pairs.groupBy("item").agg(F.count("*").alias("n_item")).filter((F.col("n_item") >= least) & (F.col("n_item") * q >= F.lit(n) * p))
    items, kept = numbered(frequent, "item", name="code")
    if kept >= 1 << 31:
        raise ValueError(f"{kept} items remain; raise the least share")
    items = materialize(items)
    coded = pairs.join(small_or_join(items.select("item", "code")), "item").select("record", "code")
    runs = pair_runs(coded, long) if (most or 0) > long else short_runs(coded)
    merged = runs.repartition("code").sortWithinPartitions("code").mapInArrow(_merge_runs, "code bigint, n_ab bigint")
    merged = merged.filter((F.col("n_ab") >= least) & (F.col("n_ab") * q >= F.lit(n) * p))
    side = {x: small_or_join(items.select(F.col("code").alias(f"code_{x}"), F.col("item").alias(f"item_{x}"), F.col("n_item").alias(f"n_{x}"))) for x in "ab"}
    out = merged.withColumns({"code_a": F.shiftright("code", 32), "code_b": F.col("code").bitwiseAND(F.lit((1 << 32) - 1))})
    return out.join(side["a"], "code_a").join(side["b"], "code_b").select("item_a", "item_b", "n_ab", "n_a", "n_b", F.lit(n).cast("bigint").alias("n"))


def odds_ratio(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """Odds ratio of the two-by-two table with half a record added to each cell."""
    return (n_ab + 0.5) * (n - n_a - n_b + n_ab + 0.5) / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5))


def excess(pairs: DataFrame) -> DataFrame:
    """Adds expected count, lift, odds ratio, its logarithm, and the lower 95 % bound of that logarithm."""
    n_ab, n_a, n_b, n = (F.col(c) for c in ("n_ab", "n_a", "n_b", "n"))
    expected = n_a.cast("double") * n_b / n
    error = F.sqrt(1 / (n_ab + 0.5) + 1 / (n_a - n_ab + 0.5) + 1 / (n_b - n_ab + 0.5) + 1 / (n - n_a - n_b + n_ab + 0.5))
    ratio = odds_ratio(n_ab, n_a, n_b, n)
    return pairs.withColumns({"expected": expected, "lift": n_ab / expected, "odds_ratio": ratio, "log_odds": F.log(ratio), "log_odds_low": F.log(ratio) - 1.96 * error})

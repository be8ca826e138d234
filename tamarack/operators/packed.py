"""Overlaps of lists as packed numbers: the search of ``similarity.overlaps`` with little on disk.

Items get short numbers, first in their own order, then by rising document frequency. Each list of n distinct items is
posted once for each of its n - least + 1 rarest ones, whole, as packed numbers; the lists of one item meet in one place,
by a second common item, and are compared there, so that pairs are never shuffled. A pair is taken where it meets by the
two rarest items that both have, so it comes out once. An item of very many lists is shared out by the second item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ITEMS = 1_000_000  # distinct items whose names and weights go to every task
AT_ONCE = 1 << 19  # lists of one item in one place
PAIRS, VALUES = 1 << 18, 1 << 21  # pairs, and items of pairs, compared at once


def item_names(rows: DataFrame, list_col: str, most: int = MOST_ITEMS) -> list[str] | None:
    """All distinct items in order; None if there are more than ``most``."""
    found = rows.select(F.explode(list_col).alias("item")).filter("item is not null").distinct().limit(most + 1).collect()
    return sorted(r["item"] for r in found) if len(found) <= most else None


def coded(rows: DataFrame, list_col: str, names: list[str]) -> DataFrame:
    """Lists of items as lists of their places in ``names``, so they compare as before; missing items stay missing."""
    shared = rows.sparkSession.sparkContext.broadcast(names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        for part in parts:
            lists = part.column(list_col)
            values = pc.index_in(lists.values.cast(pa.string()), value_set=known)
            at = part.schema.get_field_index(list_col)
            yield part.set_column(at, list_col, pa.ListArray.from_arrays(lists.offsets, values, mask=lists.is_null()) if lists.null_count else pa.ListArray.from_arrays(lists.offsets, values))

    kinds = ", ".join(f"`{f.name}` {'array<int>' if f.name == list_col else f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, kinds)


def _groups(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each x and j of a sorted partition."""
    rest: list[pa.RecordBatch] = []
    last = None
    for part in parts:
        x, j = part.column("x").to_numpy(), part.column("j").to_numpy()
        if not len(x):
            continue
        ends = [0, *np.flatnonzero((x[1:] != x[:-1]) | (j[1:] != j[:-1])) + 1, len(x)]
        for a, b in zip(ends, ends[1:], strict=False):
            if rest and last != (x[a], j[a]):
                yield pa.Table.from_batches(rest)
                rest = []
            last = (x[a], j[a])
            rest.append(part.slice(a, b - a))
    if rest:
        yield pa.Table.from_batches(rest)


def _numbers(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of packed lists in one array, and the length of each list."""
    sizes = pc.binary_length(column).to_numpy() // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(column.to_pylist()), kind), sizes.astype(np.int64)


def _ahead(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted values, the end of each one's run and how many equal ones follow."""
    change = np.flatnonzero(y[1:] != y[:-1]) + 1
    ends = np.repeat([*change, len(y)], np.diff([0, *change, len(y)]))
    return ends, ends - 1 - np.arange(len(y))


def _pieces(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of these sizes that together are no more than ``most``, or one alone."""
    total, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def overlapping(lists: DataFrame, id_col: str, list_col: str, n_items: int, least: int) -> DataFrame:
    """(id_a, id_b, shared, sum_a, sum_b, w_a, w_b): pairs of lists that share at least ``least`` distinct items, two or more.

    ``lists`` has one row for each id and lists of numbers under ``n_items``; it is read twice. Common weights are by either list's own count.
    """
    if least < 2:
        raise ValueError("least must be two or more")
    spark = lists.sparkSession
    # -1 stands once in every row.
    each = F.when(F.col(id_col).isNotNull(), F.array_compact(F.array_distinct(list_col)))
    counts = lists.select(F.explode(F.array_append(F.coalesce(each, F.array().cast("array<int>")), F.lit(-1))).alias("item")).groupBy("item").count().collect()
    df = np.zeros(n_items, np.int64)
    recipes = 0
    for r in counts:
        if r["item"] < 0:
            recipes = r["count"]
        else:
            df[r["item"]] = r["count"]
    order = np.argsort(df, kind="stable")
    rank = np.empty(n_items, np.int64)
    rank[order] = np.arange(n_items)
    idf = np.log((recipes + 1) / (df[order] + 1)) + 1
    kind = "<u2" if n_items <= 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast((rank, idf, df[order] // AT_ONCE + 1))
    id_kind = lists.schema[id_col].dataType.simpleString()

    def post(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, idf, places = shared.value
        for part in parts:
            column = part.column("list")
            row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
            values = column.flatten()
            known = values.is_valid().to_numpy(zero_copy_only=False)
            keys, times = np.unique(row[known] * n_items + rank[values.drop_null().to_numpy()], return_counts=True)
            row, value = np.divmod(keys, n_items)
            size = np.bincount(row, minlength=len(column))
            start = np.cumsum(size) - size
            weight = np.bincount(row, times * idf[value], minlength=len(column))
            nth = np.arange(len(row)) - start[row]
            first = np.flatnonzero(nth <= size[row] - least)
            # Only items of very many lists have more than one place; the second item tells which.
            x, j, at = [value[first]], [np.zeros(len(first), np.int64)], [row[first]]
            if (places[value[first]] > 1).any():
                one = places[value[first]] == 1
                x, j, at = [x[0][one]], [j[0][one]], [at[0][one]]
                for f in first[~one]:
                    r, v = row[f], value[f]
                    for p in np.unique(value[f + 1 : start[r] + size[r] - least + 2] % places[v]):
                        x.append([v]), j.append([p]), at.append([r])
            x, j, at = (np.concatenate(c) for c in (x, j, at))
            packed, often = value.astype(kind), times.astype("<u4")
            whole = [packed[a : a + n].tobytes() for a, n in zip(start, size, strict=True)]
            repeats = [often[a : a + n].tobytes() if n and often[a : a + n].max() > 1 else b"" for a, n in zip(start, size, strict=True)]
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.int32()), "j": pa.array(j, pa.int32()), "id": part.column("id").take(take), "own": pa.array(whole, pa.binary()).take(take), "times": pa.array(repeats, pa.binary()).take(take), "w": pa.array(weight).take(take)})

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, idf, places = shared.value
        for group in _groups(parts):
            if group.num_rows < 2:
                continue
            x, j = group.column("x")[0].as_py(), group.column("j")[0].as_py()
            value, size = _numbers(group.column("own"), kind)
            value = value.astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            start = np.cumsum(size) - size
            times = np.ones(len(value))
            for r in np.flatnonzero(pc.binary_length(group.column("times")).to_numpy()):
                times[start[r] : start[r] + size[r]] = np.frombuffer(group.column("times")[int(r)].as_py(), "<u4")
            own, flat = times * idf[value], row * n_items + value
            # No more items in common than common bits and bits that several items of a list share; the most frequent items have bits of their own.
            bits = np.zeros(len(size), np.uint64)
            np.bitwise_or.at(bits, row, np.uint64(1) << ((n_items - 1 - value) % 64).astype(np.uint64))
            spare = size - np.bitwise_count(bits)
            second = (value > x) & (np.arange(len(value)) - start[row] <= size[row] - least + 1)
            if places[x] > 1:
                second &= value % places[x] == j
            second = np.flatnonzero(second)
            second = second[np.argsort(value[second], kind="stable")]
            if not len(second):
                continue
            y, r = value[second], row[second]
            ends, ahead = _ahead(y)
            for a, b in _pieces(ahead, PAIRS):
                left = np.repeat(np.arange(a, b), ahead[a:b])
                right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(ahead[a:b]) - ahead[a:b], ahead[a:b])
                ra, rb = r[left], r[right]
                near = np.bitwise_count(bits[ra] & bits[rb]) + np.minimum(spare[ra], spare[rb]) >= least
                ra, rb, by = ra[near], rb[near], y[left[near]]
                for c, d in _pieces(size[ra], VALUES):
                    yield from compared(group, ra[c:d], rb[c:d], by[c:d], value, size, start, own, flat)

    def compared(group, ra, rb, by, value, size, start, own, flat) -> Iterator[pa.RecordBatch]:
        n = size[ra]
        pair = np.repeat(np.arange(len(ra)), n)
        mine = start[ra][pair] + np.arange(len(pair)) - (np.cumsum(n) - n)[pair]
        key = rb[pair] * n_items + value[mine]
        other = np.minimum(np.searchsorted(flat, key), len(flat) - 1)
        hit = flat[other] == key
        pair, mine, other = pair[hit], mine[hit], other[hit]
        common = np.bincount(pair, minlength=len(ra))
        rarer = np.bincount(pair, value[mine] < by[pair], minlength=len(ra))  # the first item alone
        kept = np.flatnonzero((common >= least) & (rarer == 1))
        if len(kept):
            sums = (np.bincount(pair, own[at], minlength=len(ra))[kept] for at in (mine, other))
            a, b = (pa.array(c[kept], pa.int64()) for c in (ra, rb))
            ids, w = group.column("id").combine_chunks(), group.column("w").combine_chunks()
            columns = [ids.take(a), ids.take(b), pa.array(common[kept], pa.int64()), *map(pa.array, sums), w.take(a), w.take(b)]
            yield pa.RecordBatch.from_arrays(columns, ["id_a", "id_b", "shared", "sum_a", "sum_b", "w_a", "w_b"])

    rows = lists.filter(F.col(id_col).isNotNull() & (F.size(list_col) >= least)).select(F.col(id_col).alias("id"), F.col(list_col).alias("list"))
    posted = rows.mapInArrow(post, f"x int, j int, id {id_kind}, own binary, times binary, w double")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    met = posted.repartition(n, "x", "j").sortWithinPartitions("x", "j")
    return met.mapInArrow(meet, f"id_a {id_kind}, id_b {id_kind}, shared bigint, sum_a double, sum_b double, w_a double, w_b double")

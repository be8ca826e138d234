"""All similar pairs between set-valued records, of one table or between two (problem 2).

Method: multi-index binary sketches. Every distinct set gets a code of one-bit minhashes:
two sets of Jaccard similarity s agree in a bit with probability (1 + s) / 2. Part of the bits
is packed into segments; sets that agree in a whole segment meet in a pigeonhole join. There
they are kept if their remaining ``CODE`` bits lie within a Hamming radius, and the original
sets of those are then compared exactly.

Segment width, number of segments and radius are calibrated, not guessed. The width is the
logarithm of the number of distinct sets, so unrelated sets seldom meet. The number of
segments is the least for which a pair at the threshold fails to meet in any of them with
probability below ``miss``, so wide segments need more of them; the radius is a bound of the binomial quantile that a pair at the
threshold exceeds with probability below ``miss``. Pairs above the threshold are missed less
often, and every pair returned is exact.

Equal sets are one class before the join, so a group of copies of any size is one record
there. Buckets have no cap: the joins are merge joins by hint, as the planner's estimate does not
count the rows that segments make and would broadcast them; they sort and spill, and AQE splits
skewed partitions.

Defined results: a null id and null items are ignored; repeated items count once; rows of one
id are taken together; sets with fewer than ``least`` items have no partner; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.together import record_items
from tamarack.session import by_key, materialize, spread

SEED = 20_240_607
CODE = 128


def calibrate(sets: int, threshold: float, miss: float) -> tuple[int, int, int]:
    """(segment width, segments, Hamming radius of the code) for this many distinct sets.

    A bucket of unrelated sets holds about eight: a narrower segment needs fewer segments, and to
    compare two codes costs far less than to shuffle one more row.
    """
    same = (1 + threshold) / 2
    width = max(8, math.ceil(math.log2(max(sets, 2))) - 3)
    segments = math.ceil(math.log(miss) / math.log1p(-(same**width)))
    z = math.sqrt(-2 * math.log(miss))  # a bound of the normal quantile
    return width, segments, math.ceil(CODE * (1 - same) + z * math.sqrt(CODE * same * (1 - same)))


def _hashes(items: np.ndarray, xor: np.ndarray, mul: np.ndarray) -> np.ndarray:
    """One 32-bit hash of each item for each bit."""
    h = items.view(np.uint64)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    v = (h ^ (h >> np.uint64(29))).astype(np.uint32)[:, None] ^ xor
    v *= mul
    v ^= v >> np.uint32(15)
    return v


def sketch(sets: DataFrame, width: int, segments: int) -> DataFrame:
    """``items`` of array<bigint> replaced by ``code0``, ``code1`` and ``segments``, array<bigint>. Other columns stay."""
    bits = CODE + width * segments
    rng = np.random.default_rng(SEED)
    xor = rng.integers(0, 1 << 32, bits, dtype=np.uint32)
    mul = rng.integers(0, 1 << 31, bits, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    weights = (1 << np.arange(width)).astype(np.int64)
    half = 1 << np.arange(64, dtype=np.uint64)
    at_once = max(64, (1 << 23) // bits)  # items hashed at once, 32 MB

    def least(items: np.ndarray, starts: np.ndarray) -> np.ndarray:
        # Popular items stand in many sets, so each distinct one is hashed once.
        distinct, place = np.unique(items, return_inverse=True)
        return np.minimum.reduceat(_hashes(distinct, xor, mul)[place], starts, axis=0)

    def signs(values: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The bits of each set; sets are taken together up to ``at_once`` items, longer ones in pieces."""
        i, n = 0, len(offsets) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + at_once, side="right")) - 1)
            pieces = [values[at : min(at + at_once, offsets[j])] for at in range(offsets[i], offsets[j], at_once)] if j == i + 1 else [values[offsets[i] : offsets[j]]]
            low = reduce(np.minimum, (least(piece, offsets[i:j] - offsets[i]) for piece in pieces))
            yield (low >> np.uint32(5)) & np.uint32(1)
            i = j

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            lists = part.column("items")
            all_bits = np.concatenate(list(signs(lists.values.to_numpy(), lists.offsets.to_numpy())))
            code = (all_bits[:, :CODE].astype(np.uint64).reshape(-1, 2, 64) * half).sum(axis=2).view(np.int64)
            own = all_bits[:, CODE:].reshape(-1, segments, width) @ weights
            ends = pa.array(np.arange(0, own.size + 1, segments), pa.int32())
            out = {c: part.column(c) for c in kept} | {"code0": pa.array(code[:, 0]), "code1": pa.array(code[:, 1]), "segments": pa.ListArray.from_arrays(ends, pa.array(own.ravel()))}
            yield pa.RecordBatch.from_pydict(out)

    kept = [c for c in sets.columns if c != "items"]
    # Empty sets have no least hash.
    return sets.filter(F.size("items") > 0).mapInArrow(run, ", ".join(f"{c} {sets.schema[c].dataType.simpleString()}" for c in kept) + ", code0 bigint, code1 bigint, segments array<bigint>")


def set_lists(df: DataFrame, record_col: str, items_col: str, least: int) -> DataFrame:
    """(record, items, class_id): the set of each record as sorted 64-bit hashes, and the 128-bit digest of those."""
    pairs = record_items(spread(df), record_col, items_col).select("record", F.xxhash64("item").alias("item"))
    lists = pairs.groupBy("record").agg(F.array_sort(F.collect_list("item")).alias("items")).filter(F.size("items") >= least)
    return materialize(lists.withColumn("class_id", F.md5(F.concat_ws(",", F.transform("items", lambda x: x.cast("string"))).cast("binary"))))


def set_classes(*lists: DataFrame) -> DataFrame:
    """(class_id, items, sides): equal sets are one class; bit i of ``sides`` tells whether table i has it. One table is both sides."""
    rows = [x.select("class_id", "items", F.lit(1 << i if len(lists) > 1 else 3).alias("side")) for i, x in enumerate(lists)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("class_id").agg(F.min("items").alias("items"), F.bit_or("side").alias("sides"))


def similar_classes(classes: DataFrame, threshold: tuple[int, int], least: int, miss: float = 1e-5) -> DataFrame:
    """(class_a, class_b, common, total), class_a < class_b: similar pairs of different sets, one from each side."""
    p, q = threshold
    # Checkpointed, so the running numbers stay what they are if an executor is lost.
    classes = materialize(by_key(classes, "class_id").withColumn("k", F.monotonically_increasing_id()))
    width, segments, radius = calibrate(classes.count(), p / q, miss)
    # Number, size with sides, and code travel through the join; sets follow for the survivors only.
    coded = sketch(classes.select("k", (F.size("items").cast("bigint") * 4 + F.col("sides")).alias("size"), "items"), width, segments)
    posted = coded.select("k", "size", "code0", "code1", F.posexplode("segments").alias("segment", "value"))
    bucket = (F.shiftleft(F.col("segment").cast("bigint"), 40) + F.col("value")).alias("bucket")
    # Shuffled by bucket once; both sides of the join read the same shuffle.
    posted = posted.select(bucket, "k", "size", "code0", "code1")
    a, b = (posted.select("bucket", *[F.col(c).alias(f"{c}_{x}") for c in posted.columns[1:]]) for x in "ab")
    size_a, size_b = F.shiftright("size_a", 2), F.shiftright("size_b", 2)
    sizes = (size_a * q >= size_b * p) & (size_b * q >= size_a * p)
    across = F.col("size_a").bitwiseOR(F.col("size_b")).bitwiseAND(F.lit(3)) == 3
    distance = sum((F.bit_count(F.col(f"code{i}_a").bitwiseXOR(F.col(f"code{i}_b"))) for i in (0, 1)), F.lit(0))
    met = a.hint("merge").join(b.hint("merge"), "bucket").filter((F.col("k_a") < F.col("k_b")) & sizes & across & (distance <= radius)).select("k_a", "k_b").distinct()
    full = {x: classes.select(F.col("k").alias(f"k_{x}"), F.col("class_id").alias(f"class_{x}"), F.col("items").alias(f"items_{x}")).hint("merge") for x in "ab"}
    met = met.join(full["a"], "k_a").join(full["b"], "k_b").withColumn("common", F.size(F.array_intersect("items_a", "items_b")))
    met = met.withColumn("total", F.size("items_a") + F.size("items_b") - F.col("common"))
    met = met.filter((F.col("common") >= least) & (F.col("common") * q >= F.col("total") * p))
    return met.select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b"), "common", "total")


def _expanded(classes: DataFrame, found: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, common, total): records of ``left`` and ``right`` whose classes are similar or the same."""
    size = F.size("items")
    same = classes.filter("sides = 3").select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b"), size.alias("common"), size.alias("total"))
    turned = found.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b"), "common", "total")
    a = left.select(F.col("record").alias("a"), F.col("class_id").alias("class_a")).hint("merge")
    b = right.select(F.col("record").alias("b"), F.col("class_id").alias("class_b")).hint("merge")
    return found.unionByName(turned).unionByName(same).join(a, "class_a").join(b, "class_b").select("a", "b", "common", "total")


def similar_pairs(df: DataFrame, record_col: str = "recipe_id", items_col: str = "ingredient_ids", threshold: tuple[int, int] = (7, 10), least: int = 6, miss: float = 1e-5) -> DataFrame:
    """(record_a, record_b, common, total), record_a < record_b: every similar pair, copies included."""
    lists = set_lists(df, record_col, items_col, least)
    classes = set_classes(lists)
    found = materialize(similar_classes(classes, threshold, least, miss))
    return _expanded(classes, found, lists, lists).filter("a < b").select(F.col("a").alias("record_a"), F.col("b").alias("record_b"), "common", "total")


def similar_between(left: DataFrame, right: DataFrame, left_cols: tuple[str, str], right_cols: tuple[str, str], threshold: tuple[int, int] = (7, 10), least: int = 6, miss: float = 1e-5) -> DataFrame:
    """(record_a, record_b, common, total): every record of ``left`` with every similar one of ``right``; equal ids of both tables are different records.

    ``left_cols`` and ``right_cols`` name the columns of id and items.
    """
    lists = set_lists(left, *left_cols, least), set_lists(right, *right_cols, least)
    classes = set_classes(*lists)
    found = materialize(similar_classes(classes, threshold, least, miss))
    return _expanded(classes, found, *lists).select(F.col("a").alias("record_a"), F.col("b").alias("record_b"), "common", "total")


def linked_records(df: DataFrame, record_col: str = "recipe_id", items_col: str = "ingredient_ids", threshold: tuple[int, int] = (7, 10), least: int = 6, miss: float = 1e-5) -> DataFrame:
    """(record, class_id, copies, links): one row for each record that has a partner; links counts records of other sets."""
    lists = set_lists(df, record_col, items_col, least)
    size = lists.groupBy("class_id").agg(F.count("*").alias("copies"))
    found = materialize(similar_classes(set_classes(lists), threshold, least, miss))
    both = found.select(F.col("class_a").alias("class_id"), F.col("class_b").alias("other")).unionByName(found.select(F.col("class_b").alias("class_id"), F.col("class_a").alias("other")))
    links = both.hint("merge").join(size.withColumnRenamed("class_id", "other"), "other").groupBy("class_id").agg(F.sum("copies").alias("links"))
    out = lists.select("record", "class_id").hint("merge").join(size, "class_id").join(links, "class_id", "left").select("record", "class_id", "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    return out.filter("copies > 1 or links > 0")

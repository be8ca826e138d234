"""Combinations of recipes that share as many ingredients as possible.

The pool has at most a few hundred recipes by definition, so it is broadcast; each seed grows its
combination in a task of its own, and the results, one row for each seed, are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Sizes of a combination, its default, seeds, results, largest pool.
COUNTS, DEFAULT_COUNT, SEEDS, TOP, LARGEST_POOL = (2, 3, 4, 5), 3, 40, 3, 10_000


def meal_count(n: int | None) -> int:
    return n if n in COUNTS else DEFAULT_COUNT


def grow(seed: int, sets: list[frozenset], quality: list[float], count: int) -> list[int]:
    """Positions of a combination: from the seed, always the recipe that shares most with those taken; ties by quality, then position."""
    taken, used, left = [seed], set(sets[seed]), [i for i in range(len(sets)) if i != seed]
    while len(taken) < count and left:
        best = max(left, key=lambda i: (len(sets[i] & used), quality[i], -i))
        taken.append(best)
        used |= sets[best]
        left.remove(best)
    return taken


def seeds(pool: DataFrame, n: int = SEEDS, seed: int | None = None) -> DataFrame:
    """(pos): half the seeds are the best of the pool, the rest a seeded random choice; without a seed the next best."""
    best = n if seed is None else n // 2
    ranked = pool.withColumn("by_quality", F.row_number().over(Window.orderBy(F.col("quality").desc(), "pos")))
    head = ranked.filter(F.col("by_quality") <= best).select("pos")
    return head if seed is None else head.union(ranked.filter(F.col("by_quality") > best).orderBy(F.xxhash64("pos", F.lit(seed))).limit(n - best).select("pos"))


def combinations(pool: DataFrame, count: int = DEFAULT_COUNT, n_seeds: int = SEEDS, seed: int | None = None) -> DataFrame:
    """(recipe_ids, score, seed_pos): distinct grown combinations.

    ``pool``: id, items array, quality (null is 0). The score of a set of recipes is the sum over
    ingredients of the number of its recipes that have it, less one. A pool smaller than ``count``, or a
    ``count`` of 0 or less, gives nothing. Raises ValueError beyond ``LARGEST_POOL`` recipes.
    """
    spark = pool.sparkSession
    order = Window.orderBy(F.col("quality").desc(), "id")
    ranked = pool.select("id", F.coalesce("items", F.array()).alias("items"), F.coalesce("quality", F.lit(0.0)).alias("quality")).limit(LARGEST_POOL + 1)
    rows = ranked.withColumn("pos", F.row_number().over(order) - 1).orderBy("pos").collect()
    if len(rows) > LARGEST_POOL:
        raise ValueError("the pool is too large; cap it first")
    schema = "recipe_ids array<string>, score bigint, seed_pos int"
    if count <= 0 or len(rows) < count:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(([r.id for r in rows], [frozenset(r["items"]) for r in rows], [float(r.quality) for r in rows]))
    places = seeds(spark.createDataFrame([(r.pos, float(r.quality)) for r in rows], "pos int, quality double"), n_seeds, seed)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, sets, quality = shared.value
        for part in parts:
            out = []
            for p in part["pos"]:
                combo = grow(int(p), sets, quality, count)
                times: dict = {}
                for i in combo:
                    for x in sets[i]:
                        times[x] = times.get(x, 0) + 1
                out.append((sorted(ids[i] for i in combo), sum(k - 1 for k in times.values()), int(p)))
            yield pd.DataFrame(out, columns=["recipe_ids", "score", "seed_pos"])

    grown = places.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, schema)
    return grown.groupBy("recipe_ids", "score").agg(F.min("seed_pos").alias("seed_pos"))


def rested_or_all(rested: DataFrame, every: DataFrame, count: int) -> DataFrame:
    """The pool of rested recipes, or the whole one where that has fewer than ``count``. Looks at ``count`` rows at most."""
    return rested if rested.limit(count).count() >= count else every


def top_disjoint(combos: DataFrame, k: int = TOP) -> DataFrame:
    """The best combinations by score (ties by seed), each sharing no recipe with a better one that is kept.

    There are at most as many combinations as seeds, so the choice is made on the driver.
    """
    kept, used = [], set()
    for r in combos.orderBy(F.col("score").desc(), "seed_pos").collect():
        if len(kept) < k and not used & set(r.recipe_ids):
            kept.append((len(kept) + 1, r.recipe_ids, r.score))
            used |= set(r.recipe_ids)
    return combos.sparkSession.createDataFrame(kept, "rank int, recipe_ids array<string>, score bigint")


def set_scores(sets: DataFrame) -> DataFrame:
    """(set_id, score) for any number of sets; ``sets``: set_id, recipe_id, item."""
    per = sets.groupBy("set_id", "item").agg(F.count_distinct("recipe_id").alias("k"))
    return per.groupBy("set_id").agg(F.sum(F.greatest(F.lit(0), F.col("k") - 1)).alias("score"))

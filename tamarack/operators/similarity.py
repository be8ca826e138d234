"""Near-duplicate baskets: IDF-weighted overlap of ingredient lists and star clustering.

Lists are multisets: a repeated ingredient weighs as often as it stands. Candidate pairs share at
least ``least`` distinct ingredients. Lists meet by the two rarest ingredients that both have: of n distinct
ones in rising document frequency only the n - least + 1 rarest can be the first, and those up to one more the
second. Two ingredients seldom stand together, so few unrelated lists meet.
"""

from __future__ import annotations

from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.operators import packed
from tamarack.session import materialize


def weights(items: DataFrame, recipes: int) -> DataFrame:
    """(item, df, idf): smoothed inverse document frequency ln((N + 1) / (df + 1)) + 1. ``items``: id, item, times."""
    df = items.groupBy("item").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log((F.lit(recipes) + 1) / (F.col("df") + 1)) + 1)


def multiset(rows: DataFrame, id_col: str, list_col: str) -> DataFrame:
    """(id, item, times) of a list column."""
    return rows.select(F.col(id_col).alias("id"), F.explode(list_col).alias("item")).filter("id is not null and item is not null").groupBy("id", "item").agg(F.count("*").alias("times"))


def _numbered_lists(items: DataFrame, recipes: int, least: int) -> DataFrame:
    """(k, id, own, weight): lists of ``least`` or more distinct items, each with its weight, rarest first.

    ``own`` is an array of (rank, item as a 64-bit hash, weight, rest: the weight from there on).
    """
    order = Window.partitionBy("id").orderBy("df", "item")
    rows = items.join(weights(items, recipes), "item").select("id", "item", "df", (F.col("times") * F.col("idf")).alias("w"))
    ranked = rows.select("id", "item", "w", F.row_number().over(order).alias("rank"), F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("rest"))
    lists = ranked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", F.xxhash64("item").alias("item"), "w", "rest"))).alias("own")).filter(F.size("own") >= least)
    # Checkpointed, so the running numbers, far shorter than ids, stay what they are if an executor is lost.
    return materialize(lists.select(F.monotonically_increasing_id().alias("k"), "id", "own", F.get("own", F.lit(0))["rest"].alias("weight")))


def _keys(least: int) -> Column:
    """Array of (key, reach) of every two items of ``own`` that can be the rarest two of a pair's common ones; reach bounds the common weight.

    With ``least`` below two, of every item. Posted rows grow with the square of a list's length.
    """
    n, own = F.size("own"), F.col("own")
    if least < 2:
        return F.transform(own, lambda x: F.struct(x["item"].alias("key"), x["rest"].alias("reach")))
    first = F.slice(own, 1, n - least + 1)
    return F.flatten(F.transform(first, lambda x, i: F.transform(F.slice(own, i + 2, n - least + 1 - i), lambda y: F.struct(F.xxhash64(x["item"], y["item"]).alias("key"), (x["w"] + y["rest"]).alias("reach")))))


def _posted(lists: DataFrame, keys: Column, x: str) -> DataFrame:
    """One row for each key; hinted for a merge join, as the planner's estimate does not count exploded rows."""
    one = lists.select("k", "weight", F.explode(keys).alias("t"))
    return one.select(F.col("t.key").alias("key"), F.col("k").alias(f"k_{x}"), F.col("weight").alias(f"w_{x}"), F.col("t.reach").alias(f"reach_{x}")).hint("merge")


def _verified(met: DataFrame, lists: DataFrame, least: int) -> DataFrame:
    """(id_a, id_b, shared, sum_a, sum_b, w_a, w_b): pairs that share enough items, with the common weight by either list's own count."""
    a, b = (lists.select(*[F.col(c).alias(f"{c}_{x}") for c in ("k", "id", "own", "weight")]).hint("merge") for x in "ab")
    rows = met.join(a, "k_a").join(b, "k_b")
    names = {x: F.transform(f"own_{x}", lambda i: i["item"]) for x in "ab"}
    rows = rows.withColumn("both", F.array_intersect(names["a"], names["b"])).filter(F.size("both") >= least)
    sums = {f"sum_{x}": F.aggregate(F.filter(f"own_{x}", lambda i: F.array_contains("both", i["item"])), F.lit(0.0), lambda s, i: s + i["w"]) for x in "ab"}
    return rows.select("id_a", "id_b", F.size("both").cast("bigint").alias("shared"), *[c.alias(k) for k, c in sums.items()], F.col("weight_a").alias("w_a"), F.col("weight_b").alias("w_b"))


def _directed(pairs: DataFrame, digits: int = 9) -> DataFrame:
    """(id_a, id_b, shared, overlap): both directions, 0 without weight. Scores are rounded, so summing order does not matter."""
    score = {x: F.round(F.coalesce(F.try_divide(F.col(f"sum_{x}"), F.least("w_a", "w_b")), F.lit(0.0)), digits) for x in "ab"}
    ways = F.array(F.struct("id_a", "id_b", score["a"].alias("overlap")), F.struct(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), score["b"].alias("overlap")))
    return pairs.select("shared", F.explode(ways).alias("e")).select("e.id_a", "e.id_b", "shared", "e.overlap")


def overlaps(items: DataFrame, recipes: int, least: int = 6, digits: int = 9) -> DataFrame:
    """(id_a, id_b, shared, overlap): directed weighted overlap of all pairs that share at least ``least`` distinct items.

    overlap(a, b) is the weight of a's items that b has over the smaller of both weights.
    It is not symmetric if items repeat.
    """
    lists = _numbered_lists(items, recipes, least)
    met = _posted(lists, _keys(least), "a").join(_posted(lists, _keys(least), "b"), "key").filter("k_a < k_b").select("k_a", "k_b").distinct()
    return _directed(_verified(met, lists, least), digits)


def list_overlaps(lists: DataFrame, id_col: str, list_col: str, names: list[str] | None, least: int = 6, digits: int = 9) -> DataFrame:
    """The same as ``overlaps`` of lists with one row for each id; lists of places in ``names`` are compared packed, without shuffling pairs."""
    if names is None or least < 2:
        lists = materialize(lists)
        return overlaps(multiset(lists, id_col, list_col), lists.count(), least, digits)
    return _directed(packed.overlapping(lists, id_col, list_col, len(names), least), digits)


def similar_edges(items: DataFrame, recipes: int, threshold: float, least: int = 6) -> DataFrame:
    """(id_a, id_b, shared, overlap): both directions of all pairs of lists without repeats whose overlap reaches ``threshold``.

    The same scores as ``overlaps``, from far fewer candidates: if the lighter list of a pair reaches the threshold,
    the rarest item that both have with all from the second on still makes up that share of its
    weight, so only the rarest few items of the lighter list can be these two.
    """
    lists = _numbered_lists(items.filter("times = 1"), recipes, least)
    bound = F.lit(threshold - 1e-6)
    light = F.filter(_keys(least), lambda t: t["reach"] >= bound * F.col("weight"))
    lighter = (F.col("w_a") < F.col("w_b")) | ((F.col("w_a") == F.col("w_b")) & (F.col("k_a") < F.col("k_b")))
    met = _posted(lists, light, "a").join(_posted(lists, _keys(least), "b"), "key").filter(lighter & (F.col("reach_b") >= bound * F.col("w_a"))).select("k_a", "k_b").distinct()
    return _directed(_verified(met, lists, least)).filter(F.col("overlap") >= threshold)


def star_clusters(nodes: DataFrame, edges: DataFrame, rounds: int = 50, at_once: int = 200_000) -> DataFrame:
    """(variant_id, primary_id): every variant is linked to its primary directly, never through others.

    Nodes (id, score) are ranked by score falling, then id; a node is a primary if no better-ranked
    neighbour is one. Decided in rounds: an open node with no open better neighbour and no better
    primary becomes a primary, and open neighbours of primaries become variants. Every variant belongs to
    its best-ranked primary. Edges (id_a, id_b) are symmetric, as for lists without repeats; the state is
    checkpointed each round, links stay on the cluster. A round may decide no more than one node of a
    chain, so after ``rounds`` of them the open rest is decided in one pass on the driver, once it has
    at most ``at_once`` nodes and links; until then the rounds go on, each deciding at least one node.
    """
    score = nodes.filter("id is not null").groupBy("id").agg(F.max("score").alias("score"))
    rank = F.struct(-F.col("score").alias("s"), F.col("id").alias("i"))
    ranks = score.select("id", rank.alias("rank"))
    both = edges.select("id_a", "id_b").distinct()
    both = both.join(ranks.select(F.col("id").alias("id_a"), F.col("rank").alias("rank_a")), "id_a").join(ranks.select(F.col("id").alias("id_b"), F.col("rank").alias("rank_b")), "id_b")
    better = materialize(both.filter("rank_b < rank_a").select("id_a", "id_b", "rank_b"))  # id_b ranks better than id_a
    state = materialize(better.select(F.col("id_a").alias("id")).union(better.select("id_b")).distinct().withColumn("state", F.lit("open")))
    done = 0
    while not state.filter("state = 'open'").isEmpty():
        if done >= rounds and (rest := _decided(state, better, at_once)) is not None:
            state = materialize(state.join(rest, "id", "left").select("id", F.coalesce("decided", "state").alias("state")))
            break
        done += 1
        seen = better.join(state.withColumnRenamed("id", "id_b"), "id_b").groupBy(F.col("id_a").alias("id")).agg(F.bool_or(F.col("state") == "primary").alias("taken"), F.bool_or(F.col("state") == "open").alias("waits"))
        taken, waits = F.coalesce("taken", F.lit(False)), F.coalesce("waits", F.lit(False))
        new = F.when(F.col("state") != "open", F.col("state")).when(taken, "variant").when(~waits, "primary").otherwise("open")
        state = materialize(state.join(seen, "id", "left").select("id", new.alias("state")))
    primaries = state.filter("state = 'primary'").select(F.col("id").alias("id_b"))
    variants = state.filter("state = 'variant'").select(F.col("id").alias("id_a"))
    links = better.join(primaries, "id_b", "left_semi").join(variants, "id_a", "left_semi")
    return links.groupBy(F.col("id_a").alias("variant_id")).agg(F.min_by("id_b", "rank_b").alias("primary_id"))


def _decided(state: DataFrame, better: DataFrame, most: int) -> DataFrame | None:
    """(id, decided) of all open nodes, best-ranked first; None if they and their undecided links are more than ``most``."""
    nodes = state.filter("state = 'open'").select("id").limit(most + 1).collect()
    if len(nodes) > most:
        return None
    links = better.join(state.filter("state = 'open'").select(F.col("id").alias("id_a")), "id_a", "left_semi")
    links = links.join(state.filter("state <> 'variant'").withColumnRenamed("id", "id_b"), "id_b").select("id_a", "id_b", "state").limit(most + 1).collect()
    if len(links) > most:
        return None
    waits_for: dict = {r["id"]: [] for r in nodes}
    decided = {r["id_b"]: "primary" for r in links if r["state"] == "primary"}
    for r in links:
        waits_for[r["id_a"]].append(r["id_b"])
    for n in TopologicalSorter(waits_for).static_order():
        if n in waits_for:
            decided[n] = "variant" if any(decided[b] == "primary" for b in waits_for[n]) else "primary"
    kind = state.schema["id"].dataType.simpleString()
    return state.sparkSession.createDataFrame([(n, decided[n]) for n in waits_for], f"id {kind}, decided string")


def write_back(recipes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Recipes with ``variant_of_id`` reset and set from the clusters."""
    return recipes.drop("variant_of_id").join(clusters.select(F.col("variant_id").alias("id"), F.col("primary_id").alias("variant_of_id")), "id", "left")

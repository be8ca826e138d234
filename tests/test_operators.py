"""Operators on small tables, against worked examples and brute force."""

import itertools
import math
import random
import threading
from datetime import datetime

from pyspark.sql import functions as F

from tamarack.operators import basket, browse, cards, ingest, packed, similarity, state, suggest, units
from tamarack.plans import baskets, scanned


def test_units(spark):
    cases = {
        "2 tin (5oz) Caper": ("g", 283495), "1/3 Cup Milk": ("ml", 83333), "1,500 G Asparagus": ("g", 1500000), "0,5 ltr x": ("ml", 500000), "3 x 300g tin x": ("g", 900000),
        "2 lb 8 oz x": ("g", 1133981), "1 1/2 tbsps Water": ("ml", 22500), "Trout: 3/4 lbs": ("g", 340194), "4 packs of 12 nuts": None, "5 cm piece x": None, "15mm piece": None, "pinch x": None, "g Pretzel": None,
        "half a ltr of x": ("ml", 500000), "one pints 1st class x": ("ml", 568261), "2 pot [8oz each] x": ("g", 453592), "3 × 400 g x": ("g", 1200000), "8 Plums": None, "": None, None: None, "1.2 liters " + "x " * 5000: ("ml", 1200000),
    }
    rows = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(cases)] * 2, "id long, raw string, q double, u string").withColumn("amount", F.lit("clash"))
    out = {r.record_id: (r.base_unit, r.m) for r in units.to_base_units(rows, "id", "raw", "q", "u").select("record_id", "base_unit", units.amount_milli(F.col("amount")).alias("m")).collect()}
    assert [out.get(i) for i in range(len(cases))] == list(cases.values())
    only = spark.createDataFrame([(1, "Onion", 2.0, " kg/ea"), (2, "Onion", 3.0, "x 25g"), (3, None, 3.0, "tbsp (level)"), (None, "2 kg", None, None)], "id long, raw string, q double, u string")
    out = {r.record_id: (r.base_unit, round(r.amount, 6)) for r in units.to_base_units(only, "id", "raw", "q", "u").collect()}
    assert out == {1: ("g", 2000.0), 2: ("g", 75.0), 3: ("ml", 45.0)}
    assert units.to_base_units(only.limit(0), "id", "raw", "q", "u").count() == 0


def test_browse_params():
    p = browse.BrowseParams.from_query({"protein": ["FISH,UNKNOWN,x,BEEF", "BEEF"], "minCal": "400abc", "maxTime": "x", "fav": "1", "sort": "bad", "page": "0"})
    assert (p.protein_types, p.min_calories, p.max_minutes, p.favourites_only, p.sort, p.page) == (["FISH", "BEEF"], 400, None, True, "rating", 1)
    assert p.to_query() == "protein=FISH%2CBEEF&minCal=400&fav=1" and p.active_filters() == 4
    assert browse.total_pages(0, 24) == 1 and browse.total_pages(25, 24) == 2


def test_basket_totals(spark):
    e = spark.createDataFrame([("R1", "onion", 1.0, None, ""), ("R2", "onion", 2.0, None, ""), ("R1", "rice", 100.0, "g", ""), ("R2", "rice", None, None, ""), ("R2", "egg", 3.0, None, "")], "recipe_id string, ingredient_id string, quantity double, unit string, raw_text string")
    r = spark.createDataFrame([("R1", "A", 2), ("R2", "B", 2)], "recipe_id string, recipe_name string, servings int")
    o = spark.createDataFrame([("R2", 4)], "recipe_id string, planned int")
    scaled = basket.scaled_entries(e, r, o)
    assert {(x.ingredient_id, x.unit, x.total) for x in basket.unit_totals(scaled).collect()} == {("onion", None, 5.0), ("rice", "g", 100.0), ("egg", None, 6.0)}
    assert {(x.ingredient_id, x.recipe_count, x.is_shared) for x in basket.ingredient_groups(scaled).collect()} == {("onion", 2, True), ("rice", 2, True), ("egg", 1, False)}


def test_overlap_of_multisets(spark):
    rows = spark.createDataFrame([("a", ["x", "x", "y"]), ("b", ["x", "z"])], "id string, l array<string>")
    out = {(r.id_a, r.id_b): r.overlap for r in similarity.overlaps(similarity.multiset(rows, "id", "l"), 2, 1).collect()}
    w = {"x": 1.0, "y": math.log(1.5) + 1, "z": math.log(1.5) + 1}
    least = min(2 * w["x"] + w["y"], w["x"] + w["z"])
    assert out == {("a", "b"): round(2 / least, 9), ("b", "a"): round(1 / least, 9)}


def test_packed_overlaps_like_the_joined_ones(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"i{k}" for k in range(40)]
    lists = [(f"r{n}", [rng.choice(vocabulary[: rng.choice([12, 40])]) if rng.random() > 0.02 else None for _ in range(rng.randrange(14))]) for n in range(150)]
    rows = spark.createDataFrame([*lists, ("none", None), ("same", lists[0][1]), (None, lists[0][1])], "id string, l array<string>")
    want = {(r.id_a, r.id_b): (r.shared, r.overlap) for r in similarity.overlaps(similarity.multiset(rows, "id", "l"), rows.count(), 4, 6).collect()}
    names = packed.item_names(rows, "l")
    assert names == sorted(vocabulary) and packed.item_names(rows, "l", 39) is None and len(want) > 500
    for at_once in (packed.AT_ONCE, 20):  # then frequent items are shared out by the second one
        monkeypatch.setattr(packed, "AT_ONCE", at_once)
        out = similarity.list_overlaps(packed.coded(rows, "l", names), "id", "l", names, 4, 6).collect()
        assert len(out) == len(want) and {(r.id_a, r.id_b): (r.shared, r.overlap) for r in out} == want
    assert similarity.list_overlaps(packed.coded(rows.limit(0), "l", names), "id", "l", names, 4).count() == 0
    few = [(r.id_a, r.id_b, r.shared, r.overlap) for r in similarity.list_overlaps(rows, "id", "l", None, 4, 6).collect()]
    assert {(a, b): (s, o) for a, b, s, o in few} == want


def test_basket_overlaps_shuffle_no_pairs(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"r{n}", [f"group{n % 20}-{k}" for k in range(3)] + rng.sample([f"often{k}" for k in range(60)], 6), n) for n in range(2000)]
    spark.createDataFrame(rows, "recipe_id string, ingredient_ids array<string>, completeness_score bigint").write.parquet(str(tmp_path / "recipe_ingredient_set.parquet"))
    sc = spark.sparkContext

    def shuffled() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum({(s := stages.apply(i)).stageId(): s.shuffleWriteBytes() for i in range(stages.size())}.values())

    before = shuffled()
    assert baskets.basket_overlaps(spark, str(tmp_path)).count() < 10_000  # of 99,000 pairs that share three items
    assert shuffled() - before < 2_000_000


def test_star_clusters_like_the_sequential_pass(spark):
    rng = random.Random(5)
    nodes = [(f"n{i:02d}", rng.randrange(4)) for i in range(40)]
    links = {tuple(sorted(rng.sample([n for n, _ in nodes], 2))) for _ in range(70)}
    near = {n: set() for n, _ in nodes}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    claimed = {}
    for n, _ in sorted(nodes, key=lambda x: (-x[1], x[0])):
        if n not in claimed:
            claimed |= {m: n for m in near[n] if m not in claimed}
    edges = spark.createDataFrame([(a, b) for a, b in links] + [(b, a) for a, b in links], "id_a string, id_b string")
    out = similarity.star_clusters(spark.createDataFrame(nodes, "id string, score int"), edges)
    assert {r.variant_id: r.primary_id for r in out.collect()} == claimed


def test_star_clusters_of_a_long_chain(spark):
    n = 13
    ids = [f"n{i:02d}" for i in range(n)]
    nodes = spark.createDataFrame([(i, 1) for i in ids], "id string, score int")
    edges = spark.createDataFrame([x for a, b in itertools.pairwise(ids) for x in ((a, b), (b, a))], "id_a string, id_b string")
    want = {ids[i]: ids[i - 1] for i in range(1, n, 2)}
    for at_once in (200_000, 0):  # the rest on the driver, and by rounds alone
        out = similarity.star_clusters(nodes, edges, 3, at_once).collect()
        assert {r.variant_id: r.primary_id for r in out} == want


def test_suggestions(spark):
    pool = spark.createDataFrame([(f"r{i}", list("abcdef"[i % 3 : i % 3 + 3]), float(i)) for i in range(7)], "id string, items array<string>, quality double")
    combos = suggest.combinations(pool, 3)
    top = suggest.top_disjoint(combos).collect()
    assert len(top) == 2 and not set(top[0].recipe_ids) & set(top[1].recipe_ids)
    items = {r.id: set(r["items"]) for r in pool.collect()}
    for r in top:
        assert r.score == sum(max(0, sum(x in items[i] for i in r.recipe_ids) - 1) for x in "abcdef")
    assert suggest.combinations(pool.limit(2), 3).count() == 0 and suggest.combinations(pool, 0).count() == 0


def test_unique_slugs(spark):
    names = ["A b", "A-b", "a b!", "c"]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    taken = spark.createDataFrame([("a-b",), ("a-b-3",)], "slug string")
    assert {r.id: r.slug for r in state.unique_slugs(rows, taken).collect()} == {0: "a-b-2", 1: "a-b-4", 2: "a-b-5", 3: "c"}


def test_unique_slugs_of_very_many_rows(spark):
    n, used = 100_000, [2, 3, 7, 40_000, 99_999, 100_000, 300_000]
    rows = spark.range(n).select("id", F.lit("Soup").alias("name")).unionByName(spark.createDataFrame([(-1, "Bake")], "id long, name string"))
    taken = spark.createDataFrame([(f"soup-{k}",) for k in used], "slug string")
    timer = threading.Timer(120, spark.sparkContext.cancelAllJobs)  # arrays of all numbers with each row take far longer
    timer.start()
    try:
        out = {r.id: r.slug for r in state.unique_slugs(rows, taken).collect()}
    finally:
        timer.cancel()
    free = (k for k in itertools.count(1) if k not in set(used))
    assert out == {i: "soup" if k == 1 else f"soup-{k}" for i, k in zip(range(n), free)} | {-1: "bake"}


def test_card_parts(spark):
    def one(c):
        return spark.range(1).select(c.alias("r")).first().r

    assert tuple(one(cards.quantity_cell(F.lit("Ya tbsp"))))[:2] == (0.5, "tbsp") and tuple(one(cards.quantity_cell(F.lit("250g"))))[:2] == (250.0, "g")
    assert one(cards.energy_kcal(F.lit("3125[747"))) == 747 and one(cards.energy_kcal(F.lit("5"))) is None
    assert one(cards.merge_wrapped(F.array(F.lit("Soy 11)"), F.lit("13)"), F.lit("Oil")))) == ["Soy 11) 13)", "Oil"]
    assert one(cards.ingredient_lines(F.array(*map(F.lit, ["Ingredients", "Oil", "Nutrition", "Salt"])))) == ["Oil"]
    assert one(cards.ingredient_lines(F.array(*map(F.lit, ["Ingredients", "Oil", "Nutrition", "Salt"])), table=False)) == ["Oil", "Salt"]
    assert tuple(one(cards.card_title(F.lit("ACMEE CARDZ\nKorma with\nChips"), ("ACME", "CARD")))) == ("Korma", "with Chips")
    assert one(cards.step_heading(F.lit("PREP THE"))) == "PREP THE" and one(cards.step_heading(F.lit("2. Cook"))) == "Cook" and one(cards.step_heading(F.lit("cook"))) is None
    texts = spark.createDataFrame([("1 Cut it\nfor about\n40 minutes\n2. Fry",), ("plain",), (None,)], "t string")
    assert [r.r for r in texts.select(cards.flowing_steps(F.array("t")).alias("r")).collect()] == [["Cut it for about 40 minutes", "Fry"], ["plain"], []]


def test_match_rows(spark):
    a = spark.createDataFrame([("k", "x", 1.0), ("k", "y", 2.0), ("k", "z", 9.0)], "key string, text string, y double")
    b = spark.createDataFrame([("k", "p", 1.9), ("k", "q", 2.2), ("l", "r", 0.0)], "key string, text string, y double")
    assert {(r.text, r.match) for r in cards.match_rows(a, b, "key").collect()} == {("x", "p"), ("y", "q"), ("z", None)}


def test_match_rows_of_all_pages(spark):
    rows = [("d", p, f"{p}{c}", y) for p in (1, 2, 4, 5) for c, y in (("a", 1.0), ("b", 9.0))] + [("e", 3, "3a", 1.0), (None, 1, "1n", 1.0), (None, 2, "2n", 1.0)]
    lines = spark.createDataFrame(rows, "draft_id string, page_no int, text string, y double")
    out = {(r.draft_id, r.page_no, r.text): r.match for r in scanned.page_matches(lines).collect()}
    following = {1: 2, 2: 4, 4: 5}
    want = {(d, p, t): None if d == "e" or p == 5 or (d is None and p == 2) else f"{following[p]}{t[1]}" for d, p, t, _ in rows}
    assert out == want


def test_shopping_lists_of_all_plans(spark, tmp_path):
    e = [(1, "p1", "R1", "rice", 100.0, "g", ""), (2, "p1", "R2", "rice", 50.0, "g", ""), (3, "p2", "R1", "rice", 7.0, "g", ""), (4, "p2", "R1", "egg", None, None, ""), (5, None, "R1", "egg", 1.0, None, "")]
    spark.createDataFrame(e, "entry_id long, plan_id string, recipe_id string, ingredient_id string, quantity double, unit string, raw_text string").write.parquet(str(tmp_path / "shopping_list_entry.parquet"))
    spark.createDataFrame([("rice", "rice"), ("egg", "egg")], "id string, canonical_name string").write.parquet(str(tmp_path / "ingredient.parquet"))
    assert [(r.plan_id, r.line) for r in baskets.shopping_lists(spark, str(tmp_path)).collect()] == [("p1", "Rice - 150 g"), ("p2", "Egg - x1"), ("p2", "Rice - 7 g")]


def test_spread_sample(spark):
    rows = spark.range(100).withColumnRenamed("id", "position")
    for k in (1, 2, 7, 100, 200):
        want = list(range(100)) if k >= 100 else sorted({i * 99 // max(k - 1, 1) for i in range(k)})
        assert sorted(r.position for r in ingest.spread_sample(rows, k).collect()) == want


def test_pages_of_all_shapes(spark):
    ld = '<script type="application/ld+json">%s</script>'
    pages = [("https://x.example/recipes/a-1", ld % '[{"@type":"X"},{"@type":"Recipe","name":"N","recipeIngredient":[],"recipeCuisine":0}]'), ("https://x.example/recipes/b", "no data"), ("https://x.example/recipes/c", ld % '{"@type":"Recipe","recipeIngredient":[]}'), (None, None)]
    out = {r.url: r for r in ingest.parse_pages(spark.createDataFrame(pages, "url string, html string")).collect()}
    assert out["https://x.example/recipes/a-1"].error is None and out["https://x.example/recipes/a-1"].cuisine is None
    assert all(out[u].error for u in ("https://x.example/recipes/b", "https://x.example/recipes/c", None))


def test_state_changes(spark):
    plan = spark.createDataFrame([("p", "a", 2)], "plan_id string, recipe_id string, servings int")
    add = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "b")], "plan_id string, recipe_id string")
    assert {tuple(r) for r in state.plan_add(plan, add).collect()} == {("p", "a", 2), ("p", "b", None)}
    rows = spark.createDataFrame([("a", True)], "id string, flag boolean")
    once = state.toggle(rows, rows.select("id"), "flag")
    assert once.first().flag is False
    at = datetime(2025, 1, 1)
    s = spark.createDataFrame([("a", None)], "id string, last_suggested_at timestamp")
    assert state.mark_suggested(s, rows.select("id"), at).filter("last_suggested_at is not null").count() == 1


def test_prefix_join_loses_nothing(spark):
    rng = random.Random(3)
    sets = [(f"s{i}", rng.sample([f"i{int(rng.expovariate(0.2))}-{k}" for k in range(12)], 9)) for i in range(60)]
    sets += [(f"t{i}", [x if rng.random() < 0.8 else f"z{i}" for x in s]) for i, (_, s) in enumerate(sets)]
    rows = spark.createDataFrame(sets, "id string, l array<string>")
    out = {(r.id_a, r.id_b): r.shared for r in similarity.overlaps(similarity.multiset(rows, "id", "l"), len(sets), 4).collect()}
    want = {(a, b): n for (a, x), (b, y) in itertools.permutations(sets, 2) if (n := len(set(x) & set(y))) >= 4}
    assert out == want


def test_links_beyond_a_threshold_lose_nothing(spark):
    rng = random.Random(5)
    sets = [(f"s{i}", [f"i{x}" for x in rng.sample(range(40), rng.randrange(4, 16))]) for i in range(80)]
    sets += [(f"t{i}", [x if rng.random() < 0.85 else f"z{i}" for x in s]) for i, (_, s) in enumerate(sets)] + [("e", []), ("n", None), (None, ["i1"])]
    rows = spark.createDataFrame(sets, "id string, l array<string>").withColumn("l", F.array_distinct("l"))
    items = similarity.multiset(rows, "id", "l")
    for threshold in (0.5, 0.8, 1.0):
        want = {(r.id_a, r.id_b): (r.shared, r.overlap) for r in similarity.overlaps(items, len(sets), 4).filter(F.col("overlap") >= threshold).collect()}
        out = {(r.id_a, r.id_b): (r.shared, r.overlap) for r in similarity.similar_edges(items, len(sets), threshold, 4).collect()}
        assert out == want and want
    assert similarity.similar_edges(items.limit(0), 0, 0.8).count() == 0


def test_rested_pool_or_all(spark):
    few, every = spark.range(2), spark.range(9)
    assert suggest.rested_or_all(few, every, 3).count() == 9 and suggest.rested_or_all(few, every, 2).count() == 2


def test_children_of_clones_and_of_deleted_rows(spark):
    lines = spark.createDataFrame([("1", "a", "x"), ("2", "a", "y"), ("3", "b", "z"), ("4", None, "w")], "edit_id string, recipe_id string, name string")
    clones = spark.createDataFrame([("c", "a")], "id string, cloned_from_id string")
    assert {tuple(r) for r in state.clone_children(lines, clones, "recipe_id").collect()} == {("1", "c", "x"), ("2", "c", "y")}
    keyed = state.clone_children(lines, clones, "recipe_id", "edit_id").collect()
    assert len({r.edit_id for r in keyed}) == 2 and not {r.edit_id for r in keyed} & {"1", "2"}
    every, kept = (spark.createDataFrame([(i,) for i in ids], "id string") for ids in ("ab", "b"))
    assert {r.edit_id for r in state.delete_children(lines, kept, every, "recipe_id").collect()} == {"3", "4"}


def test_committed_drafts(spark):
    schema = "draft_id string, name string, subtitle string, cook_minutes int, serving_counts array<int>, calories int, steps array<string>, ingredients array<struct<name:string,quantity:double,unit:string>>"
    drafts = spark.createDataFrame([("d1", " ", " ", 5, [2, 4], 300, ["Boil"], [("rice", 1.5, "cup"), ("salt", None, None), ("oil", 0.0, "")]), ("d2", "Untitled recipe", None, None, [3], None, None, []), ("d3", None, "x", 1, None, 1, [], None)], schema)
    recipes, lines = state.commit_drafts(drafts, spark.createDataFrame([("untitled-recipe",)], "slug string"), datetime(2025, 1, 1), 1)
    rows = {r.draft_id: r for r in recipes.collect()}
    assert [rows[d].servings for d in ("d1", "d2", "d3")] == [4, 3, None] and {r.name for r in rows.values()} == {"Untitled recipe"}
    assert {r.slug for r in rows.values()} == {"untitled-recipe-2", "untitled-recipe-3", "untitled-recipe-4"} and rows["d1"].subtitle is None
    assert [r.raw_text for r in lines.orderBy("row_no").collect()] == ["1.5 cup rice", "salt", "oil"]

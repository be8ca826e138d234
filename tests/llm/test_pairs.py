"""Co-occurrence and set similarity against brute force, and on odd input."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.llm import similar_sets, together


def baskets(n=150, seed=1):
    rng = random.Random(seed)
    rows = [(f"r{i}", [f"i{int(rng.expovariate(0.12))}" for _ in range(rng.randrange(0, 14))]) for i in range(n)]
    rows += [(f"c{i}", l) for i, (_, l) in enumerate(rows[:40])]  # copies under other ids
    rows += [(f"d{i}", [x if rng.random() < 0.9 else f"q{i}" for x in l]) for i, (_, l) in enumerate(rows[:60])]
    rows += rows[:20] + [(None, ["i1", "i2"]), ("n", None), ("e", []), ("h", [None, "i1", "i1"])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "recipe_id string, ingredient_ids array<string>").withColumns({"item": F.lit("clash"), "record": F.lit(1), "n": F.lit(2)})


def sets_of(rows):
    out = {}
    for r, l in rows:
        if r is not None:
            out.setdefault(r, set()).update(x for x in l or [] if x is not None)
    return out


@pytest.mark.parametrize("least,share,long", [(2, (0, 1), 4096), (6, (1, 30), 4096), (2, (0, 1), 5), (1, (0, 1), 1)])
def test_pairs_like_brute_force(spark, least, share, long):
    rows = baskets()
    sets = sets_of(rows)
    n, one, two = len(sets), {}, {}
    for s in sets.values():
        for x in s:
            one[x] = one.get(x, 0) + 1
        for p in itertools.combinations(sorted(s), 2):
            two[p] = two.get(p, 0) + 1
    want = {(a, b): (k, one[a], one[b], n) for (a, b), k in two.items() if k >= least and k * share[1] >= n * share[0]}
    out = together.together(frame(spark, rows), least=least, least_share=share, long=long).collect()
    assert {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in out} == want


def test_empty_tables(spark):
    empty = frame(spark, baskets()).limit(0)
    assert together.together(empty).count() == 0
    assert similar_sets.similar_pairs(empty).count() == 0
    assert similar_sets.linked_records(empty).count() == 0


def test_excess_of_a_small_table(spark):
    row = together.excess(spark.createDataFrame([(6, 8, 9, 100)], "n_ab long, n_a long, n_b long, n long")).first()
    assert row.expected == pytest.approx(0.72) and row.lift == pytest.approx(6 / 0.72)
    assert row.odds_ratio == pytest.approx(6.5 * 89.5 / (2.5 * 3.5)) and row.log_odds_low < row.log_odds


def test_codes_of_a_very_long_record_come_in_pieces():
    items = np.random.default_rng(1).permutation(400)
    parts = list(together._record_codes(items, 1000))
    codes = np.concatenate(parts)
    assert max(map(len, parts)) <= 1000 and len(set(codes.tolist())) == 400 * 399 // 2
    assert all((c >> 32) < (c & 0xFFFFFFFF) for c in codes[:500].tolist())


def test_runs_are_merged_over_batches():
    import pyarrow as pa

    batch = lambda c, n: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])
    out = [x for b in together._merge_runs(iter([batch([1, 1, 2], [1, 2, 1]), batch([], []), batch([2, 2], [4, 1]), batch([3], [1])])) for x in zip(*b.to_pydict().values(), strict=True)]
    assert out == [(1, 3), (2, 6), (3, 1)]


def test_similar_pairs_like_brute_force(spark):
    rows = baskets(300, 2)
    sets = {r: s for r, s in sets_of(rows).items() if len(s) >= 5}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if (i := len(sets[a] & sets[b])) >= 5 and 10 * i >= 7 * len(sets[a] | sets[b])}
    out = {(r.record_a, r.record_b): (r.common, r.total) for r in similar_sets.similar_pairs(frame(spark, rows), least=5).collect()}
    assert set(out) == want
    assert all(v == (len(sets[a] & sets[b]), len(sets[a] | sets[b])) for (a, b), v in out.items())
    links = {r.record: (r.copies, r.links) for r in similar_sets.linked_records(frame(spark, rows), least=5).collect()}
    partners = {}
    for a, b in want:
        for x, y in ((a, b), (b, a)):
            partners.setdefault(x, []).append(y)
    assert links == {r: (1 + sum(sets[p] == sets[r] for p in ps), sum(sets[p] != sets[r] for p in ps)) for r, ps in partners.items()}


def test_calibrated_recall_at_the_threshold(spark):
    """Pairs exactly at the threshold: 14 of 20 items shared."""
    rng, rows = random.Random(9), []
    for i in range(400):
        x = rng.sample(range(10**6), 20)
        rows += [(f"a{i:03d}", [str(v) for v in x[:17]]), (f"b{i:03d}", [str(v) for v in x[:14] + x[17:]])]
    out = {(r.record_a, r.record_b) for r in similar_sets.similar_pairs(frame(spark, rows)).collect()}
    assert out == {(f"a{i:03d}", f"b{i:03d}") for i in range(400)}


def test_calibration_grows_with_the_data():
    w1, s1, r1 = similar_sets.calibrate(1000, 0.7, 1e-5)
    w2, s2, r2 = similar_sets.calibrate(10**9, 0.7, 1e-5)
    assert w1 < w2 and s1 < s2 and r1 == r2 and (1 - 0.85**w2) ** s2 <= 1e-5


def test_between_two_tables_like_brute_force(spark):
    left, right = baskets(120, 3), baskets(160, 3)
    one, two = ({r: s for r, s in sets_of(rows).items() if len(s) >= 5} for rows in (left, right))
    want = {(a, b) for a, x in one.items() for b, y in two.items() if len(x & y) >= 5 and 10 * len(x & y) >= 7 * len(x | y)}
    other = spark.createDataFrame(right, "id string, tags array<string>")
    out = similar_sets.similar_between(frame(spark, left), other, ("recipe_id", "ingredient_ids"), ("id", "tags"), least=5)
    found = [(r.record_a, r.record_b) for r in out.collect()]
    assert len(found) == len(set(found)) and set(found) == want and any(a == b for a, b in want)
    assert similar_sets.similar_between(frame(spark, left), other.limit(0), ("recipe_id", "ingredient_ids"), ("id", "tags"), least=5).count() == 0


def test_no_segment_is_broadcast(spark):
    classes = similar_sets.set_classes(similar_sets.set_lists(frame(spark, baskets()), "recipe_id", "ingredient_ids", 5))
    plan = similar_sets.similar_classes(classes, (7, 10), 5)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_sketch_of_a_long_set_in_pieces(spark):
    long = spark.sql("select 1 as k, transform(sequence(1, 200000), x -> xxhash64(x)) as items union all select 2, transform(sequence(1, 200001), x -> xxhash64(x)) union all select 3, array(1L)")
    rows = {r.k: r for r in similar_sets.sketch(long, 8, 20).collect()}
    same = sum(x == y for x, y in zip(rows[1].segments, rows[2].segments, strict=True))
    assert len(rows[1].segments) == 20 and same >= 19 and rows[1].code0 == rows[2].code0

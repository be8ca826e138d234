"""Helpers that every operator shares."""

from pyspark.sql import functions as F

from tamarack.session import numbered, small_or_join


def test_numbers_over_all_partitions(spark):
    rows = spark.range(0, 1000, numPartitions=7).select((F.col("id") * 37 % 1000).alias("v"), F.lit("same").alias("hot"))
    out, total = numbered(rows, "hot", "v")
    assert total == 1000 and [(r.v, r.seq) for r in out.orderBy("v").collect()] == [(i, i) for i in range(1000)]
    out, total = numbered(rows.limit(0), "v", name="code")
    assert total == 0 and out.count() == 0 and "code" in out.columns


def test_only_counted_tables_are_broadcast(spark):
    plan = lambda df: spark.range(10).join(df, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(small_or_join(spark.range(100), 100)) and "broadcast" not in plan(small_or_join(spark.range(101), 100))

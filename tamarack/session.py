"""Session factory and the few helpers that every operator shares."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "tamarack", cpus: str | int = "*", shuffle: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the bench use.

    On a cluster the session comes from spark-submit; nothing in the library
    depends on these settings.
    """
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TAMARACK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's Parquet tables. A lazy scan; Catalyst prunes its columns."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only on a local master, as in tests, may it
    be unset: a temporary folder of this machine is used then.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", "")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tamarack-"))
    return df.checkpoint(eager=True)


def small_or_join(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """``broadcast(df)`` if it has no more than ``most_rows`` rows, which are counted, else df as it is. For narrow tables that are cheap to read."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def newest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row for each key, the first in the given order.

    ``max_by`` on a struct aggregates on the map side, so a key with very many rows
    sends one row from each task and never gathers in one place.
    """
    cols = df.columns
    best = F.min_by(F.struct(*[F.col(f"`{c}`") for c in cols]), F.struct(*order)).alias("_row")
    return df.groupBy(F.col(f"`{key}`").alias("_key")).agg(best).select(*[F.col("_row").getField(c).alias(c) for c in cols])


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, for Python-heavy work on an input of fewer partitions than cores.

    An input with enough partitions, as any large one, is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def numbered(df: DataFrame, *order: str, name: str = "seq") -> tuple[DataFrame, int]:
    """Rows numbered from 0 in this order over the whole cluster, and how many there are.

    Range partitions are sorted and checkpointed, so the numbers stay what they are if an executor is lost; what
    reaches the driver is one row for each partition. Name enough columns that no value of all of them is too frequent.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    placed = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    offsets, total = [], 0
    for r in sorted(placed.groupBy("_part").count().collect()):
        offsets.append((r["_part"], total))
        total += r["count"]
    starts = spark.createDataFrame(offsets, "_part bigint, _offset bigint")
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_offset") + F.col("_at")).drop("_part", "_offset", "_at"), total


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Rows partitioned by these columns into a fixed number of partitions.

    For Python work on groups: the adaptive plan does not merge a partitioning that was asked
    for by number, so small groups still use all cores; a groupBy on the same keys needs no
    further shuffle.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)

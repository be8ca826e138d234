"""Incremental ingest as a stream: landed page files are parsed in micro-batches and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tamarack.operators.ingest import parse_pages

PAGES = "url string, final_url string, html string"


def parsed_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """Parsed pages of the Parquet files that land in a folder; the same expressions as in batch."""
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return parse_pages(pages)


def run(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Good rows and error rows into two tables, once for all files there, exactly once by checkpoint and batch folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.filter("error is null").write.mode("overwrite").parquet(f"{target}/recipes/batch={number}")
        batch.filter("error is not null").select("url", "error").write.mode("overwrite").parquet(f"{target}/errors/batch={number}")

    return parsed_stream(spark, source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

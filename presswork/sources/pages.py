"""Page tables: the raw input of extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Most pages in a task of an extraction.
TASK_PAGES = 5_000


def spread(df: DataFrame) -> DataFrame:
    """Use all cores, and tasks of at most ``TASK_PAGES`` pages.

    Extraction costs milliseconds per page, so a table in a few large row groups
    would leave most cores idle, and its tasks would grow with it. A table with enough
    splits, all of them small, is left as it is. Counting reads no column of a file.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.groupBy(F.spark_partition_id()).count()
    total, most = splits.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    if df.rdd.getNumPartitions() >= cores and most <= TASK_PAGES:
        return df
    return df.repartition(max(cores, -(-total // TASK_PAGES)))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, html from a Parquet page table."""
    return spark.read.parquet(path).select("page_id", "url", "html")

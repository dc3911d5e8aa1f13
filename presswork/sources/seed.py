"""Seed records for an empty catalogue (invented)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.functions.ids import article_id, content_path, image_path
from presswork.sources.store import article_rows

SEED = [
    ("Harbour Lights Gets a Winter Update", "A small team adds snow, ice fishing and a night market.",
     "Sample Wire", "https://news.example.com/harbour-lights-winter", "https://img.example.com/harbour.jpg"),
    ("Cloud Courier Delayed to Autumn", "The studio wants more time for its delivery routes.",
     "Sample Wire", "https://news.example.com/cloud-courier-delay", "https://img.example.com/courier.png"),
    ("Ten Puzzles for a Rainy Day", "Short games that can be finished before the kettle boils.",
     "Sample Post", "https://post.example.org/ten-puzzles", "https://img.example.org/puzzles.webp"),
]


def seed_articles(spark: SparkSession, now: Column | None = None, start: int = -1_000) -> DataFrame:
    """The seed in the store's schema, with derived id and paths."""
    columns = "ingest_seq long, title string, content string, source_name string, source_url string, image_url string"
    rows = spark.createDataFrame([(start + i, *r) for i, r in enumerate(SEED)], columns)
    id_ = article_id(F.col("title"), F.col("source_url"))
    return article_rows(rows.select(
        "*", image_path(id_, F.col("image_url")).alias("local_image_path"),
        content_path(id_).alias("local_content_path")), now)

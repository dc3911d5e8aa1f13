"""Schemas of the stored datasets and the column lists of the public views."""

from pyspark.sql import types as T

_TEXT = T.StringType()

ARTICLE_SCHEMA = T.StructType([
    T.StructField("ingest_seq", T.LongType(), False),
    T.StructField("id", _TEXT, False),
    T.StructField("title", _TEXT, False),
    T.StructField("description", _TEXT),
    T.StructField("content", _TEXT),
    T.StructField("source_name", _TEXT, False),
    T.StructField("source_url", _TEXT, False),
    T.StructField("published_date", _TEXT),
    T.StructField("image_url", _TEXT),
    T.StructField("local_image_path", _TEXT),
    T.StructField("local_content_path", _TEXT),
    T.StructField("scrape_timestamp", T.TimestampType(), False),
])

HISTORY_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("filename", _TEXT, False),
    T.StructField("article_count", T.LongType(), False),
])

CONTENT_SCHEMA = T.StructType([
    T.StructField("article_id", _TEXT, False),
    T.StructField("content", _TEXT),
])

PAGE_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType(), False),
    T.StructField("url", _TEXT),
    T.StructField("html", _TEXT),
])

# The public record and the list record, in output order.
PUBLIC_COLUMNS = [
    "id", "title", "content", "source_name", "source_url",
    "image_url", "local_image_path", "scrape_timestamp",
]
LIST_COLUMNS = [
    "id", "title", "content", "source_name", "source_url",
    "image_url", "local_image_path", "local_content_path", "scrape_timestamp",
]
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"

ENVELOPE_SCHEMA = T.StructType([
    T.StructField("scrape_timestamp", _TEXT),
    T.StructField("article_count", T.LongType()),
    T.StructField("articles", T.ArrayType(
        T.StructType([T.StructField(name, _TEXT) for name in PUBLIC_COLUMNS]))),
])

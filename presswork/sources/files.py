"""JSON envelopes, exports, content files and image files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.functions.images import image_kind, image_ok
from presswork.functions.text import or_empty
from presswork.operators.catalog import export_view, public_columns
from presswork.operators.dedup import merge_by_url
from presswork.operators.repair import backfill_content, with_default_body
from presswork.schema import ENVELOPE_SCHEMA, PUBLIC_COLUMNS, TIMESTAMP_FORMAT
from presswork.sources.store import ArticleStore

class CorruptEnvelope(RuntimeError):
    """An envelope could not be read; it is left as it is."""


def _envelopes(spark: SparkSession, path: str) -> DataFrame:
    """file, raw and whether the text is no envelope; an envelope is one whole file, by its format.

    No envelope is what isn't JSON, or has no list under ``articles``.
    """
    listed = F.startswith(F.ltrim(F.get_json_object("value", "$.articles")), F.lit("["))
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"),
        (F.try_parse_json("value").isNull() | ~F.coalesce(listed, F.lit(False))).alias("corrupt"))


def read_envelope(spark: SparkSession, path: str) -> DataFrame:
    """Article rows of the readable envelopes below ``path``, missing fields as ''.

    ``pos`` grows from file to file by name, and within a file.
    """
    good = _envelopes(spark, path).filter(~F.col("corrupt"))
    rows = good.select("file", F.posexplode(F.from_json("raw", ENVELOPE_SCHEMA)["articles"]).alias("place", "a"))
    return rows.orderBy("file", "place").select(
        F.monotonically_increasing_id().alias("pos"),
        *(or_empty(F.col("a")[name]).alias(name) for name in PUBLIC_COLUMNS))


def corrupt_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """File and raw text of every envelope that cannot be read."""
    return _envelopes(spark, path).filter("corrupt").select("file", "raw")


def read_envelope_strict(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_envelope`, but an unreadable file is an error.

    Merging into a dataset goes through here: taking a broken file for an empty
    one would overwrite what it held.
    """
    if not corrupt_envelopes(spark, path).isEmpty():
        raise CorruptEnvelope(path)
    return read_envelope(spark, path)


def merge_dataset(spark: SparkSession, existing: str, new: DataFrame, out: str) -> None:
    """Existing envelope records, then the new ones with unseen URLs, as JSON Lines.

    ``out`` must be another path than ``existing``: switch readers over to it
    when it is complete.
    """
    if out.rstrip("/") == existing.rstrip("/"):
        raise ValueError("write a merged dataset to a path of its own")
    old = read_envelope_strict(spark, existing).withColumnRenamed("pos", "ingest_seq")
    merged = merge_by_url(
        old.withColumn("is_new", F.lit(False)),
        new.select("ingest_seq", *public_columns(new), F.lit(True).alias("is_new")))
    merged.orderBy("is_new", "ingest_seq").select(*PUBLIC_COLUMNS).write.mode("errorifexists").json(out)


def write_envelope(articles: DataFrame, path: str, now: Column | None = None) -> None:
    """The catalogue as one nested envelope, written as text parts in order.

    The first line opens the envelope with time and count, a line for each article
    follows, the last one closes it. Parts are ordered by name, so their concatenation
    is the envelope, of any size.
    """
    stamp = F.date_format(F.current_timestamp() if now is None else now, TIMESTAMP_FORMAT)
    rows = export_view(with_default_body(articles))
    numbered = rows.select(F.to_json(F.struct(*PUBLIC_COLUMNS)).alias("line")).withColumn(
        "place", F.monotonically_increasing_id())
    total = articles.count()
    spark = articles.sparkSession
    first = spark.range(1).select(
        F.concat(F.lit('{"scrape_timestamp": "'), stamp, F.lit(f'", "article_count": {total}, "articles": [')).alias("value"),
        F.lit(-1).cast("long").alias("place"))
    comma = F.when(F.col("place") == 0, F.lit("")).otherwise(F.lit(","))
    body = numbered.select(F.concat(comma, "line").alias("value"), "place")
    end = spark.range(1).select(F.lit("]}").alias("value"), F.lit(2 ** 63 - 1).alias("place"))
    first.unionByName(body).unionByName(end).orderBy("place").select("value").write.mode("overwrite").text(path)


def export(store: ArticleStore, path: str, content: DataFrame | None = None, now: Column | None = None) -> None:
    """Public records as JSON Lines, newest first, and one row of export history.

    Blank bodies are filled from ``content``, else by the default wording. The count in
    the history is taken from the written files.
    """
    articles = store.articles()
    articles = with_default_body(articles) if content is None else backfill_content(articles, content)
    export_view(articles).write.mode("overwrite").json(path)
    stamp = F.current_timestamp() if now is None else now
    written = store.spark.read.schema(ENVELOPE_SCHEMA["articles"].dataType.elementType).json(path)
    written.agg(F.count("*").alias("article_count")).select(
        stamp.alias("timestamp"), F.lit(path).alias("filename"), "article_count"
    ).write.mode("append").parquet(store.history_path)


def export_days(store: ArticleStore, path: str, added: DataFrame | None = None, now: Column | None = None,
                content: DataFrame | None = None) -> None:
    """Public records as JSON Lines, a folder for each day of the store's times, and a row of history.

    With ``added``, rows that a batch brought, only the days they fall on are read and
    written again, whole; the other folders stay as they are. Without it all days are
    written. Files of a day are newest first. The count in the history is the store's.
    Replacing a day's folder is not atomic for those who read it at that moment.
    """
    articles = store.articles()
    day = F.to_date("scrape_timestamp")
    if added is not None:
        days = [r[0] for r in added.select(day.alias("day")).distinct().orderBy("day").collect()]  # at most one row a day
        if days:
            # The bounds let the scan skip row groups, the list makes them exact.
            articles = articles.filter(
                (F.col("scrape_timestamp") >= F.lit(days[0])) & (F.col("scrape_timestamp") < F.date_add(F.lit(days[-1]), 1))
                & day.isin(days))
        else:
            articles = articles.limit(0)
    articles = with_default_body(articles) if content is None else backfill_content(articles, content)
    order = [F.desc("scrape_timestamp"), "ingest_seq"]
    rows = articles.withColumn("_day", day).repartitionByRange("_day", *order).sortWithinPartitions("_day", *order)
    rows.select(*public_columns(rows), F.date_format("_day", "yyyy-MM-dd").alias("day")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic" if added is not None else "static").partitionBy("day").json(path)
    stamp = F.current_timestamp() if now is None else now
    total = sum(p["rows"] for p in store.state()["articles"])
    store.spark.range(1).select(
        stamp.alias("timestamp"), F.lit(path).alias("filename"), F.lit(total).cast("long").alias("article_count")
    ).write.mode("append").parquet(store.history_path)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """The public records of ``export_days``."""
    return spark.read.schema(ENVELOPE_SCHEMA["articles"].dataType.elementType).json(path).select(*PUBLIC_COLUMNS)


def read_envelope_lines(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Article rows of envelopes that hold one article a line, as ``write_envelope`` writes them.

    Such a file, of any size, is split like any text; no task reads it whole. ``pos`` grows
    in the order of files by name and of lines in them. A line that is neither an article
    nor the head or end of an envelope makes ``strict`` reading fail, and is passed over
    otherwise.
    """
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(F.trim(F.col("value")).alias("value"), place.alias("place"))
    lines = lines.filter(~F.col("value").rlike(r'^(?:\{\s*"scrape_timestamp".*"articles"\s*:\s*\[\s*)?(?:\]\s*\})?$'))
    article = ENVELOPE_SCHEMA["articles"].dataType.elementType
    # A comma may stand at either end of the line.
    parsed = F.from_json(F.regexp_replace("value", r"^,\s*|\s*,$", ""), article.add("_bad", "string"), {
        "columnNameOfCorruptRecord": "_bad"})
    rows = lines.select("place", parsed.alias("a"))
    broken = F.col("a").isNull() | F.col("a._bad").isNotNull()
    if strict:
        rows = rows.filter(F.when(broken, F.raise_error(F.lit(f"not an article in {path}")).cast("boolean")).otherwise(True))
    else:
        rows = rows.filter(~broken)
    return rows.orderBy("place").select(
        F.monotonically_increasing_id().alias("pos"), *(or_empty(F.col("a")[name]).alias(name) for name in PUBLIC_COLUMNS))


def write_content(articles: DataFrame, path: str, mode: str = "append") -> None:
    """The content side dataset: article_id, content."""
    articles.select(F.col("id").alias("article_id"), "content").write.mode(mode).parquet(path)


def read_content(spark: SparkSession, path: str) -> DataFrame:
    """The content side dataset as (id, content)."""
    return spark.read.parquet(path).select(F.col("article_id").alias("id"), "content")


def read_content_files(spark: SparkSession, path: str) -> DataFrame:
    """One text file per article, ``<id>.txt``, as (id, content)."""
    files = spark.read.text(path, wholetext=True)
    name = F.col("_metadata.file_name")
    return files.select(F.regexp_replace(name, r"[.]txt$", "").alias("id"), F.col("value").alias("content"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files with their bytes; the content type comes from the suffix."""
    files = spark.read.format("binaryFile").load(path)
    suffix = F.lower(F.regexp_extract("path", r"[.]([A-Za-z0-9]+)$", 1))
    return files.select("path", "length", "content", F.concat(
        F.lit("image/"), F.when(suffix == "svg", "svg+xml").otherwise(suffix)).alias("content_type"))


def image_report(images: DataFrame) -> DataFrame:
    """path, kind and whether the file passes as an image."""
    content = F.col("content")
    return images.select(
        "path", image_kind(content).alias("kind"),
        image_ok(F.col("content_type"), content, F.col("length")).alias("ok"))

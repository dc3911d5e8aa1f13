"""Catalog queries over the article store."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.functions.text import or_empty
from presswork.plans.paging import newest_first, page
from presswork.schema import LIST_COLUMNS, PUBLIC_COLUMNS, TIMESTAMP_FORMAT

# Page size of a search, and the catalog size that is too small.
SEARCH_LIMIT = 10
REFILL_BELOW = 20


def _view(df: DataFrame, names: Iterable[str]) -> list[Column]:
    """The named fields as text, '' where missing."""
    def one(name: str) -> Column:
        if name not in df.columns:
            return F.lit("").alias(name)
        c = F.col(name)
        if dict(df.dtypes)[name].startswith("timestamp"):
            c = F.date_format(c, TIMESTAMP_FORMAT)
        return or_empty(c).alias(name)
    return [one(n) for n in names]


def public_columns(df: DataFrame) -> list[Column]:
    return _view(df, PUBLIC_COLUMNS)


def public_view(df: DataFrame) -> DataFrame:
    return df.select(*public_columns(df))


def of_source(df: DataFrame, source: str | None, ignore_case: bool = False) -> DataFrame:
    """Articles of one source; all of them without a source."""
    if not source:
        return df
    if ignore_case:
        return df.filter(F.lower("source_name") == source.lower())
    return df.filter(F.col("source_name") == source)


def list_articles(df: DataFrame, limit: int | None = None, offset: int = 0, source: str | None = None,
                  ignore_case: bool = False) -> DataFrame:
    """The list fields (and ``ingest_seq``), newest first."""
    chosen = page(of_source(df, source, ignore_case), limit, offset)
    return chosen.select(*_view(chosen, LIST_COLUMNS), "ingest_seq")


def article_by_id(df: DataFrame, id_: str) -> DataFrame:
    """The public record with this id; no row for an unknown id."""
    return public_view(df.filter(F.col("id") == id_))


def keyword_pattern(query: str) -> str:
    """The query as a pattern: ``%`` and ``_`` are wildcards, all else is itself.

    Java folds only ASCII letters under ``(?i)``, which is the case rule wanted.
    Each stretch between ``%`` signs takes its first place after the one before
    and is never tried again, so the time stays linear in the text.
    """
    stretches = [s for s in query.split("%") if s]
    found = ("".join("." if ch == "_" else re.escape(ch) for ch in s) for s in stretches)
    return "(?is)\\A" + "".join(f"(?>.*?{s})" for s in found)


def matches_keyword(query: str, *columns: Column) -> Column:
    """True where a column contains the query; ASCII case does not matter."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(c.rlike(keyword_pattern(query)), F.lit(False))
    return hit


def search(df: DataFrame, query: str, limit: int | None = SEARCH_LIMIT, offset: int = 0) -> DataFrame:
    """Articles with the keyword in title or content, newest first."""
    if not query:
        raise ValueError("a search needs a query")
    return page(df.filter(matches_keyword(query, F.col("title"), F.col("content"))), limit, offset)


def count_articles(df: DataFrame, source: str | None = None) -> DataFrame:
    return of_source(df, source).agg(F.count("*").alias("n"))


def sources(df: DataFrame) -> DataFrame:
    return df.select("source_name").distinct().orderBy("source_name")


def count_by_source(df: DataFrame) -> DataFrame:
    return df.groupBy("source_name").agg(F.count("*").alias("n")).orderBy("source_name")


def batch_summary(batch: DataFrame, accepted: DataFrame) -> DataFrame:
    """Records scraped and records added, as one row."""
    return batch.agg(F.count("*").alias("scraped")).select(
        "scraped", accepted.agg(F.count("*")).scalar().alias("added"))


def source_health(articles: DataFrame, wanted: DataFrame) -> DataFrame:
    """How many of the wanted sources gave articles and how many gave none."""
    found = articles.groupBy("source_name").agg(F.count("*").alias("n"))
    return wanted.join(found, "source_name", "left").agg(
        F.count_if(F.col("n") > 0).alias("succeeded"),
        F.count_if(F.col("n").isNull()).alias("failed"))


def catalog_health(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n")).select("n", (F.col("n") < REFILL_BELOW).alias("needs_ingest"))


def page_total(df: DataFrame, limit: int | None, offset: int = 0, source: str | None = None) -> DataFrame:
    """Total before paging beside the page's own size; no row is sorted for it."""
    start = max(offset or 0, 0)
    total = F.col("total")
    left = F.greatest(total - start, F.lit(0))
    size = left if limit is None or limit < 0 else F.least(left, F.lit(limit))
    return count_articles(df, source).select(
        F.col("n").alias("total"), F.lit(start).cast("long").alias("offset"),
        F.lit(limit).cast("long").alias("limit")).withColumn("page_size", size.cast("long"))


def site_subset(df: DataFrame, wanted: Iterable[str], known: Iterable[str]) -> DataFrame:
    """Articles of the wanted sources; unknown names are ignored, none left is an error."""
    known = list(known)
    chosen = [w for w in wanted if w in known]
    if not chosen:
        raise ValueError(f"no valid source; available: {', '.join(known)}")
    return df.filter(F.col("source_name").isin(chosen))


def seeded(store: DataFrame, seed: DataFrame) -> DataFrame:
    """The store, or the seed records while the store is empty."""
    return store.unionByName(seed.filter(~store.limit(1).exists()))


def export_view(df: DataFrame) -> DataFrame:
    """Public records, newest first."""
    return public_view(newest_first(df))

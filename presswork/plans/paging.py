"""Newest-first pages that stay cheap at any depth, one way for all sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Offsets up to this are found by a top-k of keys, deeper ones by histograms first.
TOP_K_ROWS = 100_000
# Pages of at most so many rows, already cut out, are sorted in one place.
ONE_PLACE_ROWS = 1_000

TIME, SEQ = "scrape_timestamp", "ingest_seq"
NO_TIME = -(1 << 62)


def _when() -> Column:
    """The time of a record in microseconds; one without a time is older than all others."""
    return F.coalesce(F.unix_micros(TIME), F.lit(NO_TIME))


def newest_first(df: DataFrame) -> DataFrame:
    """By time, newest first; records of one time keep their ingest order, those without a time come last."""
    return df.orderBy(_when().desc(), F.asc(SEQ))


def _time(value) -> Column:
    return F.coalesce(F.unix_micros(F.lit(value).cast("timestamp")), F.lit(NO_TIME))


def after(df: DataFrame, time, seq: int, inclusive: bool = False) -> DataFrame:
    """Records that follow the given one in newest-first order (keyset paging)."""
    place = F.col(SEQ) >= seq if inclusive else F.col(SEQ) > seq
    return df.filter((_when() < _time(time)) | ((_when() == _time(time)) & place))


def before(df: DataFrame, time, seq: int) -> DataFrame:
    """Records that precede the given one in newest-first order."""
    return df.filter((_when() > _time(time)) | ((_when() == _time(time)) & (F.col(SEQ) < seq)))


def _bucket_at(df: DataFrame, bucket, descending: bool, offset: int):
    """The bucket that holds the row at ``offset``, with the rows before it.

    One row of a small histogram comes back, whatever the size of the table.
    """
    order = F.col("bucket").desc() if descending else F.col("bucket").asc()
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return (
        counts.withColumn("upto", F.expr(
            f"sum(n) over (order by bucket {'desc' if descending else 'asc'} "
            "rows between unbounded preceding and current row)"))
        .filter(F.col("upto") > offset).orderBy(order)
        .select("bucket", "n", (F.col("upto") - F.col("n")).alias("before")).first())


def row_at(df: DataFrame, offset: int):
    """(time, seq) of the row at ``offset`` in newest-first order, None past the end.

    Only these two columns are read. A shallow offset is a top-k. A deep one descends
    through histograms of hour, second, time and blocks of ingest order, each with
    few buckets inside the bucket above it, until the rest is shallow.
    """
    keys = df.select(TIME, SEQ)
    levels = [
        *((F.floor(_when() / F.lit(size)).cast("long"), True) for size in (3_600_000_000, 1_000_000)), (_when(), True),
        *((F.shiftright(F.col(SEQ), bits), False) for bits in (40, 20, 0))]
    for bucket, descending in levels:
        if offset <= TOP_K_ROWS:
            break
        found = _bucket_at(keys, bucket, descending, offset)
        if found is None:
            return None
        keys = keys.filter(bucket == F.lit(found["bucket"]))
        offset -= found["before"]
    return newest_first(keys).offset(offset).limit(1).first()


def page(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the newest-first list.

    A negative or missing limit means no limit, a negative offset none. The keys of the
    first row and of the row behind the last one are looked up, and the page is the
    filter between them: no place gathers more than keys. ``(time, ingest_seq)`` must be
    unique, as in the store.
    """
    offset = max(offset or 0, 0)
    limit = None if limit is None or limit < 0 else limit
    kept = df
    if limit is not None:
        end = row_at(df, offset + limit)
        kept = kept if end is None else before(kept, end[TIME], end[SEQ])
    if offset:
        start = row_at(df, offset)
        kept = df.limit(0) if start is None else after(kept, start[TIME], start[SEQ], inclusive=True)
    ordered = newest_first(kept)
    return ordered.limit(limit) if limit is not None and limit <= ONE_PLACE_ROWS else ordered

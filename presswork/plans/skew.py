"""Joins on keys of which one may hold a large share of all rows.

A key is heavy when it has more than ``1 / HEAVY_KEYS`` of the rows, so there
are fewer than ``HEAVY_KEYS`` heavy keys whatever the size of the data. That is
the bound that makes broadcasting them safe. All other keys take a shuffle join,
in which no key can hold more than that small share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY_KEYS = 1000
# Groups up to this size are never worth splitting.
HEAVY_FLOOR = 1_000_000
# Places over which the rows of heavy keys are spread in the shuffle join.
SLOTS = 1024


def key_counts(rows: DataFrame, key: str) -> DataFrame:
    """Every value of ``key`` with its number of rows, ``_n``."""
    return rows.groupBy(key).agg(F.count("*").alias("_n"))


def heavy_keys(counts: DataFrame, key: str, floor: int = HEAVY_FLOOR) -> DataFrame:
    """The heavy keys of a table of key counts; fewer than ``HEAVY_KEYS`` rows."""
    total = counts.agg(F.sum("_n")).scalar()
    return counts.filter((F.col("_n") > floor) & (F.col("_n") * HEAVY_KEYS > total)).select(key)


def _tagged(rows: DataFrame, key: str, heavy: DataFrame, spread_by: str) -> DataFrame:
    """Add ``_slot``: 0 for ordinary keys, a spread value for heavy or null ones."""
    marks = F.broadcast(heavy.withColumn("_heavy", F.lit(True)))
    slot = F.pmod(F.xxhash64(spread_by), F.lit(SLOTS)).cast("int") + 1
    apart = F.col("_heavy").isNotNull() | F.col(key).isNull()
    return rows.join(marks, key, "left").withColumn("_slot", F.when(apart, slot).otherwise(0)).drop("_heavy")


def heavy_or_none(rows: DataFrame, total: int, key: str, floor: int = HEAVY_FLOOR) -> DataFrame | None:
    """The heavy keys of ``total`` materialised rows, None when there are none."""
    if total <= floor:
        return None
    heavy = heavy_keys(key_counts(rows, key), key, floor).checkpoint()
    return None if heavy.isEmpty() else heavy


def drop_matching(rows: DataFrame, keys: DataFrame, key: str, heavy: DataFrame | None, spread_by: str) -> DataFrame:
    """Rows whose ``key`` is not in ``keys``.

    Heavy keys are looked up in a broadcast set, and their rows are then spread
    over slots that match nothing, so they never meet in one task.
    """
    keys = keys.select(key)
    if heavy is None:
        return rows.join(keys, key, "left_anti")
    hot = keys.join(F.broadcast(heavy), key, "left_semi")
    cold = keys.join(F.broadcast(heavy), key, "left_anti").withColumn("_slot", F.lit(0))
    kept = rows.join(F.broadcast(hot.distinct()), key, "left_anti")
    tagged = _tagged(kept, key, heavy, spread_by)
    return tagged.join(cold, [key, "_slot"], "left_anti").drop("_slot")


def attach(rows: DataFrame, side: DataFrame, key: str, heavy: DataFrame, spread_by: str) -> DataFrame:
    """Left join with a side that has one row per key, heavy keys by broadcast."""
    columns = [c for c in side.columns if c != key]
    hot = side.join(F.broadcast(heavy), key, "left_semi")
    hot = hot.select(key, F.struct(*columns).alias("_hot"))
    cold = side.join(F.broadcast(heavy), key, "left_anti").withColumn("_slot", F.lit(0))
    cold = cold.select(key, "_slot", F.struct(*columns).alias("_cold"))
    joined = (
        _tagged(rows, key, heavy, spread_by)
        .join(F.broadcast(hot), key, "left")
        .join(cold, [key, "_slot"], "left"))
    picked = F.coalesce("_hot", "_cold")
    return joined.select(*rows.columns, *(picked[c].alias(c) for c in columns))


def attach_wide(rows: DataFrame, side: DataFrame, key: str, counts: DataFrame, spread_by: str,
                floor: int = HEAVY_FLOOR) -> DataFrame:
    """Left join with a side of wide rows, one for each key, none of which is broadcast.

    ``counts`` has the number of ``rows`` of each key, ``_n``. A heavy key is dealt over as
    many slots as it has ``floor`` rows and its side row is copied to each of them, so there
    are fewer copies than ``rows / floor``. What is broadcast are the heavy keys.
    """
    total = counts.agg(F.sum("_n")).scalar()
    heavy = counts.filter((F.col("_n") > floor) & (F.col("_n") * HEAVY_KEYS > total)).select(
        key, F.ceil(F.col("_n") / floor).cast("int").alias("_slots"))
    heavy = F.broadcast(heavy)
    slots = F.coalesce("_slots", F.lit(1))
    dealt = rows.join(heavy, key, "left").withColumn("_slot", F.pmod(F.xxhash64(spread_by), slots).cast("int")).drop("_slots")
    copies = side.join(heavy, key, "left").withColumn("_slot", F.explode(F.sequence(F.lit(0), slots - 1))).drop("_slots")
    return dealt.join(copies.hint("merge"), [key, "_slot"], "left").drop("_slot")


def attach_dealt(rows: DataFrame, side: DataFrame, key: str, heavy: list, spread_by: str) -> DataFrame:
    """Left join with a side that has one narrow row per key; ``heavy`` are the values that ``heavy_keys`` gives.

    Rows of heavy keys are spread over slots, of which each has a copy of the side row, so
    fewer than ``HEAVY_KEYS * SLOTS`` copies. The heavy values are part of the plan: it has
    one join, whether there are any or none.
    """
    hot = F.col(key).isin(heavy) if heavy else F.lit(False)
    slot = F.when(hot | F.col(key).isNull(), F.pmod(F.xxhash64(spread_by), F.lit(SLOTS)).cast("int")).otherwise(0)
    slots = F.when(hot, F.sequence(F.lit(0), F.lit(SLOTS - 1))).otherwise(F.array(F.lit(0)))
    copies = side.withColumn("_slot", F.explode(slots))
    return rows.withColumn("_slot", slot).join(copies, [key, "_slot"], "left").select(
        *(rows[c] for c in rows.columns), *(copies[c] for c in side.columns if c != key))

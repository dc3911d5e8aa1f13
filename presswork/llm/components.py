"""Connected components of a link table, by rounds of large-star and small-star.

Kiveris et al., "Connected Components in MapReduce and Beyond", SoCC 2014. Links
stay in Spark; every round ends in a reliable checkpoint, and the number of rounds
grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.session import ensure_checkpoint_dir


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links ``(a, b)``, a > b."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = (both.join(least, "a").filter((F.col("b") > F.col("a")) & (F.col("b") > F.col("m")))
             .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(least, "a")
    small = joined.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return small.unionByName(own).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``links(a, b)``; the component is its least node.

    Links may repeat, point either way or be loops; null ends are left out. An empty
    table gives an empty table.
    """
    ensure_checkpoint_dir(links.sparkSession)
    rest = (links.filter("a is not null and b is not null and a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint())
    mark = None
    while True:
        seen = rest.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
        rest = _stars(rest).checkpoint()
    nodes = rest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(rest.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

"""Links of listing pages."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presswork.functions import html as H
from presswork.functions import urls as U
from presswork.operators.extract import scope_of, with_rules
from presswork.plans import skew
from presswork.plans.rules import MAX_BROADCAST_BYTES, Site, registry_bytes
from presswork.plans.sites import SITES
from presswork.session import ensure_checkpoint_dir

# Attributes are skipped whole, so ``data-href`` or a quoted ``href=`` is no target.
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
ANCHOR_HREF = (
    rf"""(?is)<a(?:\s+(?!href\s*=)[^\s=>"']+(?:\s*=\s*{_VALUE})?+)*+\s+href\s*=\s*"""
    r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
# Above this many links per source, rows are numbered over sorted ranges.
TOP_N_PUSHDOWN = 1000
# Rows in a task that sorts.
TASK_ROWS = 1_000_000
# Rows (source, range, offset) that are broadcast.
BROADCAST_OFFSETS = 500_000


def hrefs(html: Column) -> Column:
    """Every anchor target of a page, in document order, repeats included.

    Anchors in comments, scripts and styles don't count; references are decoded.
    """
    def targets(page: Column) -> Column:
        quoted = [F.regexp_extract_all(page, F.lit(ANCHOR_HREF), group) for group in (1, 2, 3)]
        return F.transform(F.arrays_zip(*(q.alias(n) for q, n in zip(quoted, "abc"))), lambda t: H.decode_entities(
            F.concat(*(F.coalesce(t[n], F.lit("")) for n in "abc"))))

    return H.let(H.without_noise(html, ["script", "style"]), targets)


def numbered(df: DataFrame, links: Column, name: str, *keep: str) -> DataFrame:
    """One row per link with its place in the list."""
    return df.select(*keep, F.posexplode(links).alias("pos", name)).withColumn("pos", F.col("pos").cast("long"))


def absolute(links: Column, base: Column) -> Column:
    return F.transform(links, lambda h: U.absolute_link(h, base))


def filtered(links: Column, must: Column | str = "", must_not: Column | str = "") -> Column:
    """Links that match ``must`` and do not match ``must_not`` ('' checks nothing)."""
    must = F.lit(must) if isinstance(must, str) else must
    must_not = F.lit(must_not) if isinstance(must_not, str) else must_not
    return F.filter(links, lambda u: F.regexp(u, must) & ((must_not == "") | ~F.regexp(u, must_not)))


def site_links(html: Column, site: Column) -> Column:
    """Article links of a listing page by the rules of its site.

    The first item selector that occurs decides. An item is a link itself, or
    gives the target of the first link selector that has one.
    """
    page = H.without_noise(html, ["script", "style"])

    def found(item: Column) -> Column:
        tags = H.let(scope_of(page, item["pick"]), lambda scope: F.when(
            item["is_link"], H.open_tags(scope, item["pick"]["open"])
        ).otherwise(H.elements(scope, item["pick"]["open"])))
        return H.let(tags, lambda t: F.when(F.size(t) > 0, F.struct(t.alias("parts"), item["is_link"].alias("is_link"))))

    def target(part: Column) -> Column:
        def one(pick: Column) -> Column:
            tag = F.get(H.open_tags(scope_of(part, pick), pick["open"]), F.lit(0))
            return F.nullif(H.decode_entities(H.attribute(tag, "href")), F.lit(""))
        return F.aggregate(site["links"], F.lit(None).cast("string"), lambda acc, pick: F.when(
            acc.isNotNull(), acc).otherwise(one(pick)))

    def targets(items: Column) -> Column:
        return F.transform(items["parts"], lambda part: F.when(
            items["is_link"], F.nullif(H.decode_entities(H.attribute(part, "href")), F.lit(""))
        ).otherwise(target(part)))

    nothing = F.lit(None).cast("struct<parts:array<string>,is_link:boolean>")
    items = F.aggregate(site["items"], nothing, lambda acc, item: F.when(
        acc.isNotNull(), acc).otherwise(found(item)))
    raw = F.filter(F.coalesce(H.let(items, targets), F.array().cast("array<string>")), lambda u: u.isNotNull())
    wanted = filtered(raw, site["must_contain"])
    full = filtered(absolute(wanted, site["base"]), "", site["must_not_contain"])
    return H.let(full, lambda links: F.when(site["distinct_links"], F.array_distinct(links)).otherwise(links))


@lru_cache(maxsize=2)
def _site_links(_context: SparkContext | None) -> Column:
    """The link expression, built once per Spark context."""
    return site_links(F.col("html"), F.col("site"))


def listing_links(pages: DataFrame, sites: Iterable[Site] | None = None) -> DataFrame:
    """page_id, pos, source_name, link of every listing page."""
    ruled = with_rules(pages, sites)
    listed = ruled.select("page_id", "url", F.col("site")["name"].alias("name"),
                          _site_links(SparkContext._active_spark_context).alias("links"))
    named = listed.withColumn("source_name", U.source_or_domain(F.col("name"), F.col("url")))
    return numbered(named, F.col("links"), "link", "page_id", "source_name")


def first_path(links: DataFrame, wanted: DataFrame | None = None, known: DataFrame | None = None,
               heavy_floor: int = skew.HEAVY_FLOOR) -> DataFrame:
    """Links of the first listing path, per source, that has any.

    ``links``: source_name, path_rank, page_id, pos, link. Sources of ``wanted``
    without links get their ``known`` ones (source_name, pos, link) instead.
    """
    counts = links.groupBy("source_name").agg(F.min("path_rank").alias("best_rank"), F.count("*").alias("_n"))
    best = counts.drop("_n")
    ranked = skew.attach(
        links, best, "source_name", skew.heavy_keys(counts, "source_name", heavy_floor), "page_id")
    chosen = ranked.filter(F.col("path_rank") == F.col("best_rank")).select(
        "source_name", "path_rank", "page_id", "pos", "link")
    if wanted is None or known is None:
        return chosen
    missing = wanted.select("source_name").join(best, "source_name", "left_anti")
    extra = known.join(missing, "source_name", "left_semi").select(
        "source_name", F.lit(None).cast(links.schema["path_rank"].dataType).alias("path_rank"),
        F.lit(None).cast(links.schema["page_id"].dataType).alias("page_id"),
        F.col("pos").cast("long").alias("pos"), "link")
    return chosen.unionByName(extra)


def known_links(spark, sites: dict[str, Site] | None = None) -> DataFrame:
    """The fixed link lists of the sites: source_name, pos, link."""
    rows = [(s.name, pos, link) for s in (SITES if sites is None else sites).values()
            for pos, link in enumerate(s.known_links)]
    return spark.createDataFrame(rows, "source_name string, pos long, link string")


def listing_paths(spark: SparkSession, sites: Iterable[Site]) -> DataFrame:
    """host, path, source_name, path_rank: the listing paths of the sites, in the order they are tried."""
    rows, seen = [], set()
    for s in sites:
        for rank, path in enumerate(s.paths):
            # Two paths that lead to one page count as the first of them.
            if (s.key(), path.rstrip("/")) not in seen:
                seen.add((s.key(), path.rstrip("/")))
                rows.append((s.key(), path.rstrip("/"), s.name, rank))
    return spark.createDataFrame(rows, "host string, path string, source_name string, path_rank int")


def path_of(url: Column) -> Column:
    """Path of a URL without slashes at its end; null with a query, which names another page."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(~F.contains(url, F.lit("?")), F.regexp_replace(path, "/+$", ""))


def cascade(pages: DataFrame, sites: Iterable[Site] | None = None, limit: int | None = None) -> DataFrame:
    """source_name, path_rank, page_id, pos, link: article links of every site with listing paths.

    Pages at a listing path of their site are its listings. The first path on which any
    link is found counts for the site; sites without any have their known links, without
    rank and page. ``limit`` is for each site. The pages are read once; what is kept of them
    before the choice are links.
    """
    spark, sites = pages.sparkSession, list(SITES.values() if sites is None else sites)
    ensure_checkpoint_dir(spark)
    paths = listing_paths(spark, sites)
    if registry_bytes(sites) <= MAX_BROADCAST_BYTES:
        paths = F.broadcast(paths)
    at = pages.select("page_id", "url", "html", U.domain(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    listed = with_rules(at.join(paths, ["host", "path"]).drop("host", "path", "source_name"), sites)
    found = listed.select("page_id", "path_rank", F.col("site")["name"].alias("source_name"),
                          _site_links(SparkContext._active_spark_context).alias("links"))
    found = numbered(found, F.col("links"), "link", "source_name", "path_rank", "page_id").checkpoint()
    wanted = listing_paths(spark, sites).select("source_name").distinct()
    chosen = first_path(found, wanted, known_links(spark, {s.name: s for s in sites}))
    return top_n_per_source(chosen, limit, "page_id", "pos").select("source_name", "path_rank", "page_id", "pos", "link")


def top_n_per_source(links: DataFrame, n: int | None, *order: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """The first ``n`` rows of each source in the given order, numbered from 1.

    Spark cuts every map task's share of a source to ``n`` rows before the
    shuffle as long as ``n`` is small. For a larger ``n`` see ``numbered_by_source``.
    Without ``n`` rows are not numbered.
    """
    if n is None:
        return links
    if n > TOP_N_PUSHDOWN:
        return numbered_by_source(links, *order, task_rows=task_rows).filter(F.col("rn") <= n)
    by_source = Window.partitionBy("source_name").orderBy(*order)
    return links.withColumn("rn", F.row_number().over(by_source)).filter(F.col("rn") <= n)


def numbered_by_source(links: DataFrame, *order: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """``links`` with ``rn``, the place of each row in the order of its source, from 1.

    Rows are sorted by source and order over ranges of about ``task_rows`` rows at most, so
    a source is in as many tasks as it needs. A row's number is its place in its range,
    plus what the ranges before hold of its source. The ranges are written to the
    checkpoint folder, so that counting and numbering see the same ones.
    """
    spark = links.sparkSession
    ensure_checkpoint_dir(spark)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, -(-2 * links.count() // task_rows))  # ranges are cut by a sample, hence the 2
    ranged = links.repartitionByRange(ranges, "source_name", *order).sortWithinPartitions("source_name", *order)
    # The number has the range in its upper bits, the place in it in the lower 33.
    ranged = ranged.withColumn("_place", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright(F.col("_place"), 33)
    parts = ranged.groupBy("source_name", part.alias("_part")).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("source_name").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("source_name", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    offsets = offsets.withColumnRenamed("source_name", "_source").checkpoint()
    side = F.broadcast(offsets) if offsets.count() <= BROADCAST_OFFSETS else offsets
    placed = ranged.join(side, ranged["source_name"].eqNullSafe(offsets["_source"]) & (part == offsets["_part"]))
    return placed.select(*links.columns, (F.col("_place") + F.col("_shift") + 1).alias("rn"))

"""Article fields from raw pages, driven by the joined site rules.

Every function takes and returns Columns built from native expressions, so a
whole extraction is one narrow stage over the page scan: no Python per row, no
shuffle (the rules are a small broadcast side).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.functions import html as H
from presswork.functions import text as X
from presswork.functions import urls as U
from presswork.functions.ids import article_id, content_path, image_path
from presswork.plans import skew
from presswork.plans.rules import ANY_HOST, MAX_BROADCAST_BYTES, Site, registry_bytes, rules_frame
from presswork.plans.sites import OTHER_HOSTS, SITES

JSONLD = "(?s)" + H.tag_where("script", "type", *[r"application/ld\+json"] * 3) + r"(.*?)</script\s*>"


def default_sites() -> list[Site]:
    return [*SITES.values(), OTHER_HOSTS]


def with_rules(pages: DataFrame, sites: Iterable[Site] | None = None, url: str = "url") -> DataFrame:
    """Attach the ``site`` rules of each page's host; other hosts take the ``*`` row.

    A registry too large for a broadcast is joined by a shuffle, where the pages of other
    hosts, mostly the bulk of a crawl, are spread over copies of their row.
    """
    sites = list(default_sites() if sites is None else sites)
    rules, other = rules_frame(pages.sparkSession, sites), F.lit(ANY_HOST)
    hosts = rules.select("host", F.col("host").alias("_known")).filter(F.col("host") != ANY_HOST)
    if registry_bytes(sites) <= MAX_BROADCAST_BYTES:
        rules, hosts = F.broadcast(rules), F.broadcast(hosts)
    else:
        slots = F.when(F.col("host") == ANY_HOST, F.sequence(F.lit(0), F.lit(skew.SLOTS - 1))).otherwise(F.array(F.lit(-1)))
        rules = rules.withColumn("slot", F.explode(slots)).select(
            F.when(F.col("slot") < 0, F.col("host")).otherwise(F.concat(F.col("host"), F.col("slot"))).alias("host"), "site")
        other = F.concat(other, F.pmod(F.xxhash64(url), F.lit(skew.SLOTS)).cast("string"))
    keyed = pages.withColumn("host", U.domain(F.col(url))).join(hosts, "host", "left")
    keyed = keyed.withColumn("host", F.coalesce("_known", other)).drop("_known")
    return keyed.join(rules, "host").drop("host")


# -- cascades ---------------------------------------------------------------

def first_of(steps: Column, attempt: Callable[[Column], Column]) -> Column:
    """Result of the first step that is not null; later steps are not evaluated."""
    nothing = F.lit(None).cast("string")
    return F.aggregate(steps, nothing, lambda found, step: F.when(
        found.isNotNull(), found).otherwise(attempt(step)))


def scope_of(page: Column, pick: Column) -> Column:
    """The HTML below the enclosing elements of a pick ('' when there is none)."""
    return F.aggregate(pick["scopes"], page, lambda acc, scope: F.array_join(H.elements(acc, scope), ""))


def jsonld_headline(page: Column, own_names: Column | None = None) -> Column:
    """First usable headline of the JSON-LD objects; broken blocks are skipped."""
    def headline(block: Column) -> Column:
        return F.try_variant_get(F.try_parse_json(block), "$.headline", "string")

    names = F.array().cast("array<string>") if own_names is None else own_names
    found = F.transform(F.regexp_extract_all(page, F.lit(JSONLD), 1), headline)
    return F.get(F.filter(found, lambda h: X.unless_named(h, names).isNotNull()), F.lit(0))


def title_of(page: Column, raw: Column, url: Column, site: Column) -> Column:
    """Title by the site's cascade, the slug of the URL last ('' without either)."""
    def fragment(kind: Column) -> Callable[[Column], Column]:
        def pick_fragment(pick: Column) -> Column:
            tag = F.get(H.open_tags(page, pick["open"]), F.lit(0))
            element = H.first_element(scope_of(page, pick), pick["open"])
            return F.when(kind == "meta", H.attribute(tag, "content")).otherwise(element)
        return pick_fragment

    def attempt(step: Column) -> Column:
        text = X.strip(H.text_of(first_of(step["picks"], fragment(step["kind"]))))
        cut = H.let(text, lambda t: F.when(step["kind"] == "page", X.title_suffix_cut(t)).otherwise(t))
        return F.when(step["kind"] == "jsonld", jsonld_headline(raw, site["own_names"])).otherwise(
            X.unless_named(cut, site["own_names"]))

    slug = F.when(site["slug"], X.slug_title(url, site["slug_drops_html"])).otherwise("")
    return F.coalesce(first_of(site["titles"], attempt), slug)


def image_value(tag: Column, attrs: Column) -> Column:
    """First non-empty of the listed attributes; of a srcset its first URL."""
    def one(name: Column) -> Column:
        return H.let(H.decode_entities(H.attribute(tag, name)), lambda v: F.when(
            v != "", F.when(name == "srcset", U.srcset_first(v)).otherwise(v)))
    return first_of(attrs, one)


def image_of(page: Column, site: Column) -> Column:
    """Image URL by the site's cascade, the site's default last."""
    def tags(pick: Column, rule: Column) -> Column:
        def found(scope: Column) -> Column:
            tags_ = H.open_tags(scope, pick["open"])
            picked = F.when(rule["in_scope"], scope != "").otherwise(F.size(tags_) > 0)
            return F.when(picked, tags_)
        return H.let(scope_of(page, pick), found)

    def candidates(rule: Column) -> Column:
        none = F.lit(None).cast("array<string>")
        found = F.aggregate(rule["picks"], none, lambda acc, pick: F.when(
            acc.isNotNull(), acc).otherwise(tags(pick, rule)))
        return F.when(rule["every"], found).otherwise(F.slice(found, 1, 1))

    def attempt(rule: Column) -> Column:
        values = F.transform(candidates(rule), lambda tag: image_value(tag, rule["attrs"]))
        good = F.filter(values, lambda v: (
            F.regexp(v, rule["accept"])
            & ((rule["reject"] == "") | ~F.regexp(F.lower(v), rule["reject"]))))
        return H.let(F.get(good, F.lit(0)), lambda v: (
            F.when(site["images_absolute"], U.absolute_image(v, site["base"]))
            .when(rule["add_https"], U.with_https(v)).otherwise(v)))

    return F.coalesce(first_of(site["images"], attempt), site["default_image"])


# -- bodies -----------------------------------------------------------------

def without_site_noise(page: Column, site: Column) -> Column:
    """A container without the noise of its site; what surrounds it may look like noise."""
    bare = F.regexp_replace(page, site["noise_tags"], F.lit(""))
    return F.aggregate(site["noise"], bare, lambda acc, n: H.without_elements(acc, n["open"], n["tag"]))


def container(page: Column, picks: Column) -> Column:
    """Inner HTML of the first container that occurs (picks without scope)."""
    return first_of(picks, lambda pick: H.first_element(page, pick["open"]))


def paragraph_body(page: Column, site: Column) -> Column:
    """Paragraphs of the first container that has enough of them, else null or ''."""
    def attempt(pick: Column) -> Column:
        ps = H.paragraphs(without_site_noise(H.first_element(scope_of(page, pick), pick["open"]), site))
        return H.let(ps, lambda p: (
            F.when(F.size(p) >= site["min_paragraphs"], H.join_text(p))
            .when(site["one_container"] & p.isNotNull(), F.lit(""))))
    return first_of(site["containers"], attempt)


def substantial_body(page: Column, site: Column) -> Column:
    """Longer texts of headings, paragraphs and items of the wide container."""
    def texts(fragment: Column) -> Column:
        return H.join_text(H.texts_of(fragment, site["wide_open"]), site["wide_min"])
    return texts(without_site_noise(container(page, site["wide_containers"]), site))


def body_of(page: Column, site: Column) -> Column:
    found = F.nullif(paragraph_body(page, site), F.lit(""))
    return X.or_empty(F.coalesce(found, substantial_body(page, site)))


# -- articles ---------------------------------------------------------------

@lru_cache(maxsize=2)
def _field_columns(_context: SparkContext | None) -> tuple[Column, ...]:
    """The field expressions, built once per Spark context.

    They consist of some thousand calls into the JVM and depend on no page and no
    rule: the rules are a column.
    """
    url, site, page = F.col("url"), F.col("site"), F.col("page")
    return (
        F.when(site["name"] != "", site["name"]).otherwise(U.domain(url)).alias("source_name"),
        site["names_itself"].alias("names_itself"), site["gated"].alias("gated"),
        title_of(page, F.col("html"), url, site).alias("raw_title"),
        image_of(page, site).alias("image_url"),
        body_of(page, site).alias("raw_body"),
        F.col("html").isNull().alias("missing"))


def fields(pages: DataFrame, sites: Iterable[Site] | None = None) -> DataFrame:
    """page_id, url, source name and the raw title, image and body of each page.

    Two steps, so that the cleaned page is computed once and the page itself is
    dropped as soon as its fields are known.
    """
    cleaned = with_rules(pages, sites).select(
        "page_id", "url", "site", "html",
        H.without_noise(F.col("html"), ["script", "style"]).alias("page"))
    return cleaned.select("page_id", "url", *_field_columns(SparkContext._active_spark_context))


def records(pages: DataFrame, sites: Iterable[Site] | None = None) -> DataFrame:
    """One row per page with the article fields and a ``reason`` when rejected."""
    return _records(fields(pages, sites))


def _decided(pages: DataFrame, sites: Iterable[Site] | None, wanted: Column) -> DataFrame:
    """The records that meet a condition on their reason.

    Spark pushes a condition down to the pages, with a copy of the title and of the image
    for every place where it uses them, so they would be worked out several times. It
    doesn't push one that uses a number of the row.
    """
    numbered = fields(pages, sites).withColumn("_row", F.monotonically_increasing_id())
    return _records(numbered, "_row").filter(wanted & (F.col("_row") >= 0)).drop("_row")


def _records(found: DataFrame, *more: str) -> DataFrame:
    found = found.withColumn("title", X.clean_text(F.col("raw_title")))
    source, url = F.col("source_name"), F.col("url")
    raw_body = F.when(
        F.col("names_itself") & X.is_blank(F.col("raw_body")),
        X.site_body(source, F.col("raw_title"), url)).otherwise(F.col("raw_body"))
    bodied = found.withColumn("content", X.default_body(raw_body, F.col("title"), source, url))
    reason = (
        F.when(F.col("missing") | url.isNull(), "no page")
        .when(F.col("gated") & ~X.valid_title(F.col("raw_title")), "invalid title")
        .when(F.col("gated") & ~U.valid_image_url(F.col("image_url")), "invalid image"))
    id_ = article_id(F.col("title"), url)
    return bodied.select(
        F.col("page_id").alias("ingest_seq"), id_.alias("id"), "title", "content", "source_name",
        url.alias("source_url"), "image_url",
        image_path(id_, F.col("image_url")).alias("local_image_path"),
        content_path(id_).alias("local_content_path"), reason.alias("reason"), *more)


def articles(pages: DataFrame, sites: Iterable[Site] | None = None) -> DataFrame:
    """Accepted articles of a page table."""
    return _decided(pages, sites, F.col("reason").isNull()).drop("reason")


def rejects(pages: DataFrame, sites: Iterable[Site] | None = None) -> DataFrame:
    """page_id and reason of every page that gives no article."""
    return _decided(pages, sites, F.col("reason").isNotNull()).select(F.col("ingest_seq").alias("page_id"), "reason")


def extract_with(pages: DataFrame, rule: Callable, schema) -> DataFrame:
    """Pages through a user's pandas function, for rules no pattern can express.

    ``rule`` takes and yields batches of pages as in ``DataFrame.mapInPandas``.
    """
    return pages.mapInPandas(rule, schema)

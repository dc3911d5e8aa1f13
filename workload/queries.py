"""The registered queries: each reads whole tables below ``sf_dir``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.functions import html as H
from presswork.functions import ids
from presswork.functions import text as X
from presswork.functions import urls as U
from presswork.functions.images import image_kind, image_ok
from presswork.operators import catalog, dedup, extract, links, repair

from presswork.session import scratch_path
from presswork.sources import files
from presswork.sources.pages import read_pages, spread
from presswork.sources.seed import seed_articles
from presswork.sources.store import ArticleStore
from presswork.streaming import ingest
from workload import views as V

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Parameters that the queries share with their SQL.
PREFIX = "https://assets.example.com/"
SOURCE = "src3"
KEYWORD = "En%que"
WANTED_SITES = ["src1", "src5", "src7", "nosuch"]
HEALTH_SOURCES = [f"src{i}" for i in range(0, 40, 3)]
SITE_LINKS = 12
PAGE_LIMIT, PAGE_OFFSET, LIST_OFFSET, TOP_N = 20, 40, 100, 3
MUST, MUST_NOT = "/news/|/articles/", "/tag/|/author/"
def now() -> Column:
    return F.lit("2025-06-01 12:00:00").cast("timestamp")


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def doc_articles(spark, sf) -> DataFrame:
    return V.view(spark, sf, V.DOC_ARTICLES)


def site_articles(spark, sf) -> DataFrame:
    return V.view(spark, sf, V.SITE_ARTICLES)


def pages(spark, sf) -> DataFrame:
    return spread(read_pages(spark, f"{sf}/pages.parquet"))


def site_pages(spark, sf) -> DataFrame:
    return spread(V.view(spark, sf, V.SITE_PAGES))


def listing_pages(spark, sf) -> DataFrame:
    return V.view(spark, sf, V.LISTING_PAGES)


def page_base(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]*", 0)


def even(df: DataFrame) -> DataFrame:
    return df.filter(F.col("ingest_seq") % 2 == 0)


def odd(df: DataFrame) -> DataFrame:
    return df.filter(F.col("ingest_seq") % 2 == 1)


# -- sources ----------------------------------------------------------------

@query
def pages_scan(spark, sf):
    return read_pages(spark, f"{sf}/pages.parquet").select(
        "page_id", "url", F.length("html").cast("long").alias("n_html"))


# -- extraction -------------------------------------------------------------

@query
def page_text(spark, sf):
    page = H.without_noise(F.col("html"), ["script", "style"])
    return pages(spark, sf).select("page_id", X.squeeze(H.text_of(page)).alias("text"))


@query
def noise_removed(spark, sf):
    return pages(spark, sf).select("page_id", H.without_noise(F.col("html")).alias("html_clean"))


@query
def links_raw(spark, sf):
    return links.numbered(pages(spark, sf), links.hrefs(F.col("html")), "href", "page_id")


@query
def links_distinct(spark, sf):
    return links.numbered(pages(spark, sf), F.array_distinct(links.hrefs(F.col("html"))), "href", "page_id")


@query
def links_absolute(spark, sf):
    full = links.absolute(links.hrefs(F.col("html")), page_base(F.col("url")))
    return links.numbered(pages(spark, sf), full, "link", "page_id")


@query
def links_filtered(spark, sf):
    full = links.absolute(links.hrefs(F.col("html")), page_base(F.col("url")))
    kept = links.filtered(full, MUST, MUST_NOT)
    return listing_pages(spark, sf).select("page_id", F.explode(F.array_distinct(kept)).alias("link"))


@query
def site_listing_links(spark, sf):
    return links.listing_links(spread(V.view(spark, sf, V.SITE_LISTINGS)))


@query
def top_n_per_source(spark, sf):
    found = links.numbered(pages(spark, sf), links.hrefs(F.col("html")), "link", "page_id", "url")
    named = found.select(U.domain(F.col("url")).alias("source_name"), "page_id", "pos", "link")
    return links.top_n_per_source(named, TOP_N, "page_id", "pos").select(
        "source_name", "link", F.col("rn").cast("long").alias("rn"))


@query
def path_cascade(spark, sf):
    listed = listing_pages(spark, sf)
    source = U.domain(F.col("url")).alias("source_name")
    found = links.numbered(listed.withColumn("source_name", source), links.hrefs(F.col("html")), "link",
                           "source_name", "path_rank", "page_id")
    wanted = listed.select(source).distinct()
    known = wanted.select("source_name", F.lit(0).alias("pos"), F.concat(
        F.lit("https://"), "source_name", F.lit("/start")).alias("link"))
    return links.first_path(found, wanted, known).select("source_name", "path_rank", "link")


@query
def site_path_cascade(spark, sf):
    """Article links of the known sites by their own listing paths and known links, some for each site."""
    listed = spread(V.view(spark, sf, V.SITE_PATH_LISTINGS))
    return links.cascade(listed, limit=SITE_LINKS).select("source_name", "path_rank", "page_id", "pos", "link")


@query
def title_cascade(spark, sf):
    return extract.fields(site_pages(spark, sf)).select("page_id", F.col("raw_title").alias("title"))


@query
def jsonld_title(spark, sf):
    return site_pages(spark, sf).select("page_id", extract.jsonld_headline(F.col("html")).alias("headline"))


@query
def image_cascade(spark, sf):
    return extract.fields(site_pages(spark, sf)).select("page_id", "image_url")


@query
def body_paragraphs(spark, sf):
    page = H.without_noise(F.col("html"))
    ps = H.paragraphs(H.first_element(page, H.open_tag("article")))
    return pages(spark, sf).select("page_id", H.let(ps, lambda p: F.when(
        F.size(p) > 1, H.join_text(p)).otherwise("")).alias("body"))


@query
def body_substantial(spark, sf):
    page = H.without_noise(F.col("html"))
    texts = H.texts_of(H.first_element(page, H.open_tag("article")), H.open_tag("(?:p|h2|h3|li)"))
    return pages(spark, sf).select("page_id", H.join_text(texts, 30).alias("body"))


@query
def page_articles(spark, sf):
    return extract.articles(pages(spark, sf)).select(
        "ingest_seq", "id", "title", "content", "source_name", "source_url")


@query
def site_records(spark, sf):
    return extract.articles(site_pages(spark, sf))


@query
def extract_rejects(spark, sf):
    return extract.rejects(site_pages(spark, sf))


# -- scalar functions -------------------------------------------------------

@query
def clean_text(spark, sf):
    return doc_articles(spark, sf).select("ingest_seq", X.clean_text(F.col("content")).alias("content_clean"))


@query
def strip_controls(spark, sf):
    return site_articles(spark, sf).select("ingest_seq", X.strip_controls(F.col("content")).alias("s_clean"))


@query
def article_id(spark, sf):
    return doc_articles(spark, sf).select(
        "ingest_seq", ids.article_id(F.col("title"), F.col("source_url")).alias("id"))


@query
def record_id(spark, sf):
    return doc_articles(spark, sf).select(
        "ingest_seq", ids.record_id(F.col("scrape_timestamp"), F.col("source_url")).alias("record_id"))


@query
def url_domain(spark, sf):
    return pages(spark, sf).select("page_id", U.domain(F.col("url")).alias("domain"))


@query
def source_label(spark, sf):
    return pages(spark, sf).select("page_id", U.source_label(F.col("url")).alias("label"))


@query
def asset_paths(spark, sf):
    paths = doc_articles(spark, sf).select(
        "id", ids.image_path(F.col("id"), F.col("image_url")).alias("local_image_path"),
        ids.content_path(F.col("id")).alias("local_content_path"))
    return paths.withColumn("public_url", ids.public_url(F.col("local_image_path"), PREFIX))


@query
def image_clean_url(spark, sf):
    return doc_articles(spark, sf).select("ingest_seq", U.without_query(F.col("image_url")).alias("image_clean"))


@query
def image_ext(spark, sf):
    return site_articles(spark, sf).select("ingest_seq", U.image_suffix(X.or_empty(F.col("image_url"))).alias("ext"))


@query
def image_absolute(spark, sf):
    return doc_articles(spark, sf).select(
        "ingest_seq", U.absolute_image(F.col("image_url"), F.lit("https://www.example.com")).alias("image_abs"))


@query
def slug_title(spark, sf):
    return pages(spark, sf).select("page_id", X.slug_title(F.col("url")).alias("title"))


@query
def title_suffix_cut(spark, sf):
    return site_articles(spark, sf).select(
        "ingest_seq", X.title_suffix_cut(X.squeeze(F.col("title"))).alias("title_cut"))


@query
def preview_title(spark, sf):
    return site_articles(spark, sf).select("ingest_seq", X.preview_title(F.col("content")).alias("preview"))


@query
def default_body(spark, sf):
    return site_articles(spark, sf).select("ingest_seq", X.default_body(
        F.col("content"), X.clean_text(F.col("title")), F.col("source_name"), F.col("source_url")).alias("body"))


@query
def valid_title(spark, sf):
    return site_articles(spark, sf).select("ingest_seq", X.valid_title(F.col("title")).alias("ok"))


@query
def valid_image_url(spark, sf):
    return doc_articles(spark, sf).select("ingest_seq", U.valid_image_url(F.col("image_url")).alias("ok"))


@query
def validity_gate(spark, sf):
    return doc_articles(spark, sf).filter(
        X.valid_title(F.col("title")) & U.valid_image_url(F.col("image_url"))).select("ingest_seq", "id")


@query
def image_fetchable(spark, sf):
    return site_articles(spark, sf).select("ingest_seq", U.image_fetchable(F.col("image_url")).alias("ok"))


@query
def image_checks(spark, sf):
    content = F.unhex("signature")
    return V.view(spark, sf, V.IMAGE_BYTES).select(
        "path", image_kind(content).alias("kind"), image_ok(F.col("content_type"), content, F.col("size")).alias("ok"))


# -- catalog ----------------------------------------------------------------

@query
def site_subset(spark, sf):
    known = [f"src{i}" for i in range(20)]
    return catalog.site_subset(doc_articles(spark, sf), WANTED_SITES, known).select("source_name", "ingest_seq")


@query
def public_view(spark, sf):
    return catalog.public_view(doc_articles(spark, sf))


@query
def list_articles(spark, sf):
    return catalog.list_articles(doc_articles(spark, sf))


@query
def list_by_source(spark, sf):
    return catalog.of_source(doc_articles(spark, sf), SOURCE).select("id", "source_name")


@query
def list_by_source_ci(spark, sf):
    return catalog.of_source(doc_articles(spark, sf), SOURCE.upper(), ignore_case=True).select("id", "source_name")


@query
def list_page(spark, sf):
    return catalog.page(doc_articles(spark, sf).select("id", "ingest_seq", "scrape_timestamp"),
                        PAGE_LIMIT, PAGE_OFFSET).select("id", "ingest_seq")


@query
def list_offset(spark, sf):
    return catalog.page(doc_articles(spark, sf).select("id", "ingest_seq", "scrape_timestamp"),
                        None, LIST_OFFSET).select("id", "ingest_seq")


@query
def article_by_id(spark, sf):
    articles = doc_articles(spark, sf)
    wanted = articles.agg(F.max("id")).scalar()
    return catalog.public_view(articles.filter(F.col("id") == wanted))


@query
def search_keyword(spark, sf):
    return catalog.search(doc_articles(spark, sf), KEYWORD).select("id", "ingest_seq", "title")


@query
def count_all(spark, sf):
    return catalog.count_articles(doc_articles(spark, sf))


@query
def count_source(spark, sf):
    return catalog.count_articles(doc_articles(spark, sf), SOURCE)


@query
def distinct_sources(spark, sf):
    return catalog.sources(doc_articles(spark, sf))


@query
def count_by_source(spark, sf):
    return catalog.count_by_source(doc_articles(spark, sf))


@query
def batch_summary(spark, sf):
    batch = doc_articles(spark, sf)
    return catalog.batch_summary(batch, dedup.accepted_keys(batch))


@query
def source_health(spark, sf):
    wanted = spark.createDataFrame([(s,) for s in HEALTH_SOURCES], "source_name string")
    return catalog.source_health(doc_articles(spark, sf), wanted)


@query
def catalog_health(spark, sf):
    return catalog.catalog_health(doc_articles(spark, sf))


@query
def page_total(spark, sf):
    return catalog.page_total(doc_articles(spark, sf), PAGE_LIMIT, PAGE_OFFSET)


@query
def export_rows(spark, sf):
    filled = repair.backfill_content(V.view(spark, sf, V.BLANK_ARTICLES), V.view(spark, sf, V.SIDE_CONTENT))
    return catalog.export_view(filled)


# -- de-duplication and merging ---------------------------------------------

@query
def dedup_greedy(spark, sf):
    articles = doc_articles(spark, sf)
    return dedup.greedy_dedup(articles, None).select("ingest_seq", "id")


@query
def dedup_vs_store(spark, sf):
    articles = doc_articles(spark, sf)
    store = dedup.greedy_dedup(even(articles))
    return dedup.greedy_dedup(odd(articles), store).select("ingest_seq", "id")


@query
def dedup_chain(spark, sf):
    """Neighbouring documents share a URL or a title in turn, so every second one of a row of them is kept."""
    url = F.concat(F.lit("https://docs.example.com/"), F.expr("(doc_id + 1) div 2"))
    title = F.concat(F.lit("Part "), F.expr("doc_id div 2"))
    chain = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.col("doc_id").alias("ingest_seq"), url.alias("source_url"), title.alias("title"), F.lit("docs").alias("source_name"))
    return dedup.accepted_keys(chain)


@query
def store_two_writers(spark, sf):
    """Two writers work out their batches against the same empty store, then commit one after the other."""
    articles = doc_articles(spark, sf)
    store = ArticleStore(spark, scratch_path(spark, "store")).create()
    first, second = store.begin(even(articles)), store.begin(odd(articles), writer="other")
    first.commit()
    second.commit()
    return store.articles().select("id", "source_url")


def two_batches(spark: SparkSession, sf: str) -> tuple[ArticleStore, DataFrame, DataFrame]:
    """An empty store and two batches of documents, whose times are spread over some days."""
    articles = doc_articles(spark, sf).withColumn("scrape_timestamp", F.expr(
        "scrape_timestamp + make_interval(0, 0, 0, cast(ingest_seq % 6 as int))"))
    store = ArticleStore(spark, scratch_path(spark, "store")).create()
    return store, even(articles), odd(articles)


@query
def export_incremental(spark, sf):
    """An export by days that follows the store batch by batch, read back."""
    store, first, second = two_batches(spark, sf)
    path = scratch_path(spark, "export")
    for batch in (first, second):
        files.export_days(store, path, store.add(batch), now=now())
    return files.read_days(spark, path)


@query
def export_history(spark, sf):
    """What the history says of an export after each of two batches."""
    store, first, second = two_batches(spark, sf)
    for place, batch in enumerate((first, second)):
        store.add(batch)
        files.export(store, scratch_path(spark, f"export-{place}"), now=now())
    name = F.regexp_extract("filename", "(export-[0-9])[^/]*$", 1)
    return store.history().select("timestamp", name.alias("name"), "article_count")


@query
def envelope_round_trip(spark, sf):
    """The catalogue as one nested envelope, read back line by line."""
    path = scratch_path(spark, "envelope")
    files.write_envelope(doc_articles(spark, sf), path, now())
    return files.read_envelope_lines(spark, path).drop("pos")


@query
def corrupt_envelopes(spark, sf):
    """Envelopes of up to 200 documents, every third one broken off: the records of the others, and the broken ones."""
    path = scratch_path(spark, "envelopes")
    record = F.struct("id", "title", "content", "source_name", "source_url")
    articles = doc_articles(spark, sf).withColumn("k", F.expr("ingest_seq div 200"))
    grouped = articles.groupBy("k").agg(F.to_json(F.struct(
        F.lit("x").alias("scrape_timestamp"), F.collect_list(record).alias("articles"))).alias("value"))
    text = F.when(F.col("k") % 3 == 0, F.expr("left(value, length(value) - 5)")).otherwise(F.col("value"))
    grouped.select(text.alias("value"), "k").write.partitionBy("k").text(path)
    broken = files.corrupt_envelopes(spark, path).select(
        F.concat(F.lit("envelope "), F.regexp_extract("file", "k=([0-9]+)", 1)).alias("id"), F.lit("").alias("title"))
    return files.read_envelope(spark, path).select("id", "title").unionByName(broken)


@query
def exists_in_store(spark, sf):
    articles = doc_articles(spark, sf)
    return dedup.existing_in(odd(articles), even(articles))


@query
def merge_by_url(spark, sf):
    articles = doc_articles(spark, sf).select("ingest_seq", "source_url")
    return dedup.merge_by_url(even(articles), odd(articles))


@query
def content_backfill(spark, sf):
    return repair.backfill_content(V.view(spark, sf, V.BLANK_ARTICLES), V.view(spark, sf, V.SIDE_CONTENT)).select(
        "ingest_seq", "id", "content")


@query
def fallback_image(spark, sf):
    return repair.with_usable_image(site_articles(spark, sf)).select("ingest_seq", "image_url")


@query
def union_sources(spark, sf):
    found = extract.fields(pages(spark, sf)).select(
        "source_name", ids.article_id(X.clean_text(F.col("raw_title")), F.col("url")).alias("id"))
    return doc_articles(spark, sf).select("source_name", "id").unionByName(found)


@query
def seed_if_empty(spark, sf):
    seed = seed_articles(spark, now()).select("id")
    articles = doc_articles(spark, sf).select("id", "ingest_seq")
    return catalog.seeded(articles.select("id"), seed)


@query
def repair_images(spark, sf):
    return repair.repair_images(site_articles(spark, sf)).select("ingest_seq", "image_url", "repaired")


@query
def repair_titles(spark, sf):
    return repair.repair_titles(site_articles(spark, sf)).select("ingest_seq", "title")


# -- incremental ------------------------------------------------------------

def ingested(spark: SparkSession, sf: str) -> ArticleStore:
    """A fresh store filled from the page table by the file stream."""
    root = scratch_path(spark, "store")
    store = ArticleStore(spark, root)
    stream = ingest.page_stream(spark, f"{sf}/pages.parquet")
    running = ingest.start_ingest(store, stream, f"{root}/stream_state", once=True, now=now())
    running.awaitTermination()
    return store


@query
def stream_ingest(spark, sf):
    return ingested(spark, sf).articles().select("id", "source_url")


@query
def stream_metrics(spark, sf):
    return ingested(spark, sf).metrics().filter(F.col("total") > 0).drop("writer")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Articles of a page table, first come first served, counted by source."""
    batch = extract.articles(pages(spark, sf)).select("ingest_seq", "title", "source_name", "source_url")
    return catalog.count_by_source(dedup.greedy_dedup(batch))

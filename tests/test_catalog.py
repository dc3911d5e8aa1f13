from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from presswork.operators import catalog, links, repair
from presswork.plans import paging
from presswork.sources.seed import SEED, seed_articles
from workload import queries as Q


@pytest.fixture(scope="module")
def articles(spark, sf):
    return Q.doc_articles(spark, sf).select("ingest_seq", "id", "title", "source_name", "scrape_timestamp").cache()


def seqs(df):
    return [r["ingest_seq"] for r in df.collect()]


def expected(articles):
    rows = articles.collect()
    return [r["ingest_seq"] for r in sorted(rows, key=lambda r: (-r["scrape_timestamp"].timestamp(), r["ingest_seq"]))]


@pytest.mark.parametrize("top_k", [100_000, 3])
def test_pages(articles, monkeypatch, top_k):
    """With a tiny top-k the histogram descent does the work."""
    monkeypatch.setattr(paging, "TOP_K_ROWS", top_k)
    want = expected(articles)
    for limit, offset in ((10, 0), (10, 37), (None, 150), (-1, 5), (0, 3), (7, -4), (10, 195), (5, 200), (None, 500)):
        n = None if limit is None or limit < 0 else limit
        start = max(offset, 0)
        assert seqs(catalog.list_articles(articles, limit, offset)) == want[start:None if n is None else start + n]


def test_pages_join_to_the_list(articles):
    want = expected(articles)
    got = [s for at in range(0, 200, 33) for s in seqs(paging.page(articles, 33, at))]
    assert got == want
    last = articles.filter(F.col("ingest_seq") == want[49]).first()
    assert seqs(paging.newest_first(paging.after(articles, last["scrape_timestamp"], last["ingest_seq"])))[:20] == want[50:70]


def test_source_filters(articles):
    assert catalog.of_source(articles, None).count() == 200
    assert catalog.of_source(articles, "SRC3").count() == 0
    assert catalog.of_source(articles, "SRC3", ignore_case=True).count() == 10
    assert catalog.article_by_id(articles, "nope").count() == 0
    with pytest.raises(ValueError):
        catalog.site_subset(articles, ["x"], ["src1"])
    assert catalog.site_subset(articles, ["x", "src1"], ["src1"]).count() == 10


WORDS = ["é", "É", "a%c", "_b", "\\", "AB", "a_c", "%", "c\nd", ".", "a%b%d"]


def test_search_equals_like(spark):
    texts = ["Été", "éCOLE", "abc", "a\\b", None, "c\nd", "x%y", "A.B", "ab ab cd", ""]
    db = sqlite3.connect(":memory:")
    db.execute("create table t (i integer, c text)")
    db.executemany("insert into t values (?, ?)", list(enumerate(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    for word in WORDS:
        want = [r[0] for r in db.execute("select i from t where c like ? order by i", (f"%{word}%",))]
        got = [r[0] for r in df.filter(catalog.matches_keyword(word, F.col("c"))).orderBy("i").collect()]
        assert got == want, word
    with pytest.raises(ValueError):
        catalog.search(df, "")


def test_seed_only_when_empty(spark, articles):
    seed = seed_articles(spark, Q.now()).select("id")
    assert catalog.seeded(articles.select("id"), seed).count() == 200
    assert catalog.seeded(articles.select("id").limit(0), seed).count() == len(SEED)
    assert all(r["local_content_path"] for r in seed_articles(spark, Q.now()).collect())


def test_backfill_with_heavy_id(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"i{i}", " " if i % 2 == 0 else "own", f"u{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "ingest_seq long, id string, content string, source_url string")
    side = spark.createDataFrame([("hot", "HOT"), ("i2", "two"), ("i4", "\n")], "id string, content string")
    for floor in (3, 10**6):
        got = {r["ingest_seq"]: r["content"] for r in repair.backfill_content(df, side, floor).collect()}
        for seq, id_, own, url in rows:
            want = own if own.strip() else {"hot": "HOT", "i2": "two"}.get(
                id_, f"Visit the source for more information: {url}")
            assert got[seq] == want


def test_first_path_and_top_n(spark):
    rows = [("s", 1, 1, 0, "b"), ("s", 0, 2, 0, "a"), ("s", 0, 2, 1, "a2"), ("t", 2, 3, 0, "c")]
    found = spark.createDataFrame(rows, "source_name string, path_rank int, page_id long, pos long, link string")
    wanted = spark.createDataFrame([("s",), ("u",)], "source_name string")
    known = spark.createDataFrame([("u", 0, "k0"), ("u", 1, "k1"), ("s", 0, "no")], "source_name string, pos int, link string")
    for floor in (0, 10**6):
        got = links.first_path(found, wanted, known, floor)
        assert sorted(r["link"] for r in got.collect()) == ["a", "a2", "c", "k0", "k1"]
    for n in (1, 5000):
        top = links.top_n_per_source(found, n, "path_rank", "pos")
        assert top.count() == (2 if n == 1 else 4)
    assert links.top_n_per_source(found, None, "pos").count() == 4
    assert links.known_links(spark).count() == 30


def test_plans(articles, spark, sf):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan(paging.page(articles, 10, 5))
    extraction = plan(Q.REGISTRY["page_articles"](spark, sf))
    assert "Python" not in extraction and "BroadcastHashJoin" in extraction
    scan = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("source", "source_name")
    pruned = plan(catalog.count_articles(scan, "src1"))
    assert "EqualTo(source,src1)" in pruned and "text" not in pruned.split("ReadSchema")[1]


def test_pages_with_missing_and_equal_times(spark, monkeypatch):
    """Rows without a time come last on every page, however the rows are found."""
    from presswork.plans import paging

    times = [None, "2025-01-01 00:00:00", "2025-01-02 00:00:00", None, "2025-01-02 00:00:00", None, "2025-01-01 10:00:00",
             "2025-01-02 00:00:00.5"]
    df = spark.createDataFrame(list(enumerate(times)), "ingest_seq long, t string").selectExpr(
        "ingest_seq", "cast(t as timestamp) as scrape_timestamp")
    want = [7, 2, 4, 6, 1, 0, 3, 5]
    for most in (100_000, 0):
        monkeypatch.setattr(paging, "TOP_K_ROWS", most)
        for limit, offset in ((100, 2), (None, 2), (4, 2), (2, 5), (3, 0), (None, 0), (2, 8), (0, 1)):
            got = [r.ingest_seq for r in paging.page(df, limit, offset).collect()]
            assert got == want[offset:][:limit], (most, limit, offset)


def test_listing_cascade(spark):
    """First path with a link, by the site's own order; slashes count nothing, queries are other pages."""
    from presswork.plans.rules import Site
    sites = [Site(name="A", base="https://www.a.example", paths=("/news", "/", "", "/more"), items=("a",), known_links=("https://k/1",)),
             Site(name="B", base="https://b.example", paths=("/x",), items=("a",), known_links=("https://k/2", "https://k/3")),
             Site(name="C", base="https://c.example", items=("a",), paths=("/c",))]
    page = "<a href='/{0}-1'>x</a><a href='/{0}-2'>y</a><a href='/{0}-1'>x</a>"
    rows = [(1, "https://a.example/news/", "<p>no link</p>"), (2, "https://www.a.example", page.format("root")),
            (3, "https://a.example/more", page.format("more")), (4, "https://a.example/news?page=2", page.format("q")),
            (5, "https://b.example/other", page.format("o")), (6, "https://b.example/x", None), (7, None, page.format("n")),
            (8, "https://z.example/news", page.format("z"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, links.cascade(pages, sites).select("source_name", "path_rank", "page_id", "link").collect()), key=str)
    assert got == [("A", 1, 2, "https://www.a.example/root-1"), ("A", 1, 2, "https://www.a.example/root-2"),
                   ("B", None, None, "https://k/2"), ("B", None, None, "https://k/3")]
    assert [r.link for r in links.cascade(pages, sites, 1).orderBy("source_name").collect()] == ["https://www.a.example/root-1", "https://k/2"]
    assert links.cascade(pages.filter("false"), sites).count() == 3


def test_numbering_over_ranges(spark):
    """A million links of one source are numbered without a task of more than a hundredth of them."""
    n = 1_000_000
    links_ = spark.range(n + 1000).select(
        F.when(F.col("id") < n, "hot").when(F.col("id") < n + 900, F.concat(F.lit("s"), F.col("id") % 7)).alias("source_name"),
        (F.col("id") * 7919 % 1_000_003).alias("pos"), F.col("id").alias("link"))
    got = links.top_n_per_source(links_, n, "pos", task_rows=n // 100)
    sizes = got.groupBy(F.spark_partition_id().alias("p")).count()
    assert sizes.agg(F.max("count")).first()[0] <= n // 100
    want = links_.withColumn("want", F.row_number().over(Window.partitionBy("source_name").orderBy("pos")))
    both = got.join(want.select("link", "want"), "link")
    assert both.filter("rn = want").count() == n + 1000
    cut = links.top_n_per_source(links_, 1500, "pos", task_rows=50_000)
    assert {r.source_name: r["count"] for r in cut.groupBy("source_name").count().collect()}["hot"] == 1500
    assert cut.agg(F.max("rn")).first()[0] == 1500
    assert links.top_n_per_source(links_.filter("false"), 5000, "pos").count() == 0


@pytest.mark.parametrize("floor", [3, 10 ** 6])
def test_texts_are_never_broadcast(spark, floor):
    """Side texts reach the articles by a shuffle, also those of an id that many rows have."""
    articles = spark.range(60).select(
        F.col("id").alias("ingest_seq"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("a"), "id")).alias("id"),
        F.when(F.col("id") % 5 == 0, "own").alias("content"), F.lit("u").alias("source_url"))
    side = spark.createDataFrame([("hot", "warm"), ("hot", "text"), ("a1", "one"), ("a3", ""), ("zz", "no")], "id string, content string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        filled = repair.content_from(articles, side, floor)
        rows = filled.collect()
        plan = filled._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == 60
    assert {r.content for r in rows if r.id == "hot" and r.ingest_seq % 5} == {"warm"}
    assert {r.content for r in rows if r.id == "a1"} == {"one"}
    # What goes into a broadcast has no text in it.
    blocks = plan.split("BroadcastExchange")[1:]
    assert blocks and not any("content" in line or "_side" in line for block in blocks for line in block.splitlines()[:1])
    assert "BroadcastHashJoin [id" in plan and "SortMergeJoin [id" in plan

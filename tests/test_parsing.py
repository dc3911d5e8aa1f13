"""Anchors and text as a parser reads them; the expected values are written by hand."""

import time

import pytest
from pyspark.sql import functions as F

from presswork.functions import html as H
from presswork.operators import extract, links

PAGE = """<a data-href="/no" href="/yes">x</a><a href='/single'><a class=b HREF = /bare?a=1&amp;b=2 id=z>
<!-- <a href="/comment"> --><script>"<a href='/script'>"</script><a title="href=/q" href="">e</a>
<abbr href="/abbr"><a name="n">none</a><a
href="/line">"""


def test_anchors(spark):
    df = spark.createDataFrame([(PAGE,)], "html string")
    assert df.select(links.hrefs(F.col("html"))).first()[0] == ["/yes", "/single", "/bare?a=1&b=2", "", "/line"]


def test_texts(spark):
    want = {
        "if a < b and c > d": "if a < b and c > d",
        "&copy 2024 &#00000065; &amp;lt; &lt;x&gt;": "© 2024 A &lt; <x>",
        "&bogus; AT&T R&D &#99999999999999999999999;": "&bogus; AT&T R&D &#99999999999999999999999;",
        "&#x0000000041;&eacute;&frac12 <3 a &amp b <b>x</b>": "Aé½ <3 a & b x"}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r.t: r.x for r in df.select("t", H.text_of(F.col("t")).alias("x")).collect()} == want


def test_wrapper_that_looks_like_noise(spark):
    page = ('<div class="page-loaded"><div class="article-body"><p>First para.</p><div class="ad-wrap"><p>ad</p></div>'
            "<p>Second para.</p></div></div>")
    pages = spark.createDataFrame([(1, "https://www.gamespot.com/articles/x/", page)], "page_id long, url string, html string")
    assert extract.fields(pages).first()["raw_body"] == "First para. Second para."


def test_large_registry(spark, monkeypatch):
    """Rules joined by a shuffle give every page the same site as those that are broadcast."""
    urls = ["https://www.gamespot.com/a", "https://kotaku.com/b", "https://other.example/c", "https://more.example/d", None]
    pages = spark.createDataFrame([(i, u, "<p>x") for i, u in enumerate(urls)], "page_id long, url string, html string")
    want = sorted(extract.with_rules(pages).select("page_id", "site.name").collect())
    monkeypatch.setattr(extract, "MAX_BROADCAST_BYTES", 0)
    assert sorted(extract.with_rules(pages).select("page_id", "site.name").collect()) == want and len(want) == len(urls)


@pytest.mark.parametrize("tag, found", [
    ('<div data-x="a > b" class="article-body">', True), ("<div class=article-body>", True),
    ("<div class='x article-body y' id=3>", True), ('<div data-k="class=article-body">', False),
    ("""<div title="it's" class=article-body >""", True), ('<div class="article-bodyx">', False),
    ('<DIV CLASS = "article-body" >', True), ("""<div it's class="article-body">""", True),
    ('<div title="open class=article-body>', True), ('<div data-class="article-body">', False),
    ('<div a="1"class="article-body">', True), ('<div class="other" class="article-body">', False),
    ('<divx class="article-body">', False), ("<div\n\tclass\n=\n'article-body'\n>", True)])
def test_attributes_of_any_quoting(spark, tag, found):
    pattern = H.open_tag("div", "class", "word", "article-body")
    row = spark.createDataFrame([(tag + "in <b title='>'>bold</b></div>",)], "h string").select(
        F.size(H.open_tags(F.col("h"), pattern)).alias("n"), H.first_element(F.col("h"), pattern).alias("inner"),
        H.text_of(F.col("h")).alias("text")).first()
    assert (row.n, row.inner is not None, row.text) == (int(found), found, "in bold")


def test_attribute_values(spark):
    cases = [('<img alt="look src=fake.png here" src="real.png">', "real.png"), ("<img src=a.png/>", "a.png/"),
             ("<img data-src=x src='y'>", "y"), ("<img src>", ""), ("<img>", ""), (None, None), ('<img src="" src="b">', ""),
             ('<img srcset="a" SRC="b">', "b")]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select(
        "i", H.attribute(F.col("t"), "src").alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [v for _, v in cases]


def test_a_minified_page(spark):
    page = ("<html><h1>Big news today</h1><img class=article-image src=https://cdn.example.com/a.jpg>"
            "<div data-x='1 > 0' class=article-body><p>One long paragraph.<p>Two<div class=related>no</div></div></html>")
    pages = spark.createDataFrame([(1, "https://www.gamespot.com/articles/x", page)], "page_id long, url string, html string")
    row = extract.records(pages).first()
    assert (row.reason, row.title, row.image_url) == (None, "Big news today", "https://cdn.example.com/a.jpg")
    assert row.content.startswith("One long paragraph. Two")


def test_time_follows_the_tags(spark):
    """Four times the tags take about four times as long, for noise, nested elements and open paragraphs."""
    noise, deep = H.open_tag("div", "class", "word", "ad"), H.open_tag("div", "class", "word", "a")
    took = {}
    for n in (16_000, 64_000):
        pages = ["<div class='ad'>x</div><div>y</div>" * (n // 4), "<p>a<p>b" * (n // 2),
                 "<div class=ad>" + "<div class=a>" * (n // 2 - 1) + "</div>" * (n // 2) + "end"]
        jobs = [F.length(H.without_elements(F.col("h"), F.lit(noise), F.lit("div"))),
                F.size(H.texts_of(F.col("h"), H.open_tag("(?:p|h2|h3|li)"))),
                F.concat(H.without_elements(F.col("h"), F.lit(noise), F.lit("div")), F.substring(H.first_element(F.col("h"), deep), 1, 5))]
        for i, (page, job) in enumerate(zip(pages, jobs)):
            df = spark.createDataFrame([(page,)], "h string").select(job.alias("out"))
            times = []
            for _ in range(3):
                start = time.perf_counter()
                out = df.first().out
                times.append(time.perf_counter() - start)
            took[i, n] = min(times)
        assert out.strip().startswith("end")
    for i in range(3):
        assert took[i, 64_000] < 5 * took[i, 16_000] + 0.5

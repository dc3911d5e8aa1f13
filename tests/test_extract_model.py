"""Extraction and links of all sites against a plain DOM reading of the rules."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from presswork.operators import extract, links
from presswork.plans.sites import OTHER_HOSTS, SITES
from presswork.sources import pages as pages_module
from tests import dom
from workload import views as V

BY_HOST = {s.key(): s for s in SITES.values()}


def site_for(url):
    host = re.sub(r"^www\.", "", re.match(r"(?:[a-z]+:)?//([^/?#]*)", url).group(1))
    return BY_HOST.get(host, OTHER_HOSTS)


def css(selector):
    return "div[class*='body']" if selector.startswith("(?") else selector


def slug(url, drop_html):
    last = url.rstrip("/").split("/")[-1].replace("-", " ")
    if drop_html:
        last = last.replace(".html", "")
    return " ".join(w.capitalize() for w in last.split())


def model_title(root, html, url, site):
    def usable(text):
        return text != "" and text.lower() not in site.own_names

    for step in site.titles:
        node = next((n for n in (dom.first(root, css(p)) for p in step.picks) if n is not None), None)
        if step.kind == "jsonld":
            for block in re.findall(r'(?s)<script type="application/ld\+json">(.*?)</script>', html):
                try:
                    data = json.loads(block)
                except ValueError:
                    continue
                if isinstance(data, dict) and usable(data.get("headline") or ""):
                    return data["headline"]
            continue
        if node is None:
            continue
        text = (node.attrs.get("content") or "") if step.kind == "meta" else node.text()
        text = text.strip()
        if step.kind == "page":
            text = text.split(" - ")[0].strip()
        if usable(text):
            return text
    return slug(url, site.slug_drops_html) if site.slug else ""


def model_image(root, site):
    for rule in site.images:
        nodes = []
        for pick in rule.picks:
            nodes = dom.select(root, pick)
            if nodes or (rule.in_scope and dom.first(root, pick.rsplit(" ", 1)[0]) is not None):
                break
        for node in nodes if rule.every else nodes[:1]:
            value = ""
            for attr in rule.attrs:
                value = node.attrs.get(attr) or ""
                value = value.split(" ")[0] if attr == "srcset" else value
                if value:
                    break
            if not value or not re.search(rule.accept, value):
                continue
            if rule.reject and re.search(rule.reject, value.lower()):
                continue
            if site.images_absolute and not value.startswith(("http://", "https://")):
                return site.base + value if value.startswith("/") else f"{site.base}/{value}"
            return "https:" + value if rule.add_https and value.startswith("//") else value
    return site.default_image


def without_noise(box, site):
    for noise in site.noise:
        dom.drop(box, noise)
    return box


def model_body(root, site):
    for pick in site.containers:
        box = dom.first(root, css(pick))
        if box is None:
            continue
        without_noise(box, site)
        ps = [p.text().strip() for p in dom.select(box, "p")]
        if len(ps) >= site.min_paragraphs:
            body = " ".join(p for p in ps if p)
            if body:
                return body
            break
        if site.one_container:
            break
    box = next((n for n in (dom.first(root, css(p)) for p in site.wide_containers) if n is not None), None)
    if box is None:
        return ""
    without_noise(box, site)
    tags = site.wide_tags.split("|")
    texts = [n.text().strip() for n in box.walk() if n.tag in tags]
    return " ".join(t for t in texts if len(t) > site.wide_min)


def model_links(root, site):
    items, is_link = [], False
    for selector in site.items:
        items = dom.select(root, selector)
        if items:
            is_link = bool(re.match(r"a\b", selector.split(" ")[-1]))
            break
    out = []
    for item in items:
        href = None
        if is_link:
            href = item.attrs.get("href")
        else:
            for selector in site.links:
                node = dom.first(item, selector)
                if node is not None and node.attrs.get("href"):
                    href = node.attrs["href"]
                    break
        if not href or not re.search(site.must_contain, href):
            continue
        url = href if href.startswith("http") else site.base + href
        if site.must_not_contain and re.search(site.must_not_contain, url):
            continue
        if site.distinct_links and url in out:
            continue
        out.append(url)
    return out


def squeeze(text):
    return " ".join(text.split())


@pytest.mark.parametrize("text", [V.SITE_PAGES, "select page_id, url, html from {pages}"], ids=["sites", "others"])
def test_fields_equal_dom_model(spark, sf, text):
    pages = V.view(spark, sf, text)
    got = {r["page_id"]: r for r in extract.fields(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for row in rows:
        site = site_for(row["url"])
        found = got[row["page_id"]]
        where = (site.name, row["page_id"])
        root = dom.parse(row["html"])
        assert squeeze(found["raw_title"]) == squeeze(model_title(root, row["html"], row["url"], site)), where
        assert found["image_url"] == model_image(root, site), where
        assert squeeze(found["raw_body"]) == squeeze(model_body(root, site)), where


def test_listing_links_equal_dom_model(spark, sf):
    listings = V.view(spark, sf, V.SITE_LISTINGS)
    got = {}
    for r in links.listing_links(listings).orderBy("page_id", "pos").collect():
        got.setdefault(r["page_id"], []).append(r["link"])
    for row in listings.collect():
        want = model_links(dom.parse(row["html"]), site_for(row["url"]))
        assert got.get(row["page_id"], []) == want, (row["url"], row["page_id"])
    assert sum(map(len, got.values())) > 50


def test_every_page_as_every_site(spark, sf):
    """All containers and headings of the fixture against all rule sets."""
    hosts = " union all ".join(
        f"select page_id * 100 + {i} as page_id, '{s.base}/x-y' as url, html from ({V.SITE_PAGES}) where page_id < 24"
        for i, s in enumerate(SITES.values()))
    test_fields_equal_dom_model(spark, sf, hosts)


def test_tasks_are_bounded_by_pages(spark, monkeypatch):
    """A table in enough splits, one of them large, is dealt again; one in small splits is left."""
    monkeypatch.setattr(pages_module, "TASK_PAGES", 50, raising=False)
    cores = spark.sparkContext.defaultParallelism
    small = spark.range(0, 40 * cores, 1, cores).withColumn("html", F.lit("x"))
    assert pages_module.spread(small).rdd.getNumPartitions() == cores
    uneven = small.unionByName(spark.range(1000, 2000, 1, 1).withColumn("html", F.lit("x")))
    dealt = pages_module.spread(uneven)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 40 * cores + 1000 and max(sizes) < 75
    assert sorted(r.id for r in dealt.collect()) == sorted(r.id for r in uneven.collect())
    assert pages_module.spread(small.limit(0)).count() == 0


@pytest.mark.parametrize("kept", [extract.articles, extract.rejects])
def test_fields_are_worked_out_once(spark, kept):
    """The condition on the reason stays above the fields; below, it would work them out again."""
    pages = spark.createDataFrame([(1, "https://www.ign.com/articles/a", "<h1>A title</h1>"), (2, None, None), (None, "u", "")],
                                  "page_id long, url string, html string")
    number = "ingest_seq" if kept is extract.articles else "page_id"
    plan = kept(pages).select(number)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(".titles, null") == 1 and plan.count(".images, null") == 1
    got = sorted((r[0] is None, r[0]) for r in kept(pages).collect())
    records = extract.records(pages).collect()
    assert got == sorted((r["ingest_seq"] is None, r["ingest_seq"]) for r in records if (r["reason"] is None) == (kept is extract.articles))

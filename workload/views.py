"""Views over the given tables, as SQL text that Spark and DuckDB both run.

``documents`` and ``pages`` are placeholders; each view grows with its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from presswork.plans.sites import SITES

_DOCS = """
select doc_id as ingest_seq,
  split_part(text, chr(10), 1) as title,
  @CONTENT@ as content,
  source as source_name,
  concat('https://docs.example.com/', md5(text)) as source_url,
  case doc_id % 7 when 0 then '' when 1 then 'data:image/png;base64,AAAA' when 2 then '/media/pic.png'
    when 3 then 'https://cdn.example.com/Site-Logo.svg' when 4 then 'https://cdn.example.com/a/photo.JPEG?w=90'
    when 5 then 'HTTP://cdn.example.com/p.png' end as image_url,
  md5(concat(split_part(text, chr(10), 1), 'https://docs.example.com/', md5(text))) as id,
  timestamp '2025-01-01 00:00:00' + doc_id % 50 * interval 1 minute as scrape_timestamp
from {documents}
"""
DOC_ARTICLES = _DOCS.replace("@CONTENT@", "text")
# The same with blank contents among them, for what fills them.
BLANK_ARTICLES = _DOCS.replace("@CONTENT@", "case when doc_id % 5 = 0 then '' else text end")

# One content per id: equal ids have equal URLs and hence equal texts.
SIDE_CONTENT = """
select id, content from (
  select md5(concat(split_part(text, chr(10), 1), 'https://docs.example.com/', md5(text))) as id,
    text as content
  from {documents} where doc_id % 10 = 0)
group by id, content
"""

# Articles of known sources, with generic titles, missing URLs and odd texts. Every
# document stands with its whole text; those of two in ten ids have a second row, whose
# content is blank or short.
SITE_ARTICLES = """
select case when short_ then -doc_id - 1 else doc_id end as ingest_seq,
  case when doc_id % 13 = 7 and doc_id % 4 = 0 then 'TheGamer' when doc_id % 13 = 7 and doc_id % 4 = 1 then 'The Gamer'
    when doc_id % 4 = 2 then concat(' ', split_part(text, chr(10), 1), chr(9), '- Site - ', cast(doc_id as varchar(20)), ' ')
    when doc_id % 9 = 0 then ' UNTITLED ' else split_part(text, chr(10), 1) end as title,
  case when short_ then case when doc_id % 11 = 0 then substring(text, 1, 50) else '' end
    when doc_id % 11 = 2 then concat(text, chr(1), chr(127), chr(92), text) else text end as content,
  case doc_id % 13 when 0 then 'IGN' when 1 then 'GameSpot' when 2 then 'PCGamer' when 3 then 'Eurogamer'
    when 4 then 'Polygon' when 5 then 'Kotaku' when 6 then 'GameRant' when 7 then 'TheGamer' when 8 then 'WCCFTech'
    when 9 then 'Engadget' else source end as source_name,
  case when doc_id % 6 = 0 then '' else concat('https://docs.example.com/',
    case when doc_id % 5 = 0 then 'video' else 'read' end, '/part-', cast(doc_id % 4 as varchar(20)), '-of--',
    substring(md5(text), 1, 8), case when doc_id % 2 = 0 then '/' else '' end) end as source_url,
  case doc_id % 7 when 0 then '' when 1 then 'https://cdn.example.com/author/me.png'
    when 2 then 'https://cdn.example.com/icon-set/pic.png?x=1' when 3 then 'https://cdn.example.com/Site-Logo.svg'
    when 4 then 'https://cdn.example.com/a/photo.JPEG?w=90' when 5 then 'https://cdn.example.com/p.tar.webp' end as image_url,
  md5(text) as id
from (
  select doc_id, text, source, false as short_ from {documents}
  union all select doc_id, text, source, true as short_ from {documents} where doc_id % 10 < 2)
"""

SITE_BASES = [
    "https://www.ign.com", "https://www.pcgamer.com", "https://www.gamespot.com", "https://www.eurogamer.net",
    "https://gamerant.com", "https://www.polygon.com", "https://kotaku.com", "https://wccftech.com",
    "https://www.thegamer.com", "https://www.engadget.com",
]
_BASE = "case page_id % 10 " + " ".join(f"when {i} then '{b}'" for i, b in enumerate(SITE_BASES)) + " end"
_ID = "cast(page_id as varchar(20))"

# Pages of the known sites: every page gets head tags, an image block, a heading
# and a container by its number, so that all steps of the cascades occur.
SITE_PAGES = f"""
select page_id,
  concat({_BASE}, case page_id % 3 when 0 then '/articles/a-new-story-' when 1 then '/news/some-other-tale-'
    else '/video/clip-' end, {_ID}, case page_id % 4 when 0 then '/' when 1 then '.html' else '' end) as url,
  replace(replace(replace(replace(replace(replace(html,
    '</head>', concat(case page_id % 7
      when 0 then concat('<meta property="og:title" content="Og story ', {_ID}, ' &amp; more">')
      when 1 then concat('<meta name="twitter:title" content="Tw story ', {_ID}, '">')
      when 2 then concat('<meta property="og:title" content="The Gamer"><meta property="og:image" content="https://cdn.example.com/og/', {_ID}, '.jpg">')
      when 3 then '<meta property="og:image" content="https://cdn.example.com/site-logo.png">'
      when 4 then concat('<script type="application/ld+json">{{{{"headline": "Ld story ', {_ID}, '", "n": 1}}}}</script>')
      when 5 then '<script type="application/ld+json">[{{{{"headline": "no"}}}}]</script><script type="application/ld+json">{{{{"headline": </script>'
      else '' end, '</head>')),
    '<title>', case when page_id % 9 = 8 then '<title>TheGamer - ' else '<title>' end),
    '</h1>', case when page_id % 3 = 2 then '</h2>' else '</h1>' end),
    '<h1>', case page_id % 3 when 0 then '<h1 class="article-title display-title sc-1efpnfq-0">' when 1 then '<h1>' else '<h2>' end),
    '</article>', case when page_id % 5 in (2, 3) then '</article>' else '</div>' end),
    '<article>', concat(case page_id % 8
      when 0 then concat('<picture><source srcset="https://cdn.example.com/s/', {_ID}, '.webp 2x, b"><img data-src="https://cdn.example.com/p/', {_ID}, '.jpg" src="x.gif"></picture>')
      when 1 then concat('<div class="featured-image"><div><img src="https://cdn.example.com/f/', {_ID}, '.png?w=1"></div></div>')
      when 2 then concat('<img src="/uploads/', {_ID}, '.jpg">')
      when 3 then concat('<img src="https://cdn.example.com/Site-Logo.svg"><img data-lazy-src="https://cdn.example.com/wp-content/uploads/', {_ID}, '.webp">')
      when 4 then '<img src="data:image/png;base64,AAAA">'
      when 5 then concat('<div class="article-header"><img srcset="https://cdn.example.com/h/', {_ID}, '.jpg 1x" alt="a"></div>')
      when 6 then concat('<img src="//cdn.example.com/n/', {_ID}, '.png"><img src="https://cdn.example.com/author/', {_ID}, '.jpg?w=90">')
      else '' end,
      case page_id % 5
      when 0 then '<div class="article-body article-content"><div class="ad-wrap comments">Noise <div>deep</div> <p>noise p</p></div>'
      when 1 then '<div id="article-body">'
      when 2 then '<article><div class="social"><p>Share this</p></div>'
      when 3 then '<article>'
      else '<div class="sc-r43lxo-1 entry-content">' end)) as html
from {{pages}}
"""

# Listing pages: the navigation links of a page under four kinds of paths.
LISTING_PAGES = """
select page_id, url, cast(page_id % 4 as int) as path_rank,
  case page_id % 4 when 0 then replace(html, '<a href="/', '<span title="/')
    when 1 then replace(html, '<a href="/', '<a href="/news/')
    when 2 then replace(html, '<a href="/', '<a href="/news/tag/') else html end as html
from {pages}
"""

# Listing pages of the known sites: the navigation links as items of four kinds,
# with the page's own article element taken out of the way on most pages.
SITE_LISTINGS = f"""
select page_id, {_BASE} as url,
  replace(replace(
    case when page_id % 3 = 0 then html else replace(html, '<article>', '<section>') end,
    '<li><a href="/', case page_id % 4
      when 0 then '<li><div class="content-item listingResult card post o-hit"><div><h2><a class="article-link js_link card-item__link title" href="/news/'
      when 1 then '<li><article class="js_post_item browse-clip"><h3><a class="js_link" href="/articles/2024/'
      when 2 then '<li><a data-analytics-link="article" href="/tag/'
      else '<li><article class="list-item"><a href="/author/x">au</a><h2><a href="https://other.example.com/news/' end),
    '</a></li>', case page_id % 4 when 0 then '</a></h2></div></div></li>' when 1 then '</a></h3></article></li>'
      when 2 then '</a></li>' else '</a></h2></article></li>' end) as html
from {{pages}}
"""

_PATHS = [site.paths for base in SITE_BASES for site in SITES.values() if site.base == base]
_NO_PATH = f"concat('/page/', {_ID})"
_PATH = "case page_id % 10 " + " ".join(
    f"when {k} then case cast(floor(page_id / 10) as bigint) % 6 " + " ".join(
        f"when {j} then '{path}'" for j, path in enumerate(paths)) + f" else {_NO_PATH} end"
    for k, paths in enumerate(_PATHS[:9])) + f" else {_NO_PATH} end"

# The same listings under the paths of their sites, some with a slash, a fragment or a
# query behind; one site in ten has no page at any of its paths.
SITE_PATH_LISTINGS = f"""
select page_id, html, concat(url, {_PATH}, case page_id % 11 when 3 then '/' when 4 then '#top'
  when 5 then '?page=2' else '' end) as url from ({SITE_LISTINGS})
"""

# Image bytes by document: a signature and a filler that grows with the text.
IMAGE_BYTES = """
select concat('img/', cast(doc_id as varchar(20)), '.bin') as path,
  case doc_id % 7 when 0 then 'FFD8FFE0' when 1 then '89504E470D0A1A0A' when 2 then '474946383761'
    when 3 then '474946383961' when 4 then '52494646000000005745425056503820' when 5 then '3C737667'
    else '0474946383961' end as signature,
  n_chars * 2 as size,
  case when doc_id % 5 = 0 then 'image/svg+xml' when doc_id % 5 = 1 then 'text/html' else 'image/png' end as content_type
from {documents}
"""


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A view as a DataFrame over the tables of ``sf_dir``."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages") if "{" + t + "}" in text}
    return spark.sql(text.replace("interval 1 minute", "interval '1' minute"), **tables)


def duck(text: str) -> str:
    """A view as a DuckDB subquery body."""
    return text.replace("{{", "{").replace("}}", "}").replace("{documents}", "documents").replace("{pages}", "pages")

"""DuckDB SQL for the registered queries, written apart from the Spark code.

Views come first as CTEs. De-duplication is unrolled into a fixed number of
rounds and adds a row that cannot match if any record were left undecided.
Results over ``site_pages`` are derived from how that view builds its pages.
"""

from __future__ import annotations

from presswork.operators.repair import IMAGE_POOL, IMAGE_REPAIR_DEFAULT, SOURCE_IMAGES
from presswork.plans.sites import SITES as SITE_RULES
from presswork.sources.seed import SEED
from workload import queries as Q
from workload import views as V

WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOISE = "|".join(rf"<{t}(?:\s[^>]*)?>.*?</{t}\s*>" for t in ("script", "style", "nav", "aside", "header", "footer"))
SCRIPTS = "|".join(rf"<{t}(?:\s[^>]*)?>.*?</{t}\s*>" for t in ("script", "style"))
BLOCK = (
    "p|div|ul|ol|li|dl|table|h1|h2|h3|h4|h5|h6|section|article|aside|main|nav|header|footer|form|figure|"
    "blockquote|pre|hr")
P_END = rf"(?i)</(?:{BLOCK}|body|html)\s*>|<(?:{BLOCK})(?:\s[^>]*)?/?>"
SUFFIX = "jpg|jpeg|png|gif|webp"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def clean(x: str) -> str:
    return f"coalesce(replace({squeeze(x)}, chr(92), chr(92) || chr(92)), '')"


def blank(x: str) -> str:
    return f"(coalesce({strip(x)}, '') = '')"


def decode(x: str) -> str:
    for entity, char in (("lt", "'<'"), ("gt", "'>'"), ("quot", "'\"'"), ("nbsp", "chr(160)"), ("middot", "'·'"),
                         ("copy", "'©'"), ("amp", "'&'")):
        x = f"replace({x}, '&{entity};', {char})"
    return x


def text(x: str) -> str:
    return decode(f"regexp_replace({x}, '<[^>]*>', '', 'g')")


def without(x: str, pattern: str) -> str:
    return f"regexp_replace({x}, '(?is)<!--.*?-->|{pattern}', '', 'g')"


def initcap(x: str) -> str:
    return (f"array_to_string(list_transform(string_split({squeeze(x)}, ' '), "
            "lambda w: upper(w[1]) || lower(w[2:])), ' ')")


def slug(url: str, drop_html: str = "false") -> str:
    last = f"replace(string_split(rtrim({url}, '/'), '/')[-1], '-', ' ')"
    return initcap(f"case when {drop_html} then replace({last}, '.html', '') else {last} end")


def domain(url: str) -> str:
    return f"regexp_replace(regexp_extract({url}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1), '^www[.]', '')"


def label(url: str) -> str:
    first = f"regexp_extract({domain(url)}, '([^.]+)', 1)"
    return f"upper({first}[1]) || lower({first}[2:])"


def fetchable(url: str) -> str:
    bare = f"lower(string_split({url}, '?')[1])"
    return (f"coalesce((starts_with({url}, 'http://') or starts_with({url}, 'https://')) and not "
            f"regexp_matches({bare}, 'svg|logo|icon'), false)")


def suffix(url: str) -> str:
    path = f"regexp_replace(lower(string_split({url}, '?')[1]), '^[a-z][a-z0-9+.-]*://[^/#]*|#.*$', '', 'g')"
    return f"coalesce(nullif(regexp_extract({path}, '[^/.][^/]*([.](?:{SUFFIX}))$', 1), ''), '.jpg')"


def valid_title(x: str) -> str:
    return (f"coalesce(lower({strip(x)}) not in ('', 'untitled', 'no title', 'none', 'null', 'thegamer', "
            f"'the gamer'), false)")


def valid_image(x: str) -> str:
    u = f"lower({strip(x)})"
    return (f"coalesce((starts_with({u}, 'http://') or starts_with({u}, 'https://')) and not contains({u}, 'base64') "
            f"and not ends_with({u}, '.svg'), false)")


def fold(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def absolute(href: str, base: str) -> str:
    return f"case when starts_with({href}, 'http') then {href} else {base} || {href} end"


def with_(body: str, **ctes: str) -> str:
    return "with recursive " + ", ".join(f"{n} as ({t})" for n, t in ctes.items()) + " " + body


DOCS = V.duck(V.DOC_ARTICLES)
BLANKS = V.duck(V.BLANK_ARTICLES)
SIDE = V.duck(V.SIDE_CONTENT)
SITES = V.duck(V.SITE_ARTICLES)
SITE_PAGES = V.duck(V.SITE_PAGES)
LISTINGS = V.duck(V.LISTING_PAGES)
STAMP = "strftime(scrape_timestamp, '%Y-%m-%d %H:%M:%S')"


def docs(body: str) -> str:
    return with_(body, d=DOCS)


def sites(body: str) -> str:
    return with_(body, s=SITES)


PUBLIC = (
    "id, title, coalesce(content, '') as content, source_name, source_url, coalesce(image_url, '') as image_url, "
    f"'' as local_image_path, {STAMP} as scrape_timestamp")

# -- de-duplication ---------------------------------------------------------

KEYS = ("ingest_seq, coalesce(source_url, '') as u, case when coalesce(title, '') <> '' and "
        "coalesce(source_name, '') <> '' then source_name || chr(0) || title end as t")


def greedy(name: str, rows: str, store: str | None = None, rounds: int = 8) -> dict[str, str]:
    """CTEs that end in ``name`` (ingest_seq): the accepted rows of ``rows``."""
    known = "" if store is None else (
        f" where u not in (select coalesce(source_url, '') from {store}) and (t is null or t not in "
        f"(select t from (select {KEYS} from {store}) where t is not null))")
    ctes = {f"{name}_r0": f"select * from (select {KEYS} from {rows}){known}"}
    for i in range(rounds):
        left, won = f"{name}_r{i}", f"{name}_w{i}"
        ctes[won] = (
            f"select * from (select *, min(ingest_seq) over (partition by u) as mu, case when t is not null then "
            f"min(ingest_seq) over (partition by t) end as mt from {left}) where ingest_seq = mu and "
            f"(t is null or ingest_seq = mt)")
        ctes[f"{name}_r{i + 1}"] = (
            f"select * from {left} where u not in (select u from {won}) and (t is null or t not in "
            f"(select t from {won} where t is not null))")
    union = " union all ".join(f"select ingest_seq from {name}_w{i}" for i in range(rounds))
    ctes[name] = f"{union} union all select -1 from {name}_r{rounds}"
    return ctes


# Even documents, then odd ones against what is kept of the even ones.
TWO_BATCHES = {
    "d": DOCS, "e": "select * from d where ingest_seq % 2 = 0", "o": "select * from d where ingest_seq % 2 = 1",
    **greedy("a", "e"), "st": "select d.* from d join a using (ingest_seq)", **greedy("b", "o", "st")}

# -- plain pages ------------------------------------------------------------

ARTICLE = rf"regexp_extract({without('html', NOISE)}, '(?is)<article(?:\s[^>]*)?>(.*?)</article', 1)"
PARAGRAPHS = (
    f"list_transform(string_split_regex({ARTICLE}, '(?i)<p(?:\\s[^>]*)?>')[2:], "
    f"lambda x: {strip(text(f'string_split_regex(x, {q(P_END)})[1]'))})")
H1 = strip(text(rf"regexp_extract({without('html', SCRIPTS)}, '(?is)<h1(?:\s[^>]*)?>(.*?)</h1', 1)"))
HTML_TITLE = strip(text(rf"regexp_extract({without('html', SCRIPTS)}, '(?is)<title(?:\s[^>]*)?>(.*?)</title', 1)"))
CUT_TITLE = strip(f"string_split({HTML_TITLE}, ' - ')[1]")
TITLE = f"coalesce(nullif({H1}, ''), nullif({CUT_TITLE}, ''), {slug('url')})"


def joined(parts: str, longer_than: int) -> str:
    return f"coalesce(array_to_string(list_filter({parts}, lambda x: length(x) > {longer_than}), ' '), '')"


PAGE_FIELDS = (
    f"select page_id, url, {TITLE} as title, {PARAGRAPHS} as ps, {domain('url')} as source_name from pages")
PAGE_BODY = (
    f"coalesce(nullif(case when len(ps) > 1 then {joined('ps', 0)} else '' end, ''), {joined('ps', 30)})")
PLAIN = "'No text content available for this article. Please visit the original source for more information.' || chr(10) || chr(10) || 'Source: '"


def default_body(content: str, title: str, source: str, url: str) -> str:
    video = (f"{title} || chr(10) || chr(10) || 'This is a video article from ' || {source} || '. Please visit the "
             f"source URL to watch the video content.' || chr(10) || chr(10) || 'Source: ' || {url}")
    return (f"case when not {blank(content)} then {clean(content)} when regexp_matches(lower({url}), "
            f"'video|youtube|vimeo') then {video} else {PLAIN} || {url} end")


PAGE_ARTICLES = (
    f"select page_id as ingest_seq, md5({clean('title')} || url) as id, {clean('title')} as title, "
    f"{default_body('body', clean('title'), 'source_name', 'url')} as content, source_name, url as source_url "
    f"from (select *, {PAGE_BODY} as body from ({PAGE_FIELDS}))")

HREFS = r"""regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"', 1)"""


def numbered(links: str, name: str, keep: str, source: str = "pages") -> str:
    return (f"select {keep}, unnest(range(len(l))) as pos, unnest(l) as {name} from "
            f"(select *, {links} as l from {source})")


def distinct_in_order(links: str) -> str:
    return f"list_filter({links}, lambda x, i: list_position({links}, x) = i)"


BASE_OF_URL = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]*')"
ABSOLUTE_HREFS = f"list_transform({HREFS}, lambda h: {absolute('h', BASE_OF_URL)})"

# Links that the item rules of the known sites find: which marks of the listing view a
# site looks for follows from the number of the site and of the page.
_WORDS = """regexp_extract_all(html, '<li><a href="/([^"]*)"', 1)"""
SITE_LINK_LIST = f"""case when k in (1, 6) then [] when v = 0 and (k in (0, 2) or h <> 0)
  then list_transform(w, lambda x: base || '/news/' || x) when v = 1 then list_transform(w, lambda x: base || '/articles/2024/' || x)
  when v = 3 then list_transform(w, lambda x: 'https://other.example.com/news/' || x) else [] end"""
SITE_NAMES = {i: site.name for i, base in enumerate(V.SITE_BASES) for site in SITE_RULES.values() if site.base == base}
SITE_LINKED = (
    f"select page_id, k, source_name, case when k = 0 then l else list_filter(l, lambda x, i: list_position(l, x) = i) end as l "
    f"from (select *, {SITE_LINK_LIST} as l from (select page_id, page_id % 10 as k, page_id % 4 as v, page_id % 3 as h, "
    f"{_WORDS} as w, case page_id % 10 " + " ".join(f"when {i} then '{b}'" for i, b in enumerate(V.SITE_BASES)) + " end as base, "
    "case page_id % 10 " + " ".join(f"when {i} then {q(n)}" for i, n in SITE_NAMES.items()) + " end as source_name from pages))")
# Listing paths without slashes at their ends, the first of equal ones.
_LISTED = [(site.name, site.key(), rank, path.rstrip("/")) for site in SITE_RULES.values() for rank, path in enumerate(site.paths)
           if path.rstrip("/") not in [p.rstrip("/") for p in site.paths[:rank]]]
SITE_LISTED = "select * from (values " + ", ".join(
    f"({q(n)}, {q(h)}, {r}, {q(p)})" for n, h, r, p in _LISTED) + ") v(source_name, host, path_rank, path)"
SITE_KNOWN = "select * from (values " + ", ".join(
    f"({q(site.name)}, {pos}, {q(link)})" for site in SITE_RULES.values() for pos, link in enumerate(site.known_links)
) + ") v(source_name, pos, link)"

# -- pages of the known sites ------------------------------------------------

_N = "cast(page_id as varchar)"
SITE_CASES = (
    f"select page_id, url, page_id % 10 as k, page_id % 7 as m, page_id % 3 as h, page_id % 8 as g, "
    f"{H1} as heading, {CUT_TITLE} as cut from ({SITE_PAGES})")
HEADING = "case when h in (0, 1) then heading end"
CLASSED = "case when h = 0 then heading end"
META = f"case m when 0 then 'Og story ' || {_N} || ' & more' when 1 then 'Tw story ' || {_N}"
LD = f"case when m = 4 then 'Ld story ' || {_N} end"
UNNAMED_CUT = "case when lower(cut) not in ('', 'thegamer', 'the gamer') then cut end"
SITE_TITLE = f"""case k
  when 0 then coalesce({CLASSED}, '') when 1 then coalesce({HEADING}, '') when 2 then coalesce({HEADING}, '')
  when 3 then coalesce({HEADING}, {slug('url')})
  when 4 then coalesce({META} when 2 then 'The Gamer' end, {HEADING}, {slug('url')})
  when 5 then coalesce({HEADING}, {slug('url')}) when 6 then coalesce({CLASSED}, '')
  when 7 then coalesce({HEADING}, {slug('url')})
  when 8 then coalesce({META} end, {UNNAMED_CUT}, {HEADING}, {LD}, {slug('url')})
  when 9 then coalesce({HEADING}, {slug('url', 'true')}) end"""

_CDN = "'https://cdn.example.com/"
IMG = {
    "og": f"case when m = 2 then {_CDN}og/' || {_N} || '.jpg' end",
    "og_any": f"case m when 2 then {_CDN}og/' || {_N} || '.jpg' when 3 then {_CDN}site-logo.png' end",
    "picture": f"case when g = 0 then {_CDN}p/' || {_N} || '.jpg' end",
    "gif": "case when g = 0 then 'x.gif' end",
    "featured": f"case when g = 1 then {_CDN}f/' || {_N} || '.png?w=1' end",
    "upload": f"case when g = 2 then '/uploads/' || {_N} || '.jpg' end",
    "lazy": f"case when g = 3 then {_CDN}wp-content/uploads/' || {_N} || '.webp' end",
    "header": f"case when g = 5 then {_CDN}h/' || {_N} || '.jpg' end",
    "bare": f"case when g = 6 then '//cdn.example.com/n/' || {_N} || '.png' end",
}
_FULL = "https://www.engadget.com"


def images(*steps: str, default: str = "") -> str:
    return "coalesce(" + ", ".join([*(IMG.get(s, s) for s in steps), q(default)]) + ")"


SITE_IMAGE = f"""case k
  when 0 then {images('header', 'og_any', 'picture', 'featured', 'upload', 'bare',
                      default='https://assets-prd.ignimgs.com/2023/09/20/ign-default-1695238495427.jpg')}
  when 1 then {images('picture', 'og_any', 'featured', 'upload', 'lazy', "'https:' || " + IMG['bare'],
                      default='https://cdn.mos.cms.futurecdn.net/6bxva8DmZvNj8kaVrQZZMP-970-80.jpg')}
  when 2 then {images('gif')} when 3 then {images('picture')}
  when 4 then {images('og', 'featured', 'picture', 'lazy')}
  when 5 then {images('picture', 'upload', 'lazy')} when 6 then {images('gif')}
  when 7 then {images('featured', 'picture', 'lazy')}
  when 8 then {images('featured', 'picture', 'og', 'upload', 'lazy', 'bare',
                      default='https://static0.thegamerimages.com/wordpress/wp-content/uploads/2023/05/thegamer-default-og-1.jpg')}
  when 9 then {images('featured', 'picture', 'og_any', f"'{_FULL}' || " + IMG['upload'], f"'{_FULL}' || " + IMG['bare'],
                      default='https://s.yimg.com/os/creatr-uploaded-images/2020-10/fe92d4b0-0f9c-11eb-bfce-a5570d2300c0')}
  end"""

# -- catalog helpers --------------------------------------------------------

# Bodies of the view's pages: which container a page has follows from its number, so three
# sites find none, two take every paragraph, and the others need more than one; of these
# the ones that know a wider container take its longer texts, an h2 heading among them.
SITE_BODY = f"""case when k in (2, 5, 6) then '' when k in (0, 1) or (len(ps) > 1 and {joined('ps', 0)} <> '') then {joined('ps', 0)}
  when k in (3, 7, 8) then {joined("list_prepend(case when h = 2 then own_heading else '' end, ps)", 30)} else '' end"""
FILLED = (
    "select ingest_seq, d.id, title, source_name, source_url, image_url, scrape_timestamp, "
    f"case when not {blank('d.content')} then d.content when not {blank('c.content')} then c.content "
    "else 'Visit the source for more information: ' || source_url end as content from d left join c on d.id = c.id")
EXPORT_BODY = f"case when {blank('content')} then 'Visit the source for more information: ' || source_url else content end"
_like = Q.KEYWORD.lower()
_pool = "[" + ", ".join(map(q, IMAGE_POOL)) + "]"
_by_source = "case source_name " + " ".join(f"when {q(k)} then {q(v)}" for k, v in SOURCE_IMAGES.items()) + " end"
_suspicious = "coalesce(image_url, '') = '' or regexp_matches(lower(image_url), 'logo|svg|author|w=90')"
_preview = f"{strip('substring(content, 1, 50)')} || case when length(content) > 50 then '...' else '' end"
SQUEEZED_CUT = f"string_split({squeeze('title')}, ' - ')[1]"
_controls = r"[\x00-\x1F\x7F\x{80}-\x{9F}]"

SQL: dict[str, str] = {
    "pages_scan": "select page_id, url, length(html) as n_html from pages",
    "page_text": f"select page_id, {squeeze(text(without('html', SCRIPTS)))} as text from pages",
    "noise_removed": f"select page_id, {without('html', NOISE)} as html_clean from pages",
    "links_raw": numbered(HREFS, "href", "page_id"),
    "links_distinct": numbered(distinct_in_order(HREFS), "href", "page_id"),
    "links_absolute": numbered(ABSOLUTE_HREFS, "link", "page_id"),
    "links_filtered": with_(
        f"select distinct page_id, link from ({numbered(ABSOLUTE_HREFS, 'link', 'page_id', 'l')}) "
        f"where regexp_matches(link, '{Q.MUST}') and not regexp_matches(link, '{Q.MUST_NOT}')", l=LISTINGS),
    "top_n_per_source": (
        "select source_name, link, rn from (select *, row_number() over (partition by source_name order by page_id, "
        f"pos) as rn from (select {domain('url')} as source_name, page_id, pos, link from "
        f"({numbered(HREFS, 'link', 'page_id, url')}))) where rn <= {Q.TOP_N}"),
    "path_cascade": with_(
        "select source_name, path_rank, link from f where path_rank = (select min(path_rank) from f g where "
        "g.source_name = f.source_name) union all select distinct source_name, null, 'https://' || source_name || "
        "'/start' from l2 where source_name not in (select source_name from f)",
        l=LISTINGS, l2=f"select *, {domain('url')} as source_name from l",
        f=numbered(HREFS, "link", "source_name, path_rank, page_id", "l2")),
    "site_listing_links": f"select page_id, source_name, unnest(range(len(l))) as pos, unnest(l) as link from ({SITE_LINKED})",
    "site_path_cascade": with_(
        f"select source_name, path_rank, page_id, pos, link from (select *, row_number() over (partition by source_name "
        f"order by page_id, pos) as rn from c) where rn <= {Q.SITE_LINKS}",
        p=SITE_LISTED, u=V.duck(V.SITE_PATH_LISTINGS), s=SITE_LINKED,
        f=f"select s.source_name, path_rank, page_id, unnest(range(len(l))) as pos, unnest(l) as link from s join u using (page_id) "
          f"join p on p.source_name = s.source_name and path = regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), "
          f"'/+$', '') where not contains(url, '?')",
        c=f"select * from f where path_rank = (select min(path_rank) from f g where g.source_name = f.source_name) union all "
          f"select source_name, null, null, pos, link from ({SITE_KNOWN}) where source_name not in (select source_name from f)"),
    "title_cascade": f"select page_id, {SITE_TITLE} as title from ({SITE_CASES})",
    "jsonld_title": f"select page_id, {LD} as headline from (select page_id, page_id % 7 as m from pages)",
    "image_cascade": f"select page_id, {SITE_IMAGE} as image_url from ({SITE_CASES})",
    "extract_rejects": (
        f"select page_id, reason from (select page_id, case when k = 0 then null when not {valid_title('title')} then "
        f"'invalid title' when not {valid_image('image')} then 'invalid image' end as reason from (select *, "
        f"{SITE_TITLE} as title, {SITE_IMAGE} as image from ({SITE_CASES}))) where reason is not null"),
    "site_records": (
        f"select page_id as ingest_seq, id, title, {default_body('body', 'title', 'source_name', 'url')} as content, source_name, "
        f"url as source_url, image as image_url, case when image = '' then '' when {fetchable('image')} then 'images/' || id || "
        f"{suffix('image')} else 'images/' || id || '.jpg' end as local_image_path, 'content/' || id || '.txt' as local_content_path "
        f"from (select *, md5({clean('raw_title')} || url) as id, {clean('raw_title')} as title, case when k in (3, 4, 5, 7, 8, 9) and "
        f"{blank('raw_body')} then 'This article from ' || source_name || ' discusses ' || raw_title || '. Visit ' || url || "
        f"' to read the full article.' else raw_body end as body from (select c.*, {SITE_TITLE} as raw_title, {SITE_IMAGE} as image, "
        f"{SITE_BODY} as raw_body, case k " + " ".join(f"when {i} then {q(n)}" for i, n in SITE_NAMES.items()) + " end as source_name "
        f"from ({SITE_CASES}) c join (select page_id, ps, {H1} as own_heading from (select *, {PARAGRAPHS} as ps from pages)) f using (page_id))) "
        f"where k = 0 or ({valid_title('raw_title')} and {valid_image('image')})"),
    "body_paragraphs": (
        f"select page_id, case when len(ps) > 1 then {joined('ps', 0)} else '' end as body from ({PAGE_FIELDS})"),
    "body_substantial": f"select page_id, {joined('ps', 30)} as body from ({PAGE_FIELDS})",
    "page_articles": PAGE_ARTICLES,
    "clean_text": docs(f"select ingest_seq, {clean('content')} as content_clean from d"),
    "strip_controls": sites(f"select ingest_seq, regexp_replace(content, '{_controls}', '', 'g') as s_clean from s"),
    "article_id": docs("select ingest_seq, md5(coalesce(title, '') || coalesce(source_url, '')) as id from d"),
    "record_id": docs(
        "select ingest_seq, strftime(scrape_timestamp, '%Y%m%d') || '_' || substring(md5(source_url), 1, 8) "
        "as record_id from d"),
    "url_domain": f"select page_id, {domain('url')} as domain from pages",
    "source_label": f"select page_id, {label('url')} as label from pages",
    "asset_paths": docs(
        f"select id, local_image_path, 'content/' || id || '.txt' as local_content_path, case when local_image_path "
        f"<> '' then '{Q.PREFIX}' || local_image_path else '' end as public_url from (select id, case when "
        f"coalesce(image_url, '') = '' then '' when {fetchable('image_url')} then 'images/' || id || "
        f"{suffix('image_url')} else 'images/' || id || '.jpg' end as local_image_path from d)"),
    "image_clean_url": docs("select ingest_seq, string_split(image_url, '?')[1] as image_clean from d"),
    "image_ext": sites(f"select ingest_seq, {suffix("coalesce(image_url, '')")} as ext from s"),
    "image_absolute": docs(
        "select ingest_seq, case when starts_with(image_url, 'http://') or starts_with(image_url, 'https://') then "
        "image_url when starts_with(image_url, '/') then 'https://www.example.com' || image_url else "
        "'https://www.example.com/' || image_url end as image_abs from d"),
    "slug_title": f"select page_id, {slug('url')} as title from pages",
    "title_suffix_cut": sites(
        f"select ingest_seq, {strip(SQUEEZED_CUT)} as title_cut from s"),
    "preview_title": sites(f"select ingest_seq, {_preview} as preview from s"),
    "default_body": sites(
        f"select ingest_seq, {default_body('content', clean('title'), 'source_name', 'source_url')} as body from s"),
    "valid_title": sites(f"select ingest_seq, {valid_title('title')} as ok from s"),
    "valid_image_url": docs(f"select ingest_seq, {valid_image('image_url')} as ok from d"),
    "validity_gate": docs(
        f"select ingest_seq, id from d where {valid_title('title')} and {valid_image('image_url')}"),
    "image_fetchable": sites(f"select ingest_seq, {fetchable('image_url')} as ok from s"),
    "image_checks": (
        "select path, kind, coalesce(starts_with(content_type, 'image/') and content_type <> 'image/svg+xml' and "
        "kind is not null and size >= 5000, false) as ok from (select path, content_type, size, case when "
        "starts_with(signature, 'FFD8') then 'jpeg' when starts_with(signature, '89504E470D0A1A0A') then 'png' when "
        "starts_with(signature, '474946383761') or starts_with(signature, '474946383961') then 'gif' when "
        f"regexp_matches(signature[:40], '^(?:..)*57454250') then 'webp' end as kind from ({V.duck(V.IMAGE_BYTES)}))"),
    "site_subset": docs("select source_name, ingest_seq from d where source_name in ('src1', 'src5', 'src7')"),
    "public_view": docs(f"select {PUBLIC} from d"),
    "list_articles": docs(
        "select id, title, coalesce(content, '') as content, source_name, source_url, coalesce(image_url, '') as "
        f"image_url, '' as local_image_path, '' as local_content_path, {STAMP} as scrape_timestamp, ingest_seq from d"),
    "list_by_source": docs(f"select id, source_name from d where source_name = '{Q.SOURCE}'"),
    "list_by_source_ci": docs(f"select id, source_name from d where lower(source_name) = lower('{Q.SOURCE.upper()}')"),
    "list_page": docs(
        "select id, ingest_seq from d order by scrape_timestamp desc, ingest_seq "
        f"limit {Q.PAGE_LIMIT} offset {Q.PAGE_OFFSET}"),
    "list_offset": docs(
        f"select id, ingest_seq from d order by scrape_timestamp desc, ingest_seq offset {Q.LIST_OFFSET}"),
    "article_by_id": docs(f"select {PUBLIC} from d where id = (select max(id) from d)"),
    "search_keyword": docs(
        f"select id, ingest_seq, title from d where {fold('title')} like '%{_like}%' or {fold('content')} like "
        f"'%{_like}%' order by scrape_timestamp desc, ingest_seq limit 10"),
    "count_all": docs("select count(*) as n from d"),
    "count_source": docs(f"select count(*) as n from d where source_name = '{Q.SOURCE}'"),
    "distinct_sources": docs("select distinct source_name from d"),
    "count_by_source": docs("select source_name, count(*) as n from d group by source_name"),
    "batch_summary": with_(
        "select (select count(*) from d) as scraped, (select count(*) from a) as added", d=DOCS, **greedy("a", "d")),
    "source_health": docs(
        "select count(*) filter (where n > 0) as succeeded, count(*) filter (where n = 0) as failed from (select w, "
        f"(select count(*) from d where source_name = w) as n from (select unnest({Q.HEALTH_SOURCES}) as w))"),
    "catalog_health": docs("select count(*) as n, count(*) < 20 as needs_ingest from d"),
    "page_total": docs(
        f"select count(*) as total, cast({Q.PAGE_OFFSET} as bigint) as \"offset\", cast({Q.PAGE_LIMIT} as bigint) as "
        f"\"limit\", cast(least(greatest(count(*) - {Q.PAGE_OFFSET}, 0), {Q.PAGE_LIMIT}) as bigint) as page_size from d"),
    "export_rows": with_(f"select {PUBLIC} from f", d=BLANKS, c=SIDE, f=FILLED),
    "dedup_greedy": with_("select ingest_seq, id from d join a using (ingest_seq)", d=DOCS, **greedy("a", "d")),
    "dedup_vs_store": with_(
        "select ingest_seq, id from d join b using (ingest_seq)", d=DOCS,
        e="select * from d where ingest_seq % 2 = 0", o="select * from d where ingest_seq % 2 = 1",
        **greedy("a", "e"), st="select d.* from d join a using (ingest_seq)", **greedy("b", "o", "st")),
    "dedup_chain": (
        "select doc_id as ingest_seq from (select doc_id, doc_id - row_number() over (order by doc_id) as g from documents) "
        "qualify row_number() over (partition by g order by doc_id) % 2 = 1"),
    "store_two_writers": with_(
        "select id, source_url from d join a using (ingest_seq) union all select id, source_url from d join b using (ingest_seq)",
        **TWO_BATCHES),
    "export_incremental": with_(
        f"select {PUBLIC} from (select * exclude (content, scrape_timestamp), {EXPORT_BODY} as content, "
        "scrape_timestamp + to_days(cast(ingest_seq % 6 as integer)) as scrape_timestamp "
        "from d where ingest_seq in (select ingest_seq from a union all select ingest_seq from b))", **TWO_BATCHES),
    "export_history": with_(
        "select timestamp '2025-06-01 12:00:00' as timestamp, 'export-0' as name, count(*) as article_count from a union all "
        "select timestamp '2025-06-01 12:00:00', 'export-1', (select count(*) from a) + count(*) from b", **TWO_BATCHES),
    "envelope_round_trip": docs(f"select {PUBLIC} from (select * exclude (content), {EXPORT_BODY} as content from d)"),
    "corrupt_envelopes": docs(
        "select id, title from d where ingest_seq // 200 % 3 <> 0 union all "
        "select distinct 'envelope ' || (ingest_seq // 200), '' from d where ingest_seq // 200 % 3 = 0"),
    "exists_in_store": with_(
        "select ingest_seq from o where u in (select u from e) or t in (select t from e where t is not null)",
        d=DOCS, e=f"select {KEYS} from d where ingest_seq % 2 = 0", o=f"select {KEYS} from d where ingest_seq % 2 = 1"),
    "merge_by_url": docs(
        "select ingest_seq, source_url from d where ingest_seq % 2 = 0 union all select min(ingest_seq), source_url "
        "from d where ingest_seq % 2 = 1 and source_url not in (select source_url from d where ingest_seq % 2 = 0) "
        "group by source_url"),
    "content_backfill": with_("select ingest_seq, id, content from f", d=BLANKS, c=SIDE, f=FILLED),
    "fallback_image": sites(
        f"select ingest_seq, case when coalesce(image_url, '') = '' then '' when {fetchable('image_url')} then "
        f"image_url else coalesce({_by_source}, {_pool}[cast('0x' || substring(md5(id), 1, 8) as bigint) % "
        f"{len(IMAGE_POOL)} + 1]) end as image_url from s"),
    "union_sources": with_(
        f"select source_name, id from d union all select source_name, md5({clean('title')} || url) from p",
        d=DOCS, p=PAGE_FIELDS),
    "seed_if_empty": docs(
        "select id from d union all select id from (" + " union all ".join(
            f"select md5({q(t)} || {q(u)}) as id" for t, _, _, u, _ in SEED) + ") where not exists (select 1 from d)"),
    "repair_images": sites(
        f"select ingest_seq, case when source_name = 'GameRant' and ({_suspicious}) then '{IMAGE_REPAIR_DEFAULT}' else "
        f"image_url end as image_url, coalesce(source_name = 'GameRant' and ({_suspicious}), false) as repaired from s"),
    "repair_titles": sites(
        "select ingest_seq, case when source_name = 'TheGamer' and title in ('TheGamer', 'The Gamer') then case when "
        f"source_url <> '' then {slug('source_url')} when content <> '' then 'TheGamer Article: ' || {_preview} "
        "else title end else title end as title from s"),
    "stream_ingest": with_(
        "select id, source_url from p join a using (ingest_seq)", p=PAGE_ARTICLES, **greedy("a", "p")),
    "stream_metrics": with_(
        "select cast(1 as bigint) as batch_id, (select count(*) from p) as total, (select count(*) from a) as added",
        p=PAGE_ARTICLES, **greedy("a", "p")),
}

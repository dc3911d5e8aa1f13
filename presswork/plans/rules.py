"""Site rules as data.

A :class:`Site` says how one news site marks its titles, images, bodies and
listing pages. :func:`rules_frame` turns a collection of sites into a small
DataFrame (one row per site, host as key) that extraction joins to the pages, so
a new site is a new row and needs no code.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from presswork.functions.html import noise_pattern, open_tag

ANY_HOST = "*"
_PART = re.compile(r"""([a-z][a-z0-9]*)?(?:\.([\w-]+)|\#([\w-]+)|\[([\w-]+)(\*?)='([^']*)'\])?(?:\s+|$)""")


def selector(text: str) -> tuple[list[str], str]:
    """``"div.hero img"`` as (patterns of the enclosing elements, open-tag pattern).

    Each part is a tag name with at most one class, id or attribute condition. A
    text that starts with ``(?`` is taken as an open-tag pattern itself.
    """
    if text.startswith("(?"):
        return [], text
    patterns, at = [], 0
    while at < len(text):
        part = _PART.match(text, at)
        if part is None or part.end() == at:
            raise ValueError(f"unsupported selector: {text!r}")
        tag, cls, id_, attr, has, value = part.groups()
        if cls:
            patterns.append(open_tag(tag or "*", "class", "word", cls))
        elif id_:
            patterns.append(open_tag(tag or "*", "id", "is", id_))
        elif attr:
            patterns.append(open_tag(tag or "*", attr, "has" if has else "is", value))
        else:
            patterns.append(open_tag(tag))
        at = part.end()
    return patterns[:-1], patterns[-1]


@dataclass(frozen=True)
class Title:
    """One step of the title cascade: the first of ``picks`` that occurs.

    ``kind``: ``meta`` (content attribute), ``text``, ``page`` (the title element
    up to its first ' - ') or ``jsonld`` (headline of a JSON-LD object).
    """
    kind: str
    picks: tuple[str, ...] = ()


@dataclass(frozen=True)
class Image:
    """One step of the image cascade: the first of ``picks`` that occurs.

    The value is the first non-empty attribute. It must match ``accept`` and,
    lower-cased, must not match ``reject``. ``every`` tries all tags of the pick,
    not only the first; ``in_scope`` picks by the enclosing element alone.
    """
    picks: tuple[str, ...]
    attrs: tuple[str, ...] = ("data-src", "data-lazy-src", "src")
    accept: str = ""
    reject: str = ""
    every: bool = False
    in_scope: bool = False
    add_https: bool = False


@dataclass(frozen=True)
class Site:
    name: str
    base: str
    titles: tuple[Title, ...] = ()
    own_names: tuple[str, ...] = ()
    slug: bool = False
    slug_drops_html: bool = False
    images: tuple[Image, ...] = ()
    images_absolute: bool = False
    default_image: str = ""
    noise: tuple[str, ...] = ("script", "style")
    containers: tuple[str, ...] = ()
    one_container: bool = False
    min_paragraphs: int = 2
    wide_containers: tuple[str, ...] = ()
    wide_tags: str = "p|h2|h3|li"
    wide_min: int = 30
    names_itself: bool = True
    gated: bool = True
    paths: tuple[str, ...] = ()
    items: tuple[str, ...] = ()
    links: tuple[str, ...] = ("a",)
    must_contain: str = ""
    must_not_contain: str = ""
    distinct_links: bool = True
    known_links: tuple[str, ...] = ()
    host: str = field(default="")

    def key(self) -> str:
        return self.host or re.sub(r"^www[.]", "", self.base.split("//", 1)[-1])


_PATTERN = T.StructType([
    T.StructField("scopes", T.ArrayType(T.StringType(), False), False),
    T.StructField("open", T.StringType(), False),
])
_PICKS = T.ArrayType(_PATTERN, False)
_NAMES = T.ArrayType(T.StringType(), False)

SITE_SCHEMA = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("base", T.StringType(), False),
    T.StructField("titles", T.ArrayType(T.StructType([
        T.StructField("kind", T.StringType(), False),
        T.StructField("picks", _PICKS, False),
    ]), False), False),
    T.StructField("own_names", _NAMES, False),
    T.StructField("slug", T.BooleanType(), False),
    T.StructField("slug_drops_html", T.BooleanType(), False),
    T.StructField("images", T.ArrayType(T.StructType([
        T.StructField("picks", _PICKS, False),
        T.StructField("attrs", _NAMES, False),
        T.StructField("accept", T.StringType(), False),
        T.StructField("reject", T.StringType(), False),
        T.StructField("every", T.BooleanType(), False),
        T.StructField("in_scope", T.BooleanType(), False),
        T.StructField("add_https", T.BooleanType(), False),
    ]), False), False),
    T.StructField("images_absolute", T.BooleanType(), False),
    T.StructField("default_image", T.StringType(), False),
    T.StructField("noise_tags", T.StringType(), False),
    T.StructField("noise", T.ArrayType(T.StructType([
        T.StructField("open", T.StringType(), False),
        T.StructField("tag", T.StringType(), False),
    ]), False), False),
    T.StructField("containers", _PICKS, False),
    T.StructField("one_container", T.BooleanType(), False),
    T.StructField("min_paragraphs", T.IntegerType(), False),
    T.StructField("wide_containers", _PICKS, False),
    T.StructField("wide_open", T.StringType(), False),
    T.StructField("wide_min", T.IntegerType(), False),
    T.StructField("names_itself", T.BooleanType(), False),
    T.StructField("gated", T.BooleanType(), False),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("pick", _PATTERN, False),
        T.StructField("is_link", T.BooleanType(), False),
    ]), False), False),
    T.StructField("links", _PICKS, False),
    T.StructField("must_contain", T.StringType(), False),
    T.StructField("must_not_contain", T.StringType(), False),
    T.StructField("distinct_links", T.BooleanType(), False),
])


def _picks(texts: Iterable[str]) -> list:
    return [selector(t) for t in texts]


def _row(site: Site) -> tuple:
    return (
        site.name, site.base,
        [(t.kind, _picks(t.picks)) for t in site.titles], list(site.own_names),
        site.slug, site.slug_drops_html,
        [(_picks(i.picks), list(i.attrs), i.accept, i.reject, i.every, i.in_scope, i.add_https)
         for i in site.images],
        site.images_absolute, site.default_image,
        noise_pattern(n for n in site.noise if n.isalpha()),
        [(selector(n)[1], re.match("[a-z0-9]+", n).group()) for n in site.noise if not n.isalpha()],
        _picks(site.containers), site.one_container, site.min_paragraphs,
        _picks(site.wide_containers), open_tag(f"(?:{site.wide_tags})"), site.wide_min,
        site.names_itself, site.gated,
        [(selector(i), bool(re.match(r"a\b", i.split(" ")[-1]))) for i in site.items],
        _picks(site.links), site.must_contain, site.must_not_contain, site.distinct_links,
    )


# A registry of more bytes than this is joined without a broadcast hint.
MAX_BROADCAST_BYTES = 8 << 20


def registry_bytes(sites: Iterable[Site]) -> int:
    """About how much the rules of the sites weigh: their texts, and 16 bytes for every value."""
    def weight(value) -> int:
        if isinstance(value, str):
            return 16 + len(value.encode())
        return 16 + sum(map(weight, value)) if isinstance(value, (list, tuple)) else 16
    return sum(weight(_row(site)) for site in sites)


def rules_frame(spark: SparkSession, sites: Iterable[Site]) -> DataFrame:
    """One row per site: ``host`` and the nested ``site`` rules."""
    rows = [(site.key(), _row(site)) for site in sites]
    schema = T.StructType([
        T.StructField("host", T.StringType(), False), T.StructField("site", SITE_SCHEMA, False)])
    return spark.createDataFrame(rows, schema)

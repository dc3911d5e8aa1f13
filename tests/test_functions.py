"""Scalar rules on literal edge rows, against plain Python where it has the rule."""

from __future__ import annotations

import hashlib
import os
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from presswork.functions import html as H
from presswork.functions import ids
from presswork.functions import text as X
from presswork.functions import urls as U
from presswork.functions.images import image_kind, image_ok
from presswork.operators import repair

TEXTS = [
    None, "", "   ", " ", "\x1c", "a\tb", " a  b c ", "back\\slash", "\x01\x7fctl\x85x", "é　É",
    "\x0bvt\x0c", "  lead", "trail\n", "one two", "a\x1fb",
]
URLS = [
    None, "", "https://www.example.com:8080/a/b/", "http://user:pw@www.x.org/p?q=1", "//cdn.x.org/y", "no-scheme/path",
    "HTTPS://WWW.Upper.com/A", "https://host.only", "https://a.b/c.html", "https://a.b/x-y--z/", "https://www.www.de/",
]


def evaluate(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", fn(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_clean_text(spark):
    want = ["" if not t else " ".join(t.split()).strip().replace("\\", "\\\\") for t in TEXTS]
    assert evaluate(spark, TEXTS, X.clean_text) == want


def test_strip_and_blank(spark):
    assert evaluate(spark, TEXTS, X.strip) == [t if t is None else t.strip() for t in TEXTS]
    assert evaluate(spark, TEXTS, X.is_blank) == [not (t or "").strip() for t in TEXTS]


def test_strip_controls(spark):
    assert evaluate(spark, ["a\x00b\x1fc\x7fd\x9fe", None], X.strip_controls) == ["abcde", None]


def test_valid_title(spark):
    titles = [None, "", " ", "Untitled", " NO TITLE\n", "none", "NULL", "TheGamer", "the gamer", "Real", "nonesuch"]
    assert evaluate(spark, titles, X.valid_title) == [False] * 9 + [True, True]


def test_domain_and_label(spark):
    def model(u):
        if u is None:
            return None
        host = urlparse(u).netloc
        return host[4:] if host.startswith("www.") else host
    assert evaluate(spark, URLS, U.domain) == [model(u) for u in URLS]
    assert evaluate(spark, ["https://www.some-Site.example.com/x"], U.source_label) == ["Some-site"]


def test_slug_title(spark):
    def model(u):
        return " ".join(w.capitalize() for w in u.rstrip("/").split("/")[-1].replace("-", " ").split())
    urls = [u for u in URLS if u is not None]
    assert evaluate(spark, urls, X.slug_title) == [model(u) for u in urls]
    assert evaluate(spark, ["https://a.b/new-game-1.html"], lambda c: X.slug_title(c, True)) == ["New Game 1"]


def test_suffix_cut_and_preview(spark):
    assert evaluate(spark, ["A b - Site - x", "no cut", " - x"], X.title_suffix_cut) == ["A b", "no cut", ""]
    long, exact = "x" * 51, "y" * 50
    assert evaluate(spark, [long, exact, " " * 10 + "z" * 60], X.preview_title) == [
        "x" * 50 + "...", exact, "z" * 40 + "..."]


def test_default_body(spark):
    rows = spark.createDataFrame(
        [(" ", "T", "S", "https://x/VIDEOS/1"), ("", "T", "S", "https://x/a"), (" a  b ", "T", "S", "https://x/video")],
        "c string, t string, s string, u string")
    got = [r[0] for r in rows.select(X.default_body(F.col("c"), F.col("t"), F.col("s"), F.col("u"))).collect()]
    assert got[0].startswith("T\n\nThis is a video article from S.") and got[0].endswith("\n\nSource: https://x/VIDEOS/1")
    assert got[1].startswith("No text content available") and got[1].endswith("\n\nSource: https://x/a")
    assert got[2] == "a b"


IMAGES = [
    None, "", "  ", "data:image/png;base64,A", "https://x/base64/a.png", "https://x/a.SVG", "https://x/a.svg?x=1",
    " HTTPS://x/a.png ", "/a.png", "//x/a.png", "https://x/logo.png", "https://x/a.jpeg?icon=1", "ftp://x/a.gif",
    "https://x/a.tar.GIF#f", "https://x/.png", "https://x/dir.jpg/name", "https://x/a.webp;v=1",
]


def test_image_urls(spark):
    def valid(u):
        u = (u or "").strip().lower()
        return u.startswith(("http://", "https://")) and "base64" not in u and not u.endswith(".svg")

    def fetchable(u):
        bare = (u or "").split("?")[0]
        return bare.startswith(("http://", "https://")) and not any(w in bare.lower() for w in ("svg", "logo", "icon"))

    def suffix(u):
        ext = os.path.splitext(urlparse(u.split("?")[0]).path.lower())[1]
        return ext if ext in (".jpg", ".jpeg", ".png", ".gif", ".webp") else ".jpg"

    assert evaluate(spark, IMAGES, U.valid_image_url) == [valid(u) for u in IMAGES]
    assert evaluate(spark, IMAGES, U.image_fetchable) == [fetchable(u) for u in IMAGES]
    some = [u for u in IMAGES if u is not None]
    assert evaluate(spark, some, U.image_suffix) == [suffix(u) for u in some]
    assert evaluate(spark, ["/a", "b", "http://c"], lambda c: U.absolute_image(c, F.lit("B"))) == ["B/a", "B/b", "http://c"]
    assert evaluate(spark, ["//c/x", "http://c"], U.with_https) == ["https://c/x", "http://c"]
    assert evaluate(spark, ["a.jpg 1x, b", "c"], U.srcset_first) == ["a.jpg", "c"]


def test_ids_and_paths(spark):
    row = spark.range(1).select(
        ids.article_id(F.lit("Tïtle"), F.lit("https://x")), ids.article_id(F.lit(None).cast("string"), F.lit("u")),
        ids.record_id(F.lit("2025-03-04 05:06:07").cast("timestamp"), F.lit("https://x")),
        ids.image_path(F.lit("i"), F.lit("https://x/a.PNG?q")), ids.image_path(F.lit("i"), F.lit("")),
        ids.image_path(F.lit("i"), F.lit("https://x/logo.png")),
        ids.public_url(F.lit("images/i.png"), "P/"), ids.public_url(F.lit(""), "P/")).first()
    assert row[0] == hashlib.md5("Tïtlehttps://x".encode()).hexdigest()
    assert row[1] == hashlib.md5(b"u").hexdigest()
    assert row[2] == "20250304_" + hashlib.md5(b"https://x").hexdigest()[:8]
    assert list(row[3:]) == ["images/i.png", "", "images/i.jpg", "P/images/i.png", ""]


@pytest.mark.parametrize("head, length, ctype, kind, ok", [
    (b"\xff\xd8\xff", 5000, "image/jpeg", "jpeg", True),
    (b"\xff\xd8\xff", 4999, "image/jpeg", "jpeg", False),
    (b"\x89PNG\r\n\x1a\n", 6000, "image/png", "png", True),
    (b"\x89PNG\r\n", 6000, "image/png", None, False),
    (b"GIF87a", 6000, "image/gif", "gif", True),
    (b"GIF89a", 6000, "image/svg+xml", "gif", False),
    (b"RIFF\x00\x00\x00\x00WEBPVP8 ", 6000, "image/webp", "webp", True),
    (b"R" * 17 + b"WEBP", 6000, "image/webp", None, False),
    (b"<svg>", 6000, "text/html", None, False),
    (b"\x05WEB\x50", 6000, "image/webp", "webp", True),
    (b"\xf5\x74\x54\x25\x00", 6000, None, None, False),
])
def test_image_bytes(spark, head, length, ctype, kind, ok):
    df = spark.createDataFrame([(bytearray(head), length, ctype)], "b binary, n long, t string")
    assert tuple(df.select(image_kind(F.col("b")), image_ok(F.col("t"), F.col("b"), F.col("n"))).first()) == (kind, ok)


def test_entities_decode_once(spark):
    texts = ["a &amp;lt; b", "&#8217;&#x41;&eacute;&unknown; &", "&lt;b&gt; &quot;&apos;&#39;", "&#38;amp;", "x & y; &;"]
    assert evaluate(spark, texts, H.decode_entities) == ["a &lt; b", "’Aé&unknown; &", "<b> \"''", "&amp;", "x & y; &;"]


def test_attribute(spark):
    tag = """<img alt="it's" data-src='a "b"' src=""  >"""
    for name, want in (("alt", "it's"), ("data-src", 'a "b"'), ("src", ""), ("title", "")):
        assert evaluate(spark, [tag], lambda c: H.attribute(c, name)) == [want]
    assert evaluate(spark, [None], lambda c: H.attribute(c, "src")) == [None]


def test_elements_nest(spark):
    page = '<div class="b a">1<div>2<div class="a">3</div></div>4</div><DIV CLASS="a">5<p>x</div><div class="ab">6</div>'
    pattern = H.open_tag("div", "class", "word", "a")
    got = evaluate(spark, [page], lambda c: H.elements(c, pattern))[0]
    assert [g.strip() for g in got] == ['1<div>2<div class="a">3</div></div>4', "3", "5<p>x"]
    left = evaluate(spark, [page], lambda c: H.without_elements(c, F.lit(pattern), F.lit("div")))[0]
    assert left.strip() == '<div class="ab">6</div>'


def test_repairs(spark):
    rows = [
        (1, "GameRant", "x", "", "https://u/a-b", "c"), (2, "GameRant", "x", "https://i/w=90", "u", "c"),
        (3, "IGN", "x", "", "u", "c"), (4, "GameRant", "x", None, "u", "c"), (5, "GameRant", "x", "https://i/ok.png", "u", "c"),
        (6, "TheGamer", "TheGamer", "i", "https://u/new-game/", "c"), (7, "TheGamer", "The Gamer", "i", "", "z" * 60),
        (8, "TheGamer", "The Gamer", "i", "", ""), (9, "TheGamer", "the gamer", "i", "https://u/q", "c"),
    ]
    df = spark.createDataFrame(rows, "ingest_seq int, source_name string, title string, image_url string, source_url string, content string")
    fixed = {r["ingest_seq"]: r for r in repair.repair_images(df).collect()}
    assert [fixed[i]["repaired"] for i in range(1, 6)] == [True, True, False, True, False]
    assert repair.count_repaired(repair.repair_images(df)).first()["n"] == 3
    assert fixed[1]["image_url"] == repair.IMAGE_REPAIR_DEFAULT and fixed[5]["image_url"] == "https://i/ok.png"
    titles = {r["ingest_seq"]: r["title"] for r in repair.repair_titles(df).collect()}
    assert titles[6] == "New Game" and titles[7] == "TheGamer Article: " + "z" * 50 + "..."
    assert titles[8] == "The Gamer" and titles[9] == "the gamer" and titles[1] == "x"


def test_stand_in_images(spark):
    df = spark.createDataFrame([(1, "IGN", "a", "/x.png"), (2, "other", "a", "/x.png"), (3, "IGN", "a", ""),
                                (4, "IGN", "a", "https://i/x.png")],
                               "ingest_seq int, source_name string, id string, image_url string")
    got = {r["ingest_seq"]: r["image_url"] for r in repair.with_usable_image(df).collect()}
    assert got[1] == repair.SOURCE_IMAGES["IGN"] and got[2] in repair.IMAGE_POOL
    assert got[3] == "" and got[4] == "https://i/x.png"

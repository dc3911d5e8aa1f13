"""Text rules as Column expressions (whitespace, titles, default wordings)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as whitespace, and the same set as a Java
# character class that rules out most characters by one table and one range.
SPACES = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = (
    r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
)

# Titles that stand for "no title".
PLACEHOLDER_TITLES = ["", "untitled", "no title", "none", "null", "thegamer", "the gamer"]

# URL parts that mark a video page.
VIDEO_MARKS = "video|youtube|vimeo"


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Remove whitespace at both ends (all of it, not only blanks)."""
    return F.trim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """One blank for every run of whitespace, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE_CLASS}+", " "))


def is_blank(c: Column) -> Column:
    """Null, empty or only whitespace."""
    return or_empty(F.ltrim(c, F.lit(SPACES))) == ""


def clean_text(c: Column) -> Column:
    """Squeezed text with every backslash doubled; null gives ''."""
    return or_empty(F.replace(squeeze(c), F.lit("\\"), F.lit("\\\\")))


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x1F\x7F-\x9F]", "")


def valid_title(c: Column) -> Column:
    return F.coalesce(~F.lower(strip(c)).isin(PLACEHOLDER_TITLES), F.lit(False))


def capitalise_words(c: Column) -> Column:
    return F.initcap(squeeze(c))


def slug_title(url: Column, drop_html: Column | bool = False) -> Column:
    """Title words from the last path segment of a URL."""
    last = F.substring_index(F.rtrim(url, F.lit("/")), "/", -1)
    spaced = F.replace(last, F.lit("-"), F.lit(" "))
    if isinstance(drop_html, bool):
        drop_html = F.lit(drop_html)
    plain = F.when(drop_html, F.replace(spaced, F.lit(".html"), F.lit(""))).otherwise(spaced)
    return capitalise_words(plain)


def title_suffix_cut(c: Column) -> Column:
    """The part before the first ' - ', where pages put their site name."""
    return strip(F.substring_index(c, " - ", 1))


def preview_title(content: Column) -> Column:
    head = strip(F.substring(content, 1, 50))
    return F.when(F.length(content) > 50, F.concat(head, F.lit("..."))).otherwise(head)


def unless_named(c: Column, names: Column) -> Column:
    """Null when the text is empty or, ignoring case, one of ``names``."""
    return F.get(F.filter(F.array(c), lambda t: (t != "") & ~F.array_contains(names, F.lower(t))), F.lit(0))


# Wordings used when a body is empty.
VIDEO_BODY = (
    "%s\n\nThis is a video article from %s. Please visit the source URL to watch "
    "the video content.\n\nSource: %s"
)
PLAIN_BODY = (
    "No text content available for this article. Please visit the original source "
    "for more information.\n\nSource: %s"
)
SITE_BODY = "This article from %s discusses %s. Visit %s to read the full article."
EXPORT_BODY = "Visit the source for more information: %s"


def default_body(content: Column, title: Column, source_name: Column, url: Column) -> Column:
    """The cleaned content, or the video / plain wording where it is blank."""
    video = F.format_string(VIDEO_BODY, title, source_name, url)
    plain = F.format_string(PLAIN_BODY, url)
    wording = F.when(F.lower(url).rlike(VIDEO_MARKS), video).otherwise(plain)
    return F.when(is_blank(content), wording).otherwise(clean_text(content))


def site_body(source_name: Column, title: Column, url: Column) -> Column:
    return F.format_string(SITE_BODY, source_name, title, url)

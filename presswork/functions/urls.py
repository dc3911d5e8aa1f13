"""URL rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswork.functions.text import or_empty, strip

# Accepted image suffixes and the suffix used for all others.
IMAGE_SUFFIXES = "jpg|jpeg|png|gif|webp"
DEFAULT_SUFFIX = ".jpg"

# Parts of an image URL that keep it from being fetched, and parts
# that make a stored image URL worth repairing.
UNFETCHABLE_MARKS = "svg|logo|icon"
SUSPICIOUS_MARKS = "logo|svg|author|w=90"


def domain(url: Column) -> Column:
    """Authority without a leading ``www.``; '' when the URL has none."""
    authority = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.regexp_replace(authority, r"^www[.]", "")


def source_label(url: Column) -> Column:
    """First label of the domain, capitalised."""
    return F.initcap(F.regexp_extract(domain(url), "([^.]+)", 1))


def source_or_domain(name: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), domain(url))


def absolute_link(href: Column, base: Column) -> Column:
    return F.when(F.startswith(href, F.lit("http")), href).otherwise(F.concat(base, href))


def has_http_scheme(url: Column) -> Column:
    return F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://"))


def absolute_image(url: Column, base: Column) -> Column:
    return (
        F.when(has_http_scheme(url), url)
        .when(F.startswith(url, F.lit("/")), F.concat(base, url))
        .otherwise(F.concat(base, F.lit("/"), url))
    )


def with_https(url: Column) -> Column:
    """Give a scheme-less ``//host/...`` URL the https scheme."""
    return F.when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).otherwise(url)


def without_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def srcset_first(srcset: Column) -> Column:
    return F.substring_index(srcset, " ", 1)


def image_suffix(url: Column) -> Column:
    path = F.regexp_extract(
        F.lower(without_query(url)),
        r"^(?:[a-z][a-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*?)(?:;[^/?#]*)?(?:[?#]|$)", 1)
    found = F.regexp_extract(path, rf"[^/.][^/]*([.](?:{IMAGE_SUFFIXES}))$", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(DEFAULT_SUFFIX))


def valid_image_url(url: Column) -> Column:
    u = F.lower(strip(url))
    ok = (
        has_http_scheme(u)
        & ~F.contains(u, F.lit("base64"))
        & ~F.endswith(u, F.lit(".svg"))
    )
    return F.coalesce(ok, F.lit(False))


def image_fetchable(url: Column) -> Column:
    bare = without_query(url)
    ok = has_http_scheme(url) & ~F.lower(bare).rlike(UNFETCHABLE_MARKS)
    return F.coalesce(ok, F.lit(False))


def image_suspicious(url: Column) -> Column:
    return (or_empty(url) == "") | F.lower(url).rlike(SUSPICIOUS_MARKS)

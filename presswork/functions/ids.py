"""Identifiers and the asset paths derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswork.functions.text import or_empty
from presswork.functions.urls import DEFAULT_SUFFIX, image_fetchable, image_suffix


def article_id(title: Column, url: Column) -> Column:
    """Hex MD5 of title followed by URL, nothing in between."""
    return F.md5(F.concat(or_empty(title), or_empty(url)))


def record_id(day: Column, url: Column) -> Column:
    """``yyyyMMdd_`` and eight hex digits, the digits taken from the URL."""
    return F.concat(F.date_format(day, "yyyyMMdd"), F.lit("_"), F.substring(F.md5(or_empty(url)), 1, 8))


def image_path(id_: Column, image_url: Column) -> Column:
    """Where the image of an article lives.

    '' without an image URL; a URL that must not be fetched is replaced by a
    stand-in image, which always has the default suffix.
    """
    suffix = F.when(image_fetchable(image_url), image_suffix(image_url)).otherwise(F.lit(DEFAULT_SUFFIX))
    path = F.concat(F.lit("images/"), id_, suffix)
    return F.when(or_empty(image_url) == "", F.lit("")).otherwise(path)


def content_path(id_: Column) -> Column:
    return F.concat(F.lit("content/"), id_, F.lit(".txt"))


def public_url(path: Column, prefix: str) -> Column:
    """``prefix`` + path for a non-empty path, else ''."""
    return F.when(or_empty(path) != "", F.concat(F.lit(prefix), path)).otherwise(F.lit(""))

"""Checks on fetched image bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Byte signatures (hex) and the smallest accepted size.
JPEG_HEX = "FFD8"
PNG_HEX = "89504E470D0A1A0A"
GIF_HEX = ["474946383761", "474946383961"]
WEBP_MARK = "57454250"
MIN_IMAGE_BYTES = 5000


def image_kind(content: Column) -> Column:
    """jpeg, png, gif or webp by signature, null for anything else.

    The hex text is searched at even offsets only, where bytes start.
    """
    head = F.hex(F.substring(content, 1, 20))
    return (
        F.when(F.startswith(head, F.lit(JPEG_HEX)), F.lit("jpeg"))
        .when(F.startswith(head, F.lit(PNG_HEX)), F.lit("png"))
        .when(head.rlike(f"^(?:{'|'.join(GIF_HEX)})"), F.lit("gif"))
        .when(head.rlike(f"^(?:..)*{WEBP_MARK}"), F.lit("webp"))
    )


def image_type_ok(content_type: Column) -> Column:
    ok = F.startswith(content_type, F.lit("image/")) & (content_type != "image/svg+xml")
    return F.coalesce(ok, F.lit(False))


def image_ok(content_type: Column, content: Column, length: Column) -> Column:
    return F.coalesce(
        image_type_ok(content_type) & image_kind(content).isNotNull() & (length >= MIN_IMAGE_BYTES),
        F.lit(False))

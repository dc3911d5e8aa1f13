"""Batch repairs, content backfill and stand-in images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.functions import text as X
from presswork.functions import urls as U
from presswork.functions.ids import image_path
from presswork.plans import skew

# The stand-in image of each source, and the pool for all others.
SOURCE_IMAGES = {
    "IGN": "https://static1.thegamerimages.com/wordpress/wp-content/uploads/2022/07/ign-logo.jpg",
    "GameSpot": "https://static0.gamerantimages.com/wordpress/wp-content/uploads/2022/07/gamespot-logo.jpg",
    "PCGamer": "https://static1.thegamerimages.com/wordpress/wp-content/uploads/2022/07/pc-gamer-logo.jpg",
    "Eurogamer": "https://static0.gamerantimages.com/wordpress/wp-content/uploads/2022/07/eurogamer-logo.jpg",
    "Polygon": "https://static1.thegamerimages.com/wordpress/wp-content/uploads/2022/07/polygon-logo.jpg",
    "Kotaku": "https://static0.gamerantimages.com/wordpress/wp-content/uploads/2022/07/kotaku-logo.jpg",
    "GameRant": "https://static1.thegamerimages.com/wordpress/wp-content/uploads/2022/07/gamerant-logo.jpg",
    "TheGamer": "https://static0.gamerantimages.com/wordpress/wp-content/uploads/2022/07/thegamer-logo.jpg",
    "WCCFTech": "https://static1.thegamerimages.com/wordpress/wp-content/uploads/2022/07/wccftech-logo.jpg",
    "Engadget": "https://static0.gamerantimages.com/wordpress/wp-content/uploads/2022/07/engadget-logo.jpg",
}
IMAGE_POOL = [
    "https://static0.gamerantimages.com/wordpress/wp-content/uploads/2022/06/elder-scrolls-6-release-date-trailer-gameplay-setting-news.jpg",
    "https://static1.thegamerimages.com/wordpress/wp-content/uploads/2023/01/best-games-2023.jpg",
    "https://static0.gamerantimages.com/wordpress/wp-content/uploads/2022/12/most-anticipated-games-2023.jpg",
    "https://static1.thegamerimages.com/wordpress/wp-content/uploads/2022/06/ps5-games-coming-soon.jpg",
    "https://static0.gamerantimages.com/wordpress/wp-content/uploads/2022/09/xbox-series-x-games-coming-soon.jpg",
    "https://static1.thegamerimages.com/wordpress/wp-content/uploads/2022/12/nintendo-switch-games-coming-soon.jpg",
    "https://static0.gamerantimages.com/wordpress/wp-content/uploads/2022/08/pc-games-coming-soon.jpg",
    "https://static1.thegamerimages.com/wordpress/wp-content/uploads/2022/07/best-gaming-news-sites.jpg",
]

# The sources that are repaired, their default and generic titles.
IMAGE_REPAIR_SOURCE = "GameRant"
IMAGE_REPAIR_DEFAULT = IMAGE_POOL[0]
TITLE_REPAIR_SOURCE = "TheGamer"
GENERIC_TITLES = ["TheGamer", "The Gamer"]
PREVIEW_PREFIX = "TheGamer Article: "


def repair_images(df: DataFrame, source: str = IMAGE_REPAIR_SOURCE, default: str = IMAGE_REPAIR_DEFAULT) -> DataFrame:
    """Replace missing or suspicious images of one source; ``repaired`` marks them."""
    bad = F.coalesce((F.col("source_name") == source) & U.image_suspicious(F.col("image_url")), F.lit(False))
    marked = df.withColumn("repaired", bad)
    fixed = F.when(F.col("repaired"), F.lit(default)).otherwise(F.col("image_url"))
    columns = {"image_url": fixed}
    if "local_image_path" in df.columns:
        columns["local_image_path"] = F.when(
            F.col("repaired"), image_path(F.col("id"), F.lit(default))).otherwise(F.col("local_image_path"))
    return marked.withColumns(columns)


def count_repaired(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if("repaired").alias("n"))


def repair_titles(df: DataFrame, source: str = TITLE_REPAIR_SOURCE) -> DataFrame:
    """Replace the generic titles of one source by the URL slug or a content preview."""
    title, url, content = F.col("title"), F.col("source_url"), F.col("content")
    generic = (F.col("source_name") == source) & title.isin(GENERIC_TITLES)
    preview = F.concat(F.lit(PREVIEW_PREFIX), X.preview_title(content))
    better = (
        F.when(X.or_empty(url) != "", X.slug_title(url))
        .when(X.or_empty(content) != "", preview).otherwise(title))
    return df.withColumn("title", F.when(generic, better).otherwise(title))


def _with_side(articles: DataFrame, side: DataFrame, heavy_floor: int) -> DataFrame:
    """Articles with ``_side``, the content the side has for their id; one row for each article.

    The side is first cut down to the ids that are asked for, then to one content per
    id: of several the last in text order, so a blank one never wins. Texts meet the narrow
    rows in a shuffle; however few ids there are, no text is broadcast by number of rows.
    """
    counts = skew.key_counts(articles, "id")
    asked = side.join(counts.select("id"), "id", "left_semi").groupBy("id").agg(F.max("content").alias("_side"))
    return skew.attach_wide(articles, asked, "id", counts, "ingest_seq", heavy_floor)


def _split_blank(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    blank = X.is_blank(F.col("content"))
    return articles.filter(~blank), articles.filter(blank)


def content_from(articles: DataFrame, side: DataFrame, heavy_floor: int = skew.HEAVY_FLOOR) -> DataFrame:
    """Blank contents filled from the side dataset ``(id, content)``; others stay blank."""
    full, blank = _split_blank(articles)
    found = _with_side(blank.drop("content"), side, heavy_floor)
    return full.unionByName(found.withColumn("content", X.or_empty(F.col("_side"))).drop("_side"))


def with_default_body(articles: DataFrame) -> DataFrame:
    """Blank contents replaced by the wording of exports."""
    wording = F.format_string(X.EXPORT_BODY, F.coalesce("source_url", F.lit("Unknown source")))
    return articles.withColumn("content", F.when(X.is_blank(F.col("content")), wording).otherwise(F.col("content")))


def backfill_content(articles: DataFrame, side: DataFrame, heavy_floor: int = skew.HEAVY_FLOOR) -> DataFrame:
    """Fill blank contents from the side dataset, else with the default wording.

    Only blank articles meet the join: the others, which carry the wide texts, pass by
    without a shuffle. The side may hold several contents of an id.
    """
    return with_default_body(content_from(articles, side, heavy_floor))


def pool_place(id_: Column, size: int) -> Column:
    """A place in a pool of stand-ins, the same for an id at every run."""
    return F.pmod(F.conv(F.substring(F.md5(id_), 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int")


def stand_in_image(source: Column, id_: Column) -> Column:
    """The image of the source, or one of the pool by the article's id."""
    by_source = F.create_map(*(F.lit(x) for pair in SOURCE_IMAGES.items() for x in pair))
    pool = F.array(*map(F.lit, IMAGE_POOL))
    return F.coalesce(F.try_element_at(by_source, source), F.element_at(pool, pool_place(id_, len(IMAGE_POOL)) + 1))


def with_usable_image(df: DataFrame) -> DataFrame:
    """Image URLs that would not be fetched are replaced by stand-ins."""
    url = F.col("image_url")
    return df.withColumn("image_url", F.when(
        X.or_empty(url) == "", F.lit("")).when(U.image_fetchable(url), url).otherwise(
        stand_in_image(F.col("source_name"), F.col("id"))))

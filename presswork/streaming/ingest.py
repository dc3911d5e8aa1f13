"""Pages to store, as one batch or as a stream of new files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from presswork.operators.extract import articles
from presswork.plans.rules import Site
from presswork.schema import PAGE_SCHEMA
from presswork.sources.files import export, export_days
from presswork.sources.pages import spread
from presswork.sources.store import ArticleStore

# Fixed value: how often a running ingest looks for new pages.
INTERVAL = "3 hours"


def ingest_pages(store: ArticleStore, pages: DataFrame, batch_id: int | None = None,
                 sites: Iterable[Site] | None = None, now: Column | None = None, **options) -> DataFrame:
    """Extract a page table and append what is new; returns the stored rows."""
    return store.add(articles(spread(pages), sites), batch_id, now, **options)


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark wrote into the checkpoint; a new checkpoint is a new writer."""
    return spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]


def page_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New files of a Parquet page table, which is a folder or one file."""
    reader = spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getFileStatus(target).isFile():
        return reader.option("pathGlobFilter", target.getName()).parquet(target.getParent().toString())
    return reader.parquet(path)


def start_ingest(store: ArticleStore, pages: DataFrame, checkpoint: str, once: bool = False,
                 sites: Iterable[Site] | None = None, now: Column | None = None,
                 export_to: str | None = None, export_days_to: str | None = None) -> StreamingQuery:
    """Ingest a page stream into the store.

    Keys never expire, so the store itself is the state: each micro-batch is
    de-duplicated against all other batches. The stream writes under the id of its
    checkpoint and the number of its batch, which the store takes once, so a replay is
    harmless and batch jobs and other streams may fill the same store. ``once`` takes what
    is there and stops. With ``export_to`` every batch is followed by an export into a
    folder of its own, so nobody reads a folder while it is replaced; the history names
    the newest. ``export_days_to`` keeps an export by days, of which a batch rewrites
    those it adds to.
    """
    store.create()

    def add(batch: DataFrame, batch_id: int) -> None:
        writer = _stream_id(store.spark, checkpoint)
        added = ingest_pages(store, batch, batch_id + 1, sites, now, writer=writer)
        if export_to is not None:
            export(store, f"{export_to.rstrip('/')}/{writer}/batch-{batch_id + 1}", now=now)
        if export_days_to is not None:
            export_days(store, export_days_to, added, now=now)

    writer = pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": INTERVAL}
    return writer.trigger(**trigger).start()

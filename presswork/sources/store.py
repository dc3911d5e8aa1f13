"""The article store: Parquet parts, a key index, and commits that say which are valid.

Every batch brings a part of articles, a part of the key index and a part of counts, and
becomes visible by one commit (``sources/commits.py``). Readers take the list of parts of
the newest commit; parts are never changed, so nobody reads half of anything.

The key index has one row for each (kind, key) of the stored articles, in buckets by the
hash of the key; a part has a bucket for every ``keys_per_bucket`` of its keys. A batch
reads the buckets that its own keys fall into, so what it reads follows the batch, not
the store. Parts are merged as they become many: the index and the counts by tiers, so
that there are logarithmically many of them, the articles up to parts of ``part_rows``.

Writers may run at the same time. Each works out its new articles against the state it
found; if another commit came first, it looks up its remaining records in the index parts
added since, decides again and tries the next number. So the store is what the same
batches give one after the other, in the order of their commits.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.functions.ids import article_id
from presswork.operators.dedup import SEQ, TITLE, URL, Undecided, key_columns, keep_rows
from presswork.operators.repair import content_from
from presswork.schema import ARTICLE_SCHEMA, HISTORY_SCHEMA
from presswork.session import scratch_path
from presswork.sources.commits import CommitLog

WRITER, BATCH = "writer", "batch_id"
# The writer of batches that name no other.
BATCH_JOBS = "batch"
_PLACE = [T.StructField(WRITER, T.StringType()), T.StructField(BATCH, T.LongType())]
STORE_SCHEMA = T.StructType([*ARTICLE_SCHEMA.fields, *_PLACE])
# A staged batch has the bytes of each row's texts beside it.
SIZE = "_bytes"
_STAGED_SCHEMA = T.StructType([*ARTICLE_SCHEMA.fields, T.StructField(SIZE, T.LongType())])
METRICS_SCHEMA = T.StructType([T.StructField("source_name", T.StringType()), T.StructField("total", T.LongType()), *_PLACE])
# ``key`` is the MD5 of the key's text, ``bucket`` the part's folder of it.
KEY_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("key", T.BinaryType()), T.StructField("bucket", T.IntegerType())])

# Keys in a bucket, articles in a part that is merged no further, parts of a size that are merged.
KEYS_PER_BUCKET = 1_000_000
PART_ROWS = 4_000_000
FAN = 8
# Rows and bytes of text in a file, and row groups small enough to be worth skipping.
FILE_ROWS = 500_000
FILE_BYTES = 128 << 20
# Lookups by id or URL skip row groups by these filters, listings by the order of the rows.
_SKIPPING = {
    "parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.enabled#source_url": "true",
    "parquet.bloom.filter.adaptive.enabled": "true", "parquet.block.size": str(16 << 20)}
_EMPTY = {"version": 0, "last_seq": -1, "writers": {}, "articles": [], "keys": [], "metrics": []}


class ArticleStore:
    """Paths and operations of one store below ``root``."""

    def __init__(self, spark: SparkSession, root: str, keys_per_bucket: int = KEYS_PER_BUCKET,
                 part_rows: int = PART_ROWS, fan: int = FAN):
        self.spark = spark
        self.root = root.rstrip("/")
        self.history_path = f"{self.root}/export_history"
        self.log = CommitLog(spark, f"{self.root}/commits")
        self.keys_per_bucket, self.part_rows, self.fan = keys_per_bucket, part_rows, fan

    # -- state ------------------------------------------------------------------

    def _exists(self, path: str) -> bool:
        system, target = self.log.file_system(path)
        return system.exists(target)

    def _delete(self, path: str) -> None:
        system, target = self.log.file_system(path)
        system.delete(target, True)

    def create(self) -> "ArticleStore":
        """The first commit and an empty history, unless they are there."""
        if self.log.latest() is None:
            self.log.commit(_EMPTY)
        if not self._exists(self.history_path):
            self.spark.createDataFrame([], HISTORY_SCHEMA).write.mode("ignore").parquet(self.history_path)
        return self

    def state(self) -> dict:
        found = self.log.latest()
        if found is None:
            raise FileNotFoundError(f"no store at {self.root}: create() makes one")
        return found

    def clear(self, *side_data: str) -> None:
        """An empty store from the next commit on, and an empty history.

        ``side_data`` are the folders of the contents and images that belong to the
        articles; they are removed. Parts of the old state stay until ``vacuum``.
        """
        while not self.log.commit({**_EMPTY, "version": self.state()["version"] + 1}):
            pass
        self.spark.createDataFrame([], HISTORY_SCHEMA).write.mode("overwrite").parquet(self.history_path)
        for path in side_data:
            self._delete(path)

    def _read(self, parts: list[dict], schema: T.StructType) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/{p['path']}" for p in parts]
        # Folders below this one are columns: parts of the index have their buckets there.
        base = paths[0].rsplit("/", 1)[0]
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*schema.names)

    def with_batches(self, state: dict | None = None) -> DataFrame:
        """All articles with the writer and batch that brought them."""
        return self._read((state or self.state())["articles"], STORE_SCHEMA)

    def articles(self) -> DataFrame:
        return self.with_batches().drop(WRITER, BATCH)

    def history(self) -> DataFrame:
        return self.spark.read.schema(HISTORY_SCHEMA).parquet(self.history_path)

    def next_batch(self, writer: str = BATCH_JOBS) -> int:
        """The number after the writer's last committed batch."""
        return self.state()["writers"].get(writer, 0) + 1

    # -- the key index ----------------------------------------------------------

    def _write_keys(self, keys: DataFrame, rows: int) -> dict:
        """An index part of ``(kind, key)`` rows."""
        buckets = 1 << max(-(-rows // self.keys_per_bucket) - 1, 0).bit_length()
        path = f"keys/part={uuid.uuid4().hex}"
        dealt = keys.select("kind", "key", _bucket(F.col("key"), buckets).alias("bucket"))
        # Only keys travel: they are worked out where the articles are read.
        dealt = dealt.repartition(1) if buckets == 1 else dealt.repartition("bucket")
        dealt.write.partitionBy("bucket").parquet(f"{self.root}/{path}")
        return {"path": path, "rows": rows, "buckets": buckets}

    def known_keys(self, keys: DataFrame, parts: list[dict]) -> DataFrame:
        """The rows of ``keys``, by ``(kind, key)``, that the index parts have.

        Reads the buckets that ``keys`` fall into. What is collected is their numbers,
        at most one for every ``keys_per_bucket`` rows of the largest part.
        """
        most = max((p["buckets"] for p in parts), default=0)
        if not most:
            return keys.limit(0)
        hit = {r[0] for r in keys.select(_bucket(F.col("key"), most)).distinct().collect()}
        found = []
        for buckets in sorted({p["buckets"] for p in parts}):
            wanted = sorted({b % buckets for b in hit})
            have = self._read([p for p in parts if p["buckets"] == buckets], KEY_SCHEMA)
            found.append(have.filter(F.col("bucket").isin(wanted)).select("kind", "key"))
        return keys.join(reduce(DataFrame.unionByName, found), ["kind", "key"], "left_semi")

    # -- adding -----------------------------------------------------------------

    def begin(self, batch: DataFrame, batch_id: int | None = None, now: Column | None = None,
              writer: str = BATCH_JOBS, content: DataFrame | None = None, **options) -> "Pending":
        """Work ``batch`` out against the state of now; its ``commit`` makes it part of the store."""
        return Pending(self, batch, batch_id, now, writer, content, **options)

    def add(self, batch: DataFrame, batch_id: int | None = None, now: Column | None = None,
            writer: str = BATCH_JOBS, content: DataFrame | None = None, **options) -> DataFrame:
        """Append what is new in ``batch`` and return it as stored.

        Rows are numbered anew in the order of their ``ingest_seq``, after all that the
        store has, so the numbers of the whole store are unique. Blank contents are looked
        up in ``content(id, content)``. A ``batch_id`` that is not above the writer's last
        one is a batch that runs again: nothing is added, what it brought is returned.
        """
        pending = self.begin(batch, batch_id, now, writer, content, **options)
        added = pending.commit()
        self.merge_parts()
        return added

    # -- merging ----------------------------------------------------------------

    def _due(self, parts: list[dict], most_rows: int | None) -> list[dict]:
        """``fan`` parts of one size class, the smallest class that has so many; full ones stay."""
        tiers: dict[int, list[dict]] = {}
        for part in parts:
            if most_rows is None or part["rows"] < most_rows:
                tier, size = 0, part["rows"]
                while size >= self.fan:
                    tier, size = tier + 1, size // self.fan
                tiers.setdefault(tier, []).append(part)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fan), [])

    def merge_parts(self) -> int:
        """Merge parts until no kind has ``fan`` of a size; returns the number of merges.

        A merge that finds one of its parts gone, because somebody else merged it, is dropped.
        """
        merges = 0
        for kind, write, most in (("articles", self._merge_articles, self.part_rows), ("keys", self._merge_keys, None),
                                  ("metrics", self._merge_metrics, None)):
            while due := self._due(self.state()[kind], most):
                merged, paths = write(due), {p["path"] for p in due}
                while True:
                    state = self.state()
                    if not paths <= {p["path"] for p in state[kind]}:
                        break
                    rest = [p for p in state[kind] if p["path"] not in paths]
                    if self.log.commit({**state, "version": state["version"] + 1, kind: [*rest, merged]}):
                        merges += 1
                        break
        return merges

    def _merge_articles(self, parts: list[dict]) -> dict:
        rows = self._read(parts, STORE_SCHEMA)
        return self._write_articles(rows, sum(p["rows"] for p in parts), rows.agg(F.sum(_text_bytes())).first()[0])

    def _write_articles(self, rows: DataFrame, count: int, size: int) -> dict:
        """A part of ``count`` rows with ``size`` bytes of text."""
        path = f"articles/{uuid.uuid4().hex}"
        _laid_out(rows, count, size).write.options(**_SKIPPING).parquet(f"{self.root}/{path}")
        return {"path": path, "rows": count}

    def _merge_keys(self, parts: list[dict]) -> dict:
        return self._write_keys(self._read(parts, KEY_SCHEMA), sum(p["rows"] for p in parts))

    def _merge_metrics(self, parts: list[dict]) -> dict:
        return self._write_metrics(self._read(parts, METRICS_SCHEMA), sum(p["rows"] for p in parts))

    def _write_metrics(self, rows: DataFrame, count: int) -> dict:
        path = f"metrics/{uuid.uuid4().hex}"
        rows.coalesce(max(-(-count // FILE_ROWS), 1)).write.parquet(f"{self.root}/{path}")
        return {"path": path, "rows": count}

    def vacuum(self, hours: float = 168) -> int:
        """Remove parts that the newest state lacks and that are older than ``hours``; returns their number.

        Readers and writers that began before that need them no more; commits stay, they are small.
        """
        state, removed = self.state(), 0
        valid = {p["path"] for kind in ("articles", "keys", "metrics") for p in state[kind]}
        limit = self.spark._jvm.java.lang.System.currentTimeMillis() - int(hours * 3_600_000)
        for kind in ("articles", "keys", "metrics"):
            system, folder = self.log.file_system(f"{self.root}/{kind}")
            for found in system.listStatus(folder) if system.exists(folder) else []:
                name = f"{kind}/{found.getPath().getName()}"
                if name not in valid and found.getModificationTime() < limit:
                    system.delete(found.getPath(), True)
                    removed += 1
        return removed

    # -- counts -----------------------------------------------------------------

    def metrics_by_source(self) -> DataFrame:
        """writer, batch_id, source_name, records seen and records added, the latter counted in the store."""
        state = self.state()
        kept = self.with_batches(state).groupBy(WRITER, BATCH, "source_name").agg(F.count("*").alias("added"))
        seen = self._read(state["metrics"], METRICS_SCHEMA)
        return seen.join(kept, [WRITER, BATCH, "source_name"], "left").select(
            WRITER, BATCH, "source_name", "total", F.coalesce("added", F.lit(0)).alias("added"))

    def metrics(self) -> DataFrame:
        """writer, batch_id, records seen and records added."""
        return self.metrics_by_source().groupBy(WRITER, BATCH).agg(
            F.sum("total").alias("total"), F.sum("added").alias("added"))


class Pending:
    """A batch that is worked out against one state of a store.

    The batch is computed once, into a scratch table in the shared folder; its keys, its
    counts and its accepted rows are then column-pruned reads.
    """

    def __init__(self, store: ArticleStore, batch: DataFrame, batch_id: int | None, now: Column | None,
                 writer: str, content: DataFrame | None, broadcast_rows: int | None = None, **options):
        self.store, self.writer, self.batch_id = store, writer, batch_id
        self.keep = {} if broadcast_rows is None else {"broadcast_rows": broadcast_rows}
        self.seen: set[str] = set()
        self.staged = scratch_path(store.spark, "batch")
        if self._done(store.state()):
            return
        rows = article_rows(batch, now)
        rows = rows if content is None else content_from(rows, content)
        with_ingest_seq(rows, SEQ, "source_url", "title").select(
            *ARTICLE_SCHEMA.names, _text_bytes().alias(SIZE)).write.parquet(self.staged)
        self.rows = store.spark.read.schema(_STAGED_SCHEMA).parquet(self.staged)
        self.undecided = Undecided(self.rows, **options)
        self._look_up(store.state())

    def _done(self, state: dict) -> bool:
        return self.batch_id is not None and self.batch_id <= state["writers"].get(self.writer, 0)

    def _look_up(self, state: dict) -> None:
        """Leave out the records whose keys the index parts not seen before have."""
        parts = [p for p in state["keys"] if p["path"] not in self.seen]
        self.seen |= {p["path"] for p in parts}
        if not parts:
            return
        texts = self.undecided.rows.select(F.explode(_texts()).alias("k")).select("k.*").filter("key is not null").distinct()
        texts = texts.checkpoint()
        known = self.store.known_keys(texts, parts).checkpoint()
        self.undecided.drop_known({
            key: known.filter(F.col("kind") == kind).select(F.col("text").alias(key)) for kind, key in (("u", URL), ("t", TITLE))})

    def commit(self) -> DataFrame:
        """Store what is new and return it as stored; again after every commit that came first."""
        store = self.store
        while True:
            state = store.state()
            if self._done(state):
                own = (F.col(WRITER) == self.writer) & (F.col(BATCH) == self.batch_id)
                added = store.with_batches(state).filter(own)
                break
            self._look_up(state)
            batch_id = state["writers"].get(self.writer, 0) + 1 if self.batch_id is None else self.batch_id
            place = [F.lit(self.writer).alias(WRITER), F.lit(batch_id).cast("long").alias(BATCH)]
            accepted = self.undecided.settle().checkpoint()
            fresh = keep_rows(self.rows, accepted, **self.keep)
            numbered = (F.col(SEQ) + (state["last_seq"] + 1)).alias(SEQ)
            parts, count = {"articles": [], "keys": [], "metrics": []}, accepted.count()
            if count:
                # Reads the numbers and sizes of the rows only.
                size = fresh.agg(F.sum(SIZE)).first()[0]
                part = store._write_articles(fresh.select(numbered, *ARTICLE_SCHEMA.names[1:], *place), count, size)
                parts["articles"].append(part)
                stored = store._read([part], STORE_SCHEMA)
                last = stored.agg(F.max(SEQ)).first()[0]
                # A title key that is null is none; urls are unique here, and so are titles.
                keys = stored.select(*key_columns()).select(F.explode(_texts()).alias("k")).select("k.kind", "k.key")
                keys = keys.filter("key is not null")
                parts["keys"].append(store._write_keys(keys, keys.count()))
            totals = self.rows.groupBy("source_name").agg(F.count("*").alias("total")).select("source_name", "total", *place)
            totals = totals.checkpoint()
            if sources := totals.count():
                parts["metrics"].append(store._write_metrics(totals, sources))
            if store.log.commit({
                    **state, "version": state["version"] + 1, "last_seq": last if count else state["last_seq"],
                    "writers": {**state["writers"], self.writer: batch_id},
                    **{kind: [*state[kind], *new] for kind, new in parts.items()}}):
                added = store._read(parts["articles"], STORE_SCHEMA)
                break
            for part in sum(parts.values(), []):
                store._delete(f"{store.root}/{part['path']}")
        store._delete(self.staged)
        return added


def _text_bytes() -> Column:
    """Bytes of the texts of a row."""
    texts = (f.name for f in ARTICLE_SCHEMA.fields if f.dataType == T.StringType())
    return reduce(Column.__add__, (F.coalesce(F.octet_length(t), F.lit(0)).cast("long") for t in texts))


def _laid_out(rows: DataFrame, count: int, size: int) -> DataFrame:
    """Rows by source and time, newest first, dealt into files of bounded rows and bytes.

    The rows are read in as many tasks as their table has splits, however few files they make.
    """
    files = max(-(-count // FILE_ROWS), -(-size // FILE_BYTES), 1)
    order = ["source_name", F.desc("scrape_timestamp"), SEQ]
    dealt = rows.repartition(1) if files == 1 else rows.repartitionByRange(files, *order)
    return dealt.sortWithinPartitions(*order)


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _texts() -> Column:
    """The keys of a record as ``(kind, key, text)``; a record's own number in place of a title is none."""
    def one(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.unhex(F.md5(text)).alias("key"), text.alias("text"))

    title = F.when(~F.startswith(F.col(TITLE), F.lit("#")), F.col(TITLE))
    return F.array(one("u", F.col(URL)), one("t", title))


def article_rows(batch: DataFrame, now: Column | None = None) -> DataFrame:
    """The batch in the store's schema: missing texts are '', the id is derived."""
    def one(field: T.StructField) -> Column:
        if field.name == "id":
            return article_id(F.col("title"), F.col("source_url")).alias("id")
        if field.name == "scrape_timestamp":
            if now is not None or field.name not in batch.columns:
                return (F.current_timestamp() if now is None else now).alias(field.name)
            return F.coalesce(F.col(field.name), F.current_timestamp()).alias(field.name)
        if field.name not in batch.columns:
            return F.lit("").cast(field.dataType).alias(field.name)
        if field.dataType == T.StringType():
            return F.coalesce(F.col(field.name), F.lit("")).alias(field.name)
        return F.col(field.name).cast(field.dataType).alias(field.name)

    return batch.select(*(one(f) for f in ARTICLE_SCHEMA.fields))


def with_ingest_seq(df: DataFrame, *order: str, start: int = 0) -> DataFrame:
    """Number rows in the given order: growing, unique, not without gaps."""
    return df.orderBy(*order).withColumn("ingest_seq", F.monotonically_increasing_id() + F.lit(start))

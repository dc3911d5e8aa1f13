"""Exact first-come de-duplication.

A record is rejected when its URL, or its (title, source) with both non-empty,
belongs to an *accepted* record: one of the store or an earlier one of the batch.
Rejected records claim nothing, so neither one pass per key nor connected
components give the right answer. Seen as a graph, URLs and titles are nodes and
records are edges; the accepted records are the greedy matching in ingest order.

It is found in rounds (Blelloch, Fineman, Shun: "Greedy sequential maximal
independent set and matching are parallel on average", SPAA 2012): accept every
record that is the earliest at both its keys, drop the records that share a key
with it, repeat on the rest. Rounds grow with the logarithm squared of the batch
for records in random order. What is left after a few rounds has long chains of
alternating keys; they are settled by pointer doubling.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.functions.text import or_empty
from presswork.plans import skew
from presswork.session import ensure_checkpoint_dir

SEQ, URL, TITLE = "ingest_seq", "_url", "_title"


def url_key(url: Column) -> Column:
    """A missing URL counts as the empty URL."""
    return or_empty(url)


def title_key(title: Column, source: Column) -> Column:
    """Title and source as one text, null when either is empty."""
    both = (or_empty(title) != "") & (or_empty(source) != "")
    return F.when(both, F.concat(F.length(source).cast("string"), F.lit(":"), source, title))


def key_columns() -> list[Column]:
    return [
        url_key(F.col("source_url")).alias(URL),
        title_key(F.col("title"), F.col("source_name")).alias(TITLE)]


def _with_own_title(rows: DataFrame) -> DataFrame:
    """A record without a title key gets one of its own.

    Later steps then meet neither nulls nor one large group of them.
    """
    own = F.concat(F.lit("#"), F.col(SEQ).cast("string"))
    return rows.withColumn(TITLE, F.coalesce(F.col(TITLE), own))


def _collapsed(batch: DataFrame) -> DataFrame:
    """The earliest record of each (URL, title) pair; no other can be accepted.

    Copies collapse before the shuffle.
    """
    pairs = batch.select(SEQ, *key_columns()).groupBy(URL, TITLE).agg(F.min(SEQ).alias(SEQ))
    return _with_own_title(pairs)


def _known(store_keys: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Store keys that occur in the batch.

    The batch is the small side of this semi join, so Spark can broadcast it or
    push a filter built from it into the store scan; the store is not shuffled
    against a few new rows.
    """
    wanted = pairs.select(key).distinct()
    return store_keys.filter(F.col(key).isNotNull()).join(wanted, key, "left_semi").distinct()


class Undecided:
    """The earliest records of the (URL, title) pairs of a batch that nothing has decided yet.

    Only keys travel: ``ingest_seq`` (unique), the URL and the title key. Every step is
    cut off from its lineage by a reliable checkpoint.
    """

    def __init__(self, batch: DataFrame, heavy_floor: int = skew.HEAVY_FLOOR):
        ensure_checkpoint_dir(batch.sparkSession)
        self.rows = _collapsed(batch).checkpoint()
        total = self.rows.count()
        self.heavy = {key: skew.heavy_or_none(self.rows, total, key, heavy_floor) for key in (URL, TITLE)}

    def drop_known(self, known: dict[str, DataFrame]) -> None:
        """Leave out the records with a URL of ``known[URL]`` or a title key of ``known[TITLE]``, each key once."""
        for key in (URL, TITLE):
            self.rows = skew.drop_matching(self.rows, known[key], key, self.heavy[key], SEQ)
        self.rows = self.rows.checkpoint()

    def settle(self, max_rounds: int | None = None) -> DataFrame:
        """``ingest_seq`` of the records that win; decides on all of them."""
        steps = _Steps(max_rounds)
        rest, won = self.rows, []
        while not rest.isEmpty():
            steps.one_more()
            first = {key: rest.groupBy(key).agg(F.min(SEQ).alias(SEQ)) for key in (URL, TITLE)}
            winners = first[URL].join(first[TITLE], SEQ).checkpoint()
            if len(won) >= PLAIN_ROUNDS:
                winners = _chain_winners(rest, first, winners, steps)
            won.append(winners)
            for key in (URL, TITLE):
                rest = skew.drop_matching(rest, winners, key, self.heavy[key], SEQ)
            rest = rest.checkpoint()
        return reduce(DataFrame.unionByName, [w.select(SEQ) for w in won]) if won else rest.select(SEQ)


# Rounds before chains are looked for; records in random order rarely need more.
PLAIN_ROUNDS = 3


class _Steps:
    """Counts the steps that end in a checkpoint."""

    def __init__(self, most: int | None):
        self.most, self.count = most, 0

    def one_more(self) -> None:
        if self.most is not None and self.count >= self.most:
            raise RuntimeError(f"undecided records after {self.most} rounds")
        self.count += 1


def _chain_winners(rest: DataFrame, first: dict[str, DataFrame], winners: DataFrame, steps: _Steps) -> DataFrame:
    """``winners`` and all records that a chain of single rivals leads back to one of them.

    A record that is the second at one of its keys and the first at the other has one
    earlier rival, and wins exactly when this rival doesn't. Such records point at their
    rivals; the pointers are doubled until they reach a record with no such pointer, so a
    chain of any length takes the logarithm of it. A record wins at an even distance
    from a winner.
    """
    links = []
    for key, other in ((URL, TITLE), (TITLE, URL)):
        later = rest.join(first[key].select(SEQ), SEQ, "left_anti")
        second = later.groupBy(key).agg(F.min(SEQ).alias("_own"))
        pairs = second.join(first[key], key).select(F.col("_own").alias(SEQ), F.col(SEQ).alias("_to"))
        links.append(pairs.join(first[other].select(SEQ), SEQ, "left_semi"))
    links = links[0].unionByName(links[1]).withColumn("_odd", F.lit(1)).checkpoint()
    while True:
        steps.one_more()
        on = links.select(F.col(SEQ).alias("_to"), F.col("_to").alias("_next"), F.col("_odd").alias("_more"))
        moved = links.join(on, "_to", "left").checkpoint()
        links = moved.select(SEQ, F.coalesce("_next", "_to").alias("_to"),
                             F.col("_odd").bitwiseXOR(F.coalesce("_more", F.lit(0))).alias("_odd"))
        if moved.filter("_next is not null").isEmpty():
            break
    good = links.filter("_odd = 0").join(winners.select(F.col(SEQ).alias("_to")), "_to", "left_semi").select(SEQ)
    return winners.unionByName(rest.join(good, SEQ, "left_semi").select(*winners.columns)).checkpoint()


def accepted_keys(batch: DataFrame, store: DataFrame | None = None,
                  heavy_floor: int = skew.HEAVY_FLOOR, max_rounds: int | None = None) -> DataFrame:
    """``ingest_seq`` of the accepted records.

    The batch needs ``ingest_seq`` (unique), ``source_url``, ``title`` and
    ``source_name``. ``max_rounds`` makes a longer run fail instead.
    """
    undecided = Undecided(batch, heavy_floor)
    if store is not None:
        stored = store.select(*key_columns())
        undecided.drop_known({key: _known(stored.select(key), undecided.rows, key) for key in (URL, TITLE)})
    return undecided.settle(max_rounds)


# Most sequence numbers (8 bytes each) that are broadcast.
BROADCAST_ROWS = 2_000_000


def keep_rows(batch: DataFrame, accepted: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The batch rows with an accepted ``ingest_seq``.

    A crawl mostly brings either few new records or few known ones. Whichever of
    the accepted and the rejected numbers are few is broadcast, and the wide rows
    are filtered where they are; only when both are many do they shuffle.
    """
    if accepted.count() <= broadcast_rows:
        return batch.join(F.broadcast(accepted), SEQ, "left_semi")
    rejected = batch.select(SEQ).join(accepted, SEQ, "left_anti").checkpoint()
    if rejected.count() <= broadcast_rows:
        return batch.join(F.broadcast(rejected), SEQ, "left_anti")
    return batch.join(accepted, SEQ, "left_semi")


def greedy_dedup(batch: DataFrame, store: DataFrame | None = None,
                 broadcast_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """The accepted records of the batch, all columns."""
    return keep_rows(batch, accepted_keys(batch, store, **options), broadcast_rows)


def existing_in(batch: DataFrame, store: DataFrame, heavy_floor: int = skew.HEAVY_FLOOR) -> DataFrame:
    """``ingest_seq`` of the records whose URL, or title and source, the store has."""
    ensure_checkpoint_dir(batch.sparkSession)
    keys = _with_own_title(batch.select(SEQ, *key_columns())).checkpoint()
    stored = store.select(*key_columns())
    absent, total = keys, keys.count()
    for key in (URL, TITLE):
        known = _known(stored.select(key), keys, key)
        heavy = skew.heavy_or_none(keys, total, key, heavy_floor)
        absent = skew.drop_matching(absent, known, key, heavy, SEQ)
    return keys.select(SEQ).join(absent.select(SEQ), SEQ, "left_anti")


def merge_by_url(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All existing records plus the first new record of every unseen URL; a missing URL is the empty one."""
    keyed = new.select(SEQ, url_key(F.col("source_url")).alias(URL))
    firsts = keyed.groupBy(URL).agg(F.min(SEQ).alias(SEQ))
    # Copies of a frequent URL collapse before the join.
    seen = existing.select(url_key(F.col("source_url")).alias(URL)).distinct()
    added = firsts.join(seen, URL, "left_anti").select(SEQ)
    return existing.unionByName(new.join(added, SEQ, "left_semi"))

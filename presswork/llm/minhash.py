"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

Circulant MinHash (Li and Li, "C-MinHash", 2021): one permutation places the
shingles on a circle, a second one, shifted by k places, gives coordinate k. With
the second one as a table, the coordinates of a shingle are a run of neighbouring
entries, so a signature is the minimum over a few copied runs and 128 coordinates
cost little more than one.

32 bands of 4 rows miss a pair at Jaccard 0.75 with probability 5e-6.

From candidates to classes, without all pairs of a group:

1. Equal sets collapse to their smallest id.
2. Each shared band is a star: its members against its smallest id. Links are
   confirmed on the full sets and joined to components.
3. Members of a band that are still in different components are compared with each
   other where the prefix filter of exact set joins lets them. A pair inside one
   component can't change the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswork.llm import common as C
from presswork.llm.components import components
from presswork.llm.shingles import shingle_sets

CIRCLE_BITS = 22
BANDS, ROWS = 32, 4
WIDTH, PERCENT = 5, 75
PARITY = [f"p{i}" for i in range(8)]

_U = np.uint64
_circle: dict[int, np.ndarray] = {}


def _second_permutation(coordinates: int) -> np.ndarray:
    """Row i holds the ``coordinates`` entries from place i on, round the circle."""
    if coordinates not in _circle:
        table = np.random.Generator(np.random.PCG64(20240229)).permutation(1 << CIRCLE_BITS).astype(np.uint32)
        _circle[coordinates] = np.concatenate([table, table[:coordinates]])
    return np.lib.stride_tricks.sliding_window_view(_circle[coordinates], coordinates)


def _first_permutation(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of the circle's places."""
    mask = _U((1 << CIRCLE_BITS) - 1)
    x = (x * _U(0x2C1B3C6D) + _U(0x297A2D39)) & mask
    x ^= x >> _U(11)
    return (x * _U(0x1B873593)) & mask


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Coordinate k is the least second permutation, k places on, of any shingle's place."""
    places = _first_permutation(shingles >> _U(64 - CIRCLE_BITS))
    runs = _second_permutation(coordinates)
    out = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(places), 2048):
        np.minimum(out, runs[places[i:i + 2048]].min(axis=0), out=out)
    return out


def _band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures.reshape(-1, bands, rows).astype(_U)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=_U) * _U(0x9E3779B97F4A7C15), parts.shape[:2])
    for j in range(rows):
        keys = C.fmix(keys ^ parts[:, :, j])
    return keys


def _signer(bands: int, rows: int, width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.utf8(batch.column(1))
            n = len(batch)
            sizes, one, two = np.zeros(n, np.int64), np.zeros(n, _U), np.zeros(n, _U)
            sigs = np.zeros((n, bands * rows), np.uint32)
            for i, shingles in enumerate(shingle_sets(data, offsets, width)):
                sizes[i] = len(shingles)
                if len(shingles):
                    one[i] = C.fmix(shingles ^ _U(0x5BD1E995)).sum(dtype=_U)
                    two[i] = C.fmix(shingles ^ _U(0x7FEB352D)).sum(dtype=_U)
                    sigs[i] = signature(shingles, bands * rows)
            keys = _band_keys(sigs, bands, rows)
            keys = C.list_array(keys.view(np.int64).ravel(), np.full(n, bands), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), keys],
                ["doc_id", "n_shingles", "h1", "h2", "bands"])
    return sign


def _set_maker(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.utf8(batch.column(1))
            rows = list(shingle_sets(data, offsets, width))
            lengths = np.array([len(x) for x in rows], np.int64)
            flat = np.concatenate([np.zeros(0, _U), *rows]).view(np.int64)
            bits = np.array([_parity(x) for x in rows], np.int64).reshape(-1, len(PARITY))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), C.list_array(flat, lengths, pa.int64()), *(pa.array(b) for b in bits.T.copy())],
                ["doc_id", "shingles", *PARITY])
    return sets


def _parity(shingles: np.ndarray) -> np.ndarray:
    """512 bits, each the parity of the shingles that fall on it; sets differ in at least as many shingles as bits."""
    odd = np.bincount((shingles & _U(64 * len(PARITY) - 1)).astype(np.int64), minlength=64 * len(PARITY)) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _confirmer(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = [], []
            for column in batch.columns[2:4]:
                flat.append(column.flatten().to_numpy(zero_copy_only=False).view(_U))
                lengths = column.value_lengths().to_numpy(zero_copy_only=False)
                at.append(np.concatenate([[0], np.cumsum(lengths)]))
            keep = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                a, b = flat[0][at[0][i]:at[0][i + 1]], flat[1][at[1][i]:at[1][i + 1]]
                small, large = (a, b) if len(a) <= len(b) else (b, a)
                if not len(small) or 100 * len(small) < percent * len(large):
                    continue
                place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int((large[place] == small).sum())
                keep[i] = 100 * common >= percent * (len(a) + len(b) - common)
            if keep.any():
                yield batch.select([0, 1]).filter(pa.array(keep))
    return confirm


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets reach the threshold."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
            .mapInArrow(_confirmer(percent), "a long, b long"))


def _prefix_pairs(sets: DataFrame, apart: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that can reach the threshold, by the prefix filter.

    With shingles ordered by rarity, two sets that reach it share one of the first
    ``n - ceil(n * percent / 100) + 1`` of each. Shingles of one document come first and
    need no row; a document whose prefix holds nothing else is out. Of the pairs that
    meet, those go on whose sizes, places and parity bits allow the threshold.
    """
    rows = sets.join(apart, "doc_id").select("doc_id", "n_shingles", "component", F.explode("shingles").alias("s"))
    often = rows.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1")
    shared = rows.join(often, "s")
    alone = Window.partitionBy("doc_id")
    free = F.col("n_shingles") - F.count("*").over(alone)
    prefix = F.floor(F.col("n_shingles") * (100 - percent) / 100) + 1
    kept = shared.withColumn("place", F.row_number().over(alone.orderBy("df", "s")) + free).filter(F.col("place") <= prefix)
    kept = kept.select("doc_id", "n_shingles", "component", "s", "place").join(sets.select("doc_id", *PARITY), "doc_id")
    kept = C.staged(kept, "minhash-prefixes")
    x, y = kept.alias("x"), kept.alias("y")
    need = f"ceil({percent} * (x.n_shingles + y.n_shingles) / {100 + percent})"
    differ = " + ".join(f"bit_count(x.{p} ^ y.{p})" for p in PARITY)
    pairs = x.join(y, "s").filter(
        "x.doc_id > y.doc_id and x.component <> y.component"
        f" and 100 * least(x.n_shingles, y.n_shingles) >= {percent} * greatest(x.n_shingles, y.n_shingles)"
        f" and 1 + least(x.n_shingles - x.place, y.n_shingles - y.place) >= {need}"
        f" and {differ} <= x.n_shingles + y.n_shingles - 2 * {need}")
    return pairs.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH,
                    percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs(doc_id, text)``.

    Documents are linked when their sets of ``width``-word shingles have a Jaccard
    similarity of ``percent`` hundredths or more. ``component_id`` is the smallest id
    reachable over links, ``kept`` marks its owner.

    Null and empty texts have an empty set and no links. A row without an id has no
    component and is kept. Where an id stands on several rows, each row follows the
    class of its own text, and repeated rows give repeated results; if that id is the
    one that stands for its class, links of any of its texts count. Other columns are
    not read. An empty table gives an empty table.
    """
    signed = C.staged(docs.select("doc_id", "text").mapInArrow(
        _signer(bands, rows, width),
        "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"), "minhash-signatures")
    usable = signed.filter("n_shingles > 0 and doc_id is not null")

    firsts = usable.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    distinct = usable.join(firsts.withColumnRenamed("rep", "doc_id"), ["h1", "h2", "doc_id"], "left_semi")
    members = distinct.select(F.explode("bands").alias("band"), "doc_id", "n_shingles").distinct()
    stars = members.groupBy("band").agg(F.min("doc_id").alias("center"), F.count("*").alias("n")).filter("n > 1")
    members = C.staged(members.join(stars.select("band", "center"), "band"), "minhash-bands")

    wanted = members.select("doc_id").distinct()
    sets = C.staged(
        docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
        .mapInArrow(_set_maker(width), f"doc_id long, shingles array<long>, {', '.join(f'{p} long' for p in PARITY)}"),
        "minhash-sets")

    first = members.filter("doc_id <> center").select(F.col("doc_id").alias("a"), F.col("center").alias("b")).distinct()
    links = C.staged(_confirmed(first, sets, percent), "minhash-links")
    found = components(links)

    # Members of one band that the stars left apart.
    own = members.join(found, members.doc_id == found.node, "left").select(
        "band", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    split = own.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    apart = own.join(split.select("band"), "band", "left_semi").select("doc_id", "n_shingles", "component").distinct()
    pairs = _prefix_pairs(sets, C.staged(apart, "minhash-apart"), percent)
    more = C.staged(_confirmed(pairs, sets, percent), "minhash-more-links")
    if not more.isEmpty():
        found = components(links.unionByName(more))

    classes = firsts.join(found, firsts.rep == found.node, "left").select(
        "h1", "h2", F.coalesce("component", "rep").alias("component"))
    return _labelled(signed, classes)


def _labelled(signed: DataFrame, classes: DataFrame) -> DataFrame:
    rows = signed.select("doc_id", "n_shingles", "h1", "h2").join(classes, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return rows.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that another one of their class stands for.

    All columns stay. The ids to drop are joined to the texts, so the texts move once.
    """
    gone = near_duplicates(docs, **options).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)

"""Document fingerprints by winnowing, and their likeness.

Winnowing (Schleimer, Wilkerson, Aiken, SIGMOD 2003): hash every run of ``K``
characters, take the least hash of every window of ``W`` runs, the rightmost among
equals, and keep it with its place. Two texts that share ``W + K - 1`` characters in a
row share a fingerprint entry.

A text with at most ``W`` runs has one window over all of them; a text below ``K``
characters is one run by itself; the empty text has no entries.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm import common as C

K, W = 12, 24

_U = np.uint64
_LOW = _U(0xFFFFFFFF)
_CHARS = C.fmix(np.arange(1 << 16, dtype=_U) + _U(0x2545F4914F6CDD1D))
_SPACING = np.dtype([("hash", "<u4"), ("step", "<u2")])


@dataclass
class Prints:
    """Entries of one text: hashes and the places where their runs start."""

    hashes: np.ndarray
    places: np.ndarray

    def text(self) -> str:
        """Base64 of 4 bytes of hash and 2 bytes of distance to the entry before."""
        rows = np.zeros(len(self.places), _SPACING)
        rows["hash"] = self.hashes
        rows["step"] = np.diff(self.places, prepend=0)
        return base64.b64encode(rows.tobytes()).decode("ascii")


def parse(text: str) -> Prints:
    """The entries behind ``Prints.text``."""
    rows = np.frombuffer(base64.b64decode(text), _SPACING)
    return Prints(rows["hash"], np.cumsum(rows["step"], dtype=np.int64))


def _window_minima(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of ``keys[i:i+w]`` for each i, by doubling."""
    out, width = keys, 1
    while 2 * width <= w:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = w - width
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def fingerprints(texts: list[str], k: int = K, w: int = W) -> list[Prints]:
    """The winnowed entries of each text; ``w`` is below 65536."""
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    values = _CHARS[points & np.uint32(0xFFFF)]
    if len(points) and points.max() > 0xFFFF:
        values = np.where(points > 0xFFFF, C.fmix(points.astype(_U) + _U(0x2545F4914F6CDD1D)), values)
    prefix = C.prefix_hashes(values)
    at = np.arange(max(len(points) - k + 1, 0))
    place = at - np.repeat(starts[:-1], lengths)[:len(at)]
    keys = (C.span_hash(prefix, at, at + k) & ~_LOW) | (_LOW - place.astype(_U))
    minima = _window_minima(keys, w) if len(keys) >= w else keys[:0]
    fresh = np.ones(len(minima), bool)
    fresh[1:] = minima[1:] != minima[:-1]
    out = []
    for start, n in zip(starts[:-1].tolist(), lengths.tolist()):
        runs = n - k + 1
        if runs > w:
            own, new = minima[start:start + runs - w + 1], fresh[start:start + runs - w + 1].copy()
            new[0] = True
            picked = own[new]
        elif runs > 0:
            picked = keys[start:start + runs].min(keepdims=True)
        elif n:
            whole = C.span_hash(prefix, np.array([start]), np.array([start + n]))
            picked = (whole & ~_LOW) | _LOW
        else:
            picked = keys[:0]
        out.append(Prints((picked >> _U(32)).astype(np.uint32), (_LOW - (picked & _LOW)).astype(np.int64)))
    return out


def likeness(a: Prints, b: Prints) -> float:
    """Jaccard similarity of the hashes, 1 for two empty texts."""
    x, y = np.unique(a.hashes), np.unique(b.hashes)
    common = len(np.intersect1d(x, y, assume_unique=True))
    total = len(x) + len(y) - common
    return common / total if total else 1.0


# -- documents and their neighbours in the order of ids -------------------------------

def _block_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` lie above ``key``; found in two steps."""
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.array(*map(F.lit, bounds[step - 1::step] or [0]))
    full = F.array(*map(F.lit, bounds or [0]))
    below = F.size(F.filter(coarse, lambda b: b <= key)) if len(bounds) >= step and bounds else F.lit(0)
    near = F.size(F.filter(F.slice(full, below * step + 1, step), lambda b: b <= key)) if bounds else F.lit(0)
    return F.lit(len(bounds)) - below * step - near


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Rows ``target, guest, doc_id, text`` so that a task can walk the descending ids.

    Each target is a range of ids with all its documents; the first document of the
    next range comes along as guest, for the last range that of the first one. Rows of
    a target are sorted, guests last. Texts move once; the driver sees one id for each
    range.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    cuts = rows.approxQuantile("doc_id", shares, 0.25 / parts) if shares else []
    bounds = sorted({int(c) for c in cuts or []})
    block = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(_block_of(F.col("doc_id"), bounds))
    rows = rows.withColumn("block", block.cast("int"))
    heads = sorted(tuple(r) for r in rows.groupBy("block").agg(F.max("doc_id").alias("head")).collect())
    before = [(b, head, heads[i - 1][0]) for i, (b, head) in enumerate(heads)]
    heads = spark.createDataFrame(before, "block int, head long, previous int")
    own = F.struct(F.col("block").alias("target"), F.lit(False).alias("guest"))
    copy = F.struct(F.col("previous").alias("target"), F.lit(True).alias("guest"))
    places = F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(own, copy)).otherwise(F.array(own))
    dealt = rows.join(F.broadcast(heads), "block").select(F.explode(places).alias("p"), "doc_id", "text")
    return (dealt.select("p.target", "p.guest", "doc_id", "text").repartition(parts, "target")
            .sortWithinPartitions("target", "guest", F.desc_nulls_last("doc_id"), "text"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Slices of consecutive rows of one target, each from the last row of the one before on.

    Of the guests of a target only the first one counts.
    """
    rows, size, closed = [], 0, None
    for batch in batches:
        for target, guest, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if target == closed:
                continue
            rows.append((doc_id, text or ""))
            size += len(rows[-1][1])
            if guest:
                yield rows
                rows, size, closed = [], 0, target
            elif size >= C.SLICE_BYTES and len(rows) > 1:
                yield rows
                rows, size = rows[-1:], len(rows[-1][1])


def _fingerprinter(k: int, w: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            texts = [text for _, text in rows]
            edited = [a[:len(a) - len(a) // 3] + b[:len(a) // 3] for a, b in zip(texts, texts[1:])]
            own, changed = fingerprints(texts, k, w), fingerprints(edited, k, w)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([doc_id for doc_id, _ in rows[:-1]], pa.int64()),
                "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                "fingerprint": [p.text() for p in own[:-1]],
                "edited_fingerprint": [p.text() for p in changed],
                "near_edited": [likeness(a, b) for a, b in zip(own, changed)],
                "near_next": [likeness(a, b) for a, b in zip(own, own[1:])]})
    return work


def document_fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of each row of ``docs(doc_id, text)`` and of its edited text.

    The edited text has its last third (rounded down) replaced by the first as many
    characters of the next document in descending order of ids; after the last comes
    the first. Rows with one id are ordered by text, rows without an id come last; a
    null text is empty. A single row is its own next one. Other columns are not read.
    An empty table gives an empty table.
    """
    return with_neighbours(docs).mapInArrow(
        _fingerprinter(k, w),
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")

"""Runs of repeated words: every maximal stretch that repeats one block at least four times.

A run of smallest period ``p`` is a longest stretch of words in which words ``p`` apart are
equal. What is looked for are its equal places, the ``i`` with ``word[i] == word[i + p]``:
an interval of at least ``3 * p``.

Periods are taken by octaves ``[B, 2B)``. For each octave the text is cut into tiles
``[b - B, b + 5B)`` around boundaries ``b``, multiples of ``B``, so neighbouring tiles
overlap. An interval of ``3 * p`` places holds ``[b, b + 2B)`` for some boundary, so a tile
asks only for periods whose value of its boundary's Z-function (how far the words behind
``b`` equal those behind ``b + p``) is at least ``2B``. By the theorem of Fine and Wilf one
period of the octave at most can then be no multiple of a smaller one, so each tile gives
one fragment at most: the interval around ``b``, cut off at the tile. Tiles don't know of
each other. Fragments are shuffled by text and period and overlapping ones are stitched
to intervals, hence to runs.

Words are compared by codes that are exact within a text. The texts of a slice stand end
to end, with codes of their own, so their tiles are solved together; a boundary's
Z-function is computed only where the first and a few further words agree, which needs
one comparison for each word and octave. Texts above ``LONG`` characters send their tiles
out to other tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.llm import common as C

# A run has at least so many words, and its block so many times.
LEAST_WORDS, LEAST_TIMES = 6, 4
# Texts above this many characters are solved by many tasks.
LONG = 4_000_000
# Words of such a text in one piece, besides the overlap; boundaries in one piece for octaves above it.
PIECE, BOUNDARIES = 1 << 18, 16

_FRAGMENT = T.StructType([T.StructField(n, T.LongType()) for n in ("period", "start", "end")])
_PARSED = T.StructType([
    T.StructField("key", T.BinaryType()), T.StructField("n_words", T.LongType()),
    T.StructField("fragments", T.ArrayType(_FRAGMENT)),
    T.StructField("body", T.StringType()), T.StructField("collapsed_sha256", T.StringType())])
_PIECES = "key binary, low long, high long, origin long, first long, last long, codes binary"
_RUNS = "array<struct<start: bigint, period: bigint, length: bigint>>"


# -- one stretch of words ------------------------------------------------------

def z_function(words: list, upto: int) -> list:
    """For each place below ``upto`` how many words from there on equal those from the start on."""
    n = len(words)
    z = [0] * min(upto, n)
    left = right = 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and words[k] == words[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def _candidates(codes: np.ndarray, width: int, first: int, last: int) -> np.ndarray:
    """Boundaries in ``[first, last)`` with a period of the octave that agrees at a few places."""
    k = np.arange(-(-first // width), -(-last // width))
    k = k[k * width + 3 * width < len(codes)]
    if not len(k):
        return k
    padded = np.full((k[-1] + 2) * width, -1, codes.dtype)
    have = min(len(padded), len(codes))
    padded[:have] = codes[:have]
    blocks = padded.reshape(-1, width)
    row, column = np.nonzero(blocks[k + 1] == blocks[k, :1])
    at, period = k[row] * width, width + column
    fits = at + period + 2 * width <= len(codes)
    at, period = at[fits], period[fits]
    for step in (1, 2 * width - 1, width, width // 2, width + width // 2):
        same = codes[at + step] == codes[at + period + step]
        at, period = at[same], period[same]
    return np.unique(at)


def _fragment(codes: np.ndarray, b: int, width: int) -> tuple[int, int, int] | None:
    """Period and interval of the one run of the octave that the tile around ``b`` may show."""
    z = z_function(codes[b:b + 5 * width].tolist(), 2 * width)
    period = next((p for p in range(width, len(z)) if z[p] >= 2 * width), None)
    if period is None or any(z[q] >= 2 * width + period - q for q in range(1, period)):
        return None  # nothing, or a smaller period rules the stretch
    low = max(b - width, 0)
    unequal = np.flatnonzero(codes[low:b] != codes[low + period:b + period])
    return period, low + int(unequal[-1]) + 1 if len(unequal) else low, b + min(z[period], 3 * width)


def solve(codes: np.ndarray, low: int, high: int, first: int, last: int) -> np.ndarray:
    """Fragments ``(period, start, end)`` of the octaves ``low`` to below ``high`` at boundaries in ``[first, last)``."""
    equal = np.zeros(len(codes) + 1, np.int8)
    found = [np.zeros((0, 3), np.int64)]
    if low == 0:  # period 1 needs no tiles: its intervals are the stretches of equal neighbours
        equal[1:-1] = codes[1:] == codes[:-1] if len(codes) else 0
        start, end = np.flatnonzero(np.diff(equal) == 1), np.flatnonzero(np.diff(equal) == -1)
        keep = (end - start >= 2) & (start < last) & (end > first)
        found.append(np.stack([np.ones(keep.sum(), np.int64), start[keep], end[keep]], 1))
    for octave in range(max(low, 1), high):
        width = 1 << octave
        at = _candidates(codes, width, first, last)
        if len(at):
            # Within a stretch of a smaller period nothing new can start.
            known = np.concatenate(found)
            known = known[np.argsort(known[:, 1], kind="stable")]
            reach = np.maximum.accumulate(np.concatenate([[0], known[:, 2] + known[:, 0]]))
            at = at[reach[np.searchsorted(known[:, 1], at, "right")] < at + 4 * width]
        rows = [f for f in (_fragment(codes, int(b), width) for b in at) if f]
        found.append(np.array(rows, np.int64).reshape(-1, 3))
    return _stitched(np.concatenate(found))


def _stitched(rows: np.ndarray) -> np.ndarray:
    """Overlapping fragments of one period as one; the tiles of a slice needn't travel one by one."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    # Ends of one period lie behind all ends of smaller ones.
    shift = rows[:, 0] * (rows[:, 2].max() + 1)
    end = np.maximum.accumulate(rows[:, 2] + shift)
    fresh = np.ones(len(rows), bool)
    fresh[1:] = rows[1:, 1] + shift[1:] > end[:-1]
    begin = np.flatnonzero(fresh)
    return np.stack([rows[begin, 0], rows[begin, 1], np.maximum.reduceat(rows[:, 2], begin)], 1)


def octaves(n_words: int) -> int:
    """Octaves of which the smallest period can occur four times."""
    return max(n_words // LEAST_TIMES, 1).bit_length()


def pieces(n_words: int, piece: int = PIECE) -> Iterator[tuple[int, int, int, int, int, int]]:
    """``low, high, first, last, begin, end``: octaves, boundaries and words of each piece of a long text."""
    top = octaves(n_words)
    small = min(top, max(piece // BOUNDARIES, 1).bit_length())
    groups = [(0, small, piece)] + [(o, o + 1, BOUNDARIES << o) for o in range(small, top)]
    for low, high, size in groups:
        width = 1 << (high - 1)
        for first in range(0, n_words, size):
            last = min(first + size, n_words)
            yield low, high, first, last, max(first - width, 0), min(last + 5 * width, n_words)


# -- texts -----------------------------------------------------------------------

def _split(texts: pa.Array) -> list[list[bytes]]:
    """Words are runs of anything but the six ASCII white-space bytes, as ``bytes.split`` has it."""
    return [(t or "").encode().split() for t in texts.to_pylist()]


def _codes(split: list[list[bytes]]) -> np.ndarray:
    """Words of all texts end to end, each as the place where its text has it first."""
    out, at = [], 0
    for words in split:
        out.append(map({}.setdefault, words, count(at)))
        at += len(words)
    return np.fromiter(chain.from_iterable(out), np.int64, at)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _parse(solved_here: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("_id").to_pylist()
            _, offsets = C.utf8(texts)
            for i, j in C.slices(offsets):
                split = _split(texts[i:j])
                lengths = np.array([len(w) for w in split], np.int64)
                starts = np.concatenate([[0], np.cumsum(lengths)])
                found = np.zeros((0, 3), np.int64)
                if solved_here:
                    codes = _codes(split)
                    found = solve(codes, 0, octaves(int(lengths.max())), 0, len(codes))
                owner = np.searchsorted(starts, found[:, 1], "right") - 1
                found[:, 1:] -= starts[owner][:, None]
                of = [found[owner == k].tolist() if solved_here else [] for k in range(j - i)] if len(found) else [[]] * (j - i)
                rows = []
                for words, text, one, fragments in zip(split, texts[i:j].to_pylist(), ids[i:j], of):
                    body = b" ".join(words).decode()
                    key = hashlib.blake2b(f"{one}:{text or ''}".encode(), digest_size=16).digest()
                    is_open = bool(fragments) or not solved_here
                    rows.append((key, len(words), [dict(zip(("period", "start", "end"), f)) for f in fragments],
                                 body if is_open else None, None if is_open else _digest(body)))
                made = pa.RecordBatch.from_pydict({
                    name: pa.array(column, kind) for name, column, kind in zip(
                        ("key", "n_words", "fragments", "body", "collapsed_sha256"), zip(*rows), (
                            pa.binary(), pa.int64(),
                            pa.list_(pa.struct([(n, pa.int64()) for n in ("period", "start", "end")])),
                            pa.string(), pa.string()))})
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j], *made.columns], ["doc_id", *made.schema.names])
    return run


def _cut(piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.binary(), *[pa.int64()] * 5, pa.binary())
        names = ("key", "low", "high", "origin", "first", "last", "codes")
        for batch in batches:
            for key, body in zip(batch.column("key").to_pylist(), batch.column("body").to_pylist()):
                codes = _codes([body.encode().split()])
                for low, high, first, last, begin, end in pieces(len(codes), piece):
                    row = (key, low, high, begin, first - begin, last - begin, codes[begin:end].tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)
    return run


def _solve_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            # Boundaries count from the start of the text, so the piece is padded to a whole number of tiles.
            width = 1 << (row["high"] - 1)
            pad = row["origin"] % width
            codes = np.frombuffer(row["codes"], np.int64)
            codes = np.concatenate([-2 - np.arange(pad), codes])
            found = solve(codes, row["low"], row["high"], row["first"] + pad, row["last"] + pad)
            found[:, 1:] += row["origin"] - pad
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["key"]] * len(found), pa.binary()), *(pa.array(found[:, c], pa.int64()) for c in range(3))],
                ["key", "period", "start", "end"])


def _parsed(docs: DataFrame, long_chars: int) -> tuple[DataFrame, DataFrame]:
    """One row for each text, and the fragments of all texts."""
    docs = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"))
    size = F.coalesce(F.length("text"), F.lit(0))
    schema = T.StructType([docs.schema["doc_id"], *_PARSED.fields])
    short = docs.filter(size <= long_chars).mapInArrow(_parse(True), schema)
    long = docs.filter(size > long_chars).mapInArrow(_parse(False), schema)
    return short, long


def stitch(fragments: DataFrame) -> DataFrame:
    """``key, start, period, length`` of every run, from fragments ``key, period, start, end``."""
    before = Window.partitionBy("key", "period").orderBy("start", "end")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    fresh = fragments.withColumn("fresh", F.coalesce((F.col("start") > reach).cast("int"), F.lit(0)))
    parts = fresh.withColumn("part", F.sum("fresh").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    whole = parts.groupBy("key", "period", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start") + F.col("period")
    return whole.select("key", "start", "period", length.alias("length")).filter(
        (F.col("length") >= LEAST_WORDS) & (F.col("length") >= LEAST_TIMES * F.col("period")))


def _found(docs: DataFrame, long_chars: int, piece: int) -> tuple[DataFrame, DataFrame]:
    short, long = _parsed(docs, long_chars)
    texts = C.staged(short.unionByName(long), "run-texts")
    fragments = texts.select("key", F.explode("fragments").alias("f")).select("key", "f.*")
    cut = texts.filter("body is not null and size(fragments) = 0").mapInArrow(_cut(piece), _PIECES)
    spread = cut.repartition("key", "low", "origin")
    more = spread.mapInArrow(_solve_pieces, "key binary, period long, start long, end long")
    return texts, stitch(fragments.unionByName(more))


def run_spans(docs: DataFrame, long_chars: int = LONG, piece: int = PIECE) -> DataFrame:
    """``doc_id, start, period, length`` of every run, counted in words; see ``scan_runs``."""
    texts, runs = _found(docs, long_chars, piece)
    return texts.filter("body is not null").select("doc_id", "key").join(runs, "key").drop("key")


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.select(["runs", "body"]).to_pylist():
            runs, words = row["runs"] or [], row["body"].split(" ") if row["body"] else []
            step = np.zeros(len(words) + 1, np.int64)
            for run in runs:  # a word goes when some run holds it behind its first block
                step[run["start"] + run["period"]] += 1
                step[run["start"] + run["length"]] -= 1
            kept = np.flatnonzero(np.cumsum(step[:-1]) == 0)
            best = min(runs, key=lambda r: (-r["length"], r["start"], r["period"]), default=None)
            best = (best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"]) if best else (None,) * 4
            listed = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs)
            rows.append((len(runs), *best, _digest(listed), _digest(" ".join([words[k] for k in kept]))))
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 5 + [pa.string()] * 2)] if rows else []
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), *columns], [
                "doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])


def scan_runs(docs: DataFrame, long_chars: int = LONG, piece: int = PIECE) -> DataFrame:
    """For each row of ``docs`` its runs and its text without their repetitions.

    ``n_words, n_runs``; ``start, length, period, exponent_milli`` of the longest run (the
    first, then the one of the smaller period among equals), nulls without a run;
    ``runs_sha256`` of all runs and ``collapsed_sha256`` of the words outside repetitions,
    joined by one space. Needs ``doc_id`` and ``text``; other columns have no part. A null
    or empty text has no words and no runs; a null id is an id like others; rows that are
    repeated or share an id get a result each. An empty table gives an empty table.
    """
    texts, runs = _found(docs, long_chars, piece)
    listed = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    some = texts.filter("body is not null").select("doc_id", "n_words", "key", "body").join(listed, "key", "left").select(
        "doc_id", "n_words", "body", F.col("runs").cast(_RUNS).alias("runs"))
    schema = T.StructType([
        texts.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in (
            "n_words", "n_runs", "start", "length", "period", "exponent_milli")),
        T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType())])
    none = F.lit(None).cast("long")
    rest = texts.filter("body is null").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_runs"), none.alias("start"), none.alias("length"),
        none.alias("period"), none.alias("exponent_milli"), F.lit(_digest("")).alias("runs_sha256"), "collapsed_sha256")
    return some.mapInArrow(_collapse, schema).unionByName(rest)


def with_loops(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with a repeated block to the end of about every tenth text.

    With ``h`` the CRC-32 of the id, ``g = h // 10`` and ``n`` words: where ``h % 10`` is 0
    and ``n`` above 0, the words from ``a = g % n`` on repeat the ``1 + (n - a) // (3 + g % 8)``
    words that stand there. A null id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), (h % 10 == 0).alias("chosen"))
    found = F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")
    rows = rows.withColumn("words", F.when(F.col("chosen"), found)).withColumn("n", F.size("words").cast("long"))
    rows = rows.withColumn("a", F.expr("g % nullif(n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    text = F.expr(
        "array_join(slice(concat(slice(words, 1, int(a)), flatten(array_repeat(slice(words, int(a + 1), int(p)),"
        " int(ceil((n - a) / p))))), 1, int(n)), ' ')")
    return rows.select("doc_id", F.when(F.col("chosen") & (F.col("n") > 0), text).otherwise(F.col("text")).alias("text"))


def sql() -> str:
    """DuckDB SQL for ``scan_runs(with_loops(documents))``.

    Equal words are paired and paired places become intervals; a run falls when one of a
    smaller period holds it. CRC-32 is taken byte by byte from its table.
    """
    bit = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    table = f"list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)), lambda c, k: {bit}))"
    return f"""
    with crc as materialized (select {table} as t),
    ids as (
        select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
               xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::varchar) + 1),
                   lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint)),
                   lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) as h
        from documents, crc),
    looped as (
        select *, len(w) as n, h // 10 as g from ids),
    placed as (
        select *, case when h % 10 = 0 and n > 0 then g % n end as a from looped),
    blocks as (select *, 1 + (n - a) // (3 + g % 8) as p from placed),
    docs as materialized (
        select r, doc_id, n, case when a is null then w else list_transform(range(0, n),
            lambda i: w[case when i >= a then a + (i - a) % p else i end + 1]) end as w from blocks),
    words as materialized (select r, n, i, w[i + 1] as word from docs, unnest(range(0, n)) u(i)),
    pairs as (
        select x.r, x.i, y.i - x.i as period from words x join words y
        on x.r = y.r and x.word = y.word and y.i > x.i and {LEAST_TIMES} * (y.i - x.i) <= x.n),
    numbered as (select *, i - row_number() over (partition by r, period order by i) as island from pairs),
    stretches as (
        select r, period, min(i) as start, count(*) + period as length from numbered group by r, period, island),
    repeated as materialized (
        select r, period, start, length from stretches where length >= {LEAST_WORDS} and length >= {LEAST_TIMES} * period),
    runs as materialized (
        select * from repeated x where not exists (
            select 1 from repeated y where y.r = x.r and y.period < x.period
            and y.start <= x.start and y.start + y.length >= x.start + x.length)),
    listed as (
        select r, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as runs,
               first({{'s': start, 'l': length, 'p': period}} order by length desc, start, period) as best
        from runs group by r),
    dropped as (select distinct r, i from runs, unnest(range(start + period, start + length)) u(i)),
    kept as (
        select r, string_agg(word, ' ' order by i) as body
        from words left join (select r, i, true as gone from dropped) d using (r, i) where gone is null group by r)
    select doc_id, n as n_words, coalesce(n_runs, 0) as n_runs, best.s as start, best.l as length, best.p as period,
           1000 * best.l // best.p as exponent_milli, sha256(coalesce(runs, '')) as runs_sha256,
           sha256(coalesce(body, '')) as collapsed_sha256
    from docs left join listed using (r) left join kept using (r)"""

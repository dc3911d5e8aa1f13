"""Hard negatives: exact threshold joins of anchor vectors with all vectors.

The join follows L2AP (Anastasiu and Karypis, "L2AP: fast cosine similarity search with
prefix L-2 norm bounds", ICDE 2014), for integer vectors and inner products:

* Dimensions are ordered by their energy over all vectors, the highest first.
* The inverted index of a block of vectors omits the dimensions of a vector from the place
  on where the norm of its rest times the anchor's norm is below the threshold: vectors
  that meet an anchor in omitted dimensions only can't reach it. In a block the vectors
  stand by how many dimensions they have in the index, so the posting list of a dimension
  is a prefix of the block.
* Scores are accumulated over the lists, a few dimensions at a time. A vector is pruned
  when for no anchor its score so far plus the product of the remaining norms reaches the
  threshold. What is left is scored exactly.

An anchor asks for the best vectors in windows of scores. Its thresholds are lowered until
the windows fill: the first is a guess from a bounded sample of the vectors, the second one
that the sample itself proves low enough, the last the lower ends of the windows. Only
anchors with windows that are not full go on. The sample decides on the thresholds alone,
every vector is searched.

Anchors and vectors travel in blocks; every block of anchors meets every block of vectors.
From each meeting at most the best of each window go on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm import common as C

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
# A negative has between these hundredths of its positive's score.
LOW, HIGH = 30, 90
# Vectors and anchors in a block, dimensions in a step, vectors in the sample.
VECTORS, ANCHORS, STEP, SAMPLE = 2048, 128, 8, 8192
# Larger components don't take part: scores would not fit a long.
LARGEST = 1 << 28

_NONE = -(1 << 62)
_BLOCK = "first long, n int, ids binary, labels binary, values binary"
_ASKED = "n int, ids binary, labels binary, values binary, low binary, high binary, least binary"
_FOUND = "anchor_id long, window int, vec_id long, score long"


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, v`` of the rows that take part, components as ``floor(scale * x)``.

    Rows with a null id, label or vector, or with a null, non-finite or too large
    component, have no part. Of rows that share an id the smallest by label and vector
    counts.
    """
    scaled = F.transform("embedding", lambda x: F.floor(F.when(
        F.abs(x.cast("double")) < LARGEST / scale, x.cast("double") * scale)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled.alias("v"))
    rows = rows.filter("vec_id is not null and label is not null and v is not null and not exists(v, x -> x is null)")
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", F.col("v").cast("array<int>").alias("v"))).alias("one"))
    return one.select("vec_id", "one.label", "one.v")


# -- blocks -----------------------------------------------------------------------

def _matrix(lists: pa.Array, order: np.ndarray) -> np.ndarray:
    """Vectors as rows, dimensions in the given order; missing ones are 0."""
    out = np.zeros((len(lists), len(order) + 1), np.int32)
    flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    lengths = np.diff(offsets)
    place = np.full(max(int(lengths.max(initial=0)), len(order), 1), len(order))
    place[order] = np.arange(len(order))
    at = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], lengths)
    out[np.repeat(np.arange(len(lists)), lengths), place[at]] = flat
    return out[:, :len(order)]


def _full(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of all batches in tables of ``rows`` rows."""
    held, count = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - count)
            held.append(part)
            count += part.num_rows
            batch = batch.slice(part.num_rows)
            if count == rows:
                yield pa.Table.from_batches(held)
                held, count = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _row(schema: str, *values) -> pa.RecordBatch:
    names = [c.split() for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array([v], kinds[kind]) for v, (_, kind) in zip(values, names)], [name for name, _ in names])


def _packed(table: pa.Table, order: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    lists = table.column("v").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ids, labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
    return len(ids), ids.tobytes(), labels.tobytes(), _matrix(lists, order).tobytes()


def _vector_blocks(order: np.ndarray, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _full(batches, size):
            yield _row(_BLOCK, table.column("vec_id")[0].as_py(), *_packed(table, order))
    return run


def _anchor_blocks(order: np.ndarray, size: int, k: int, same: bool, sample: dict, share: float):
    """Blocks of anchors with their windows and, for each round, the thresholds the sample gives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _full(batches, size):
            n, ids, labels, values = _packed(table, order)
            windows = np.array(table.column("windows").to_pylist(), np.int64).reshape(n, -1, 2)
            asked = Anchors(n, ids, labels, values, windows[:, :, 0].tobytes(), windows[:, :, 1].tobytes(), b"")
            least = asked.thresholds(Block(**sample), k, same, share)
            yield _row(_ASKED, n, ids, labels, values, windows[:, :, 0].tobytes(), windows[:, :, 1].tobytes(), least.tobytes())
    return run


# -- the join of two blocks -------------------------------------------------------

def _rest_norms(values: np.ndarray) -> np.ndarray:
    """Norm of what is left of each vector before each step, and 0 behind the last."""
    steps = -(-values.shape[1] // STEP)
    squares = np.zeros((len(values), steps * STEP))
    squares[:, :values.shape[1]] = values.astype(np.float64) ** 2
    by_step = squares.reshape(len(values), steps, STEP).sum(2)
    out = np.zeros((len(values), steps + 1))
    out[:, :-1] = np.sqrt(np.cumsum(by_step[:, ::-1], 1)[:, ::-1])
    return out


class Block:
    """Vectors with their ids and labels."""

    def __init__(self, n: int, ids: bytes, labels: bytes, values: bytes, **_):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.values = np.frombuffer(values, np.int32).reshape(n, -1) if n else np.zeros((0, 0), np.int32)
        self.rest = _rest_norms(self.values)


class Anchors(Block):
    """A block of anchors; ``low`` and ``high`` bound their windows, ``least`` has thresholds by round."""

    def __init__(self, n, ids, labels, values, low, high, least, **_):
        super().__init__(n, ids, labels, values)
        self.low = np.frombuffer(low, np.int64).reshape(n, -1)
        self.high = np.frombuffer(high, np.int64).reshape(n, -1)
        self.least = np.frombuffer(least, np.int64).reshape(n, -1) if least else None

    def thresholds(self, sample: Block, k: int, same: bool, share: float) -> np.ndarray:
        """For each anchor a guess, a proven bound and the lower end of its windows.

        The sample holds the given share of the vectors: the score that ``share * k`` of its
        vectors reach is a guess at what ``k`` of all reach; what ``k`` of the sample reach is proven.
        """
        ladder = np.tile(self.low.min(1)[:, None], (1, 3))
        if not len(sample.ids):
            return ladder
        anchor, window, _, score = self.best(sample, k, same, np.full(len(self.ids), _NONE))
        for place, rank in enumerate((max(int(np.ceil(2 * share * k)), 1), k)):
            if rank > k:
                rank = k
            # Rows are sorted by anchor, window, score: the rank-th of a group bounds it.
            group = anchor * self.low.shape[1] + window
            have = np.bincount(group, minlength=self.low.size)
            start = np.cumsum(have) - have
            bound = np.where(have >= rank, score[np.minimum(start + rank - 1, max(len(score) - 1, 0))] if len(score) else 0, self.low.ravel())
            ladder[:, place] = bound.reshape(self.low.shape).min(1)
        return ladder

    def best(self, block: Block, k: int, same: bool, least: np.ndarray) -> tuple[np.ndarray, ...]:
        """Place of the anchor, window, id and score of the best ``k`` of each window at or above ``least``."""
        scores, kept = self.join(block, np.maximum(least, self.low.min(1)))
        ids, labels = block.ids[kept], block.labels[kept]
        fits = (self.labels[:, None] == labels) == same
        fits &= (self.ids[:, None] != ids) & (scores >= least[:, None])
        out = []
        for w in range(self.low.shape[1]):
            row, column = np.nonzero(fits & (scores >= self.low[:, w, None]) & (scores <= self.high[:, w, None]))
            score, vec = scores[row, column], ids[column]
            order = np.lexsort((vec, -score, row))
            row, score, vec = row[order], score[order], vec[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            keep = rank < k
            out.append((row[keep], np.full(keep.sum(), w), vec[keep], score[keep]))
        row, window, vec, score = (np.concatenate(c) for c in zip(*out))
        order = np.lexsort((vec, -score, window, row))
        return row[order], window[order], vec[order], score[order]

    def join(self, block: Block, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact scores with the vectors of which some may reach ``least``, and the places of these vectors."""
        x, rest = block.values, block.rest
        steps = rest.shape[1] - 1
        norms = np.maximum(self.rest[:, 0], 1e-300)
        cosine = (least / norms).min(initial=np.inf)  # below it times the anchor's norm nobody's threshold lies
        depth = (rest[:, :-1] >= cosine).sum(1) if cosine > 0 else np.full(len(x), steps)
        kept = np.argsort(-depth, kind="stable")
        # Sums of integers are exact in doubles up to 2**53.
        bound = float(np.abs(x).max(initial=0)) * float(np.abs(self.values).max(initial=0)) * x.shape[1]
        kind = np.float64 if bound < 2 ** 53 else np.int64
        queries, values = self.values.astype(kind), x[kept].astype(kind)
        depth, rest = depth[kept], rest[kept]
        partial = np.zeros((len(queries), len(kept)), kind)
        under = least - np.abs(least) * 1e-9 - 1e-6  # more than the rounding of norms
        for step in range(steps):
            dims = slice(step * STEP, (step + 1) * STEP)
            listed = int(np.searchsorted(-depth, -step, "left"))  # vectors with more than ``step`` steps in the index
            partial[:, :listed] += queries[:, dims] @ values[:listed, dims].T
            # What a vector may still add, from the index or from what it omits.
            left = np.where(depth > step, rest[:, step + 1], rest[np.arange(len(depth)), np.minimum(depth, steps)])
            at = np.where(depth > step, step + 1, np.minimum(depth, steps))
            reach = partial + self.rest[:, at] * left
            alive = (reach >= under[:, None]).any(0)
            if not alive.all():
                kept, values, depth, rest, partial = kept[alive], values[alive], depth[alive], rest[alive], partial[:, alive]
        omitted = np.arange(values.shape[1]) >= depth[:, None] * STEP
        partial += queries @ np.where(omitted, values, 0).T
        return partial.astype(np.int64), kept


def _meet(k: int, same: bool, rung: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, None
        for batch in batches:
            for place in range(batch.num_rows):
                def of(*names, place=place):
                    return [batch.column(c)[place].as_py() for c in names]
                if of("first") != last:
                    last, block = of("first"), Block(*of("n", "ids", "labels", "values"))
                asked = Anchors(*of("m", "a_ids", "a_labels", "a_values", "a_low", "a_high", "a_least"))
                anchor, window, vec, score = asked.best(block, k, same, asked.least[:, rung])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked.ids[anchor]), pa.array(window.astype(np.int32)), pa.array(vec), pa.array(score)],
                    ["anchor_id", "window", "vec_id", "score"])
    return run


# -- the whole join ---------------------------------------------------------------

class Index:
    """All vectors in blocks, with what the thresholds need to know of them."""

    def __init__(self, vectors: DataFrame, size: int = VECTORS, sample: int = SAMPLE):
        spark = vectors.sparkSession
        self.slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
        energy = vectors.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(
            F.sum(F.col("x").cast("double") * F.col("x")).alias("e"))
        ordered = [r["d"] for r in energy.orderBy(F.desc("e"), "d").collect()]  # one row for each dimension
        self.order = np.array(ordered, np.int64)
        self.count = vectors.count()
        drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
        n, ids, labels, values = _packed(drawn, self.order)
        self.sample = {"n": n, "ids": ids, "labels": labels, "values": values}
        blocks = vectors.mapInArrow(_vector_blocks(self.order, size), _BLOCK)
        self.blocks = C.staged(blocks.withColumn("slot", F.pmod(F.xxhash64("first"), F.lit(self.slots)).cast("int")), "negatives-index")

    def top(self, anchors: DataFrame, k: int, same: bool, size: int = ANCHORS) -> DataFrame:
        """``anchor_id, window, rank, vec_id, score``: the best ``k`` of each window of each anchor.

        ``anchors`` has ``vec_id, label, v, windows``, lists of as many ``[low, high]`` for
        each. Vectors have the anchor's label, or another one if not ``same``.
        """
        share = min(self.sample["n"] / max(self.count, 1), 1.0)
        pack = _anchor_blocks(self.order, size, k, same, self.sample, share)
        open_, parts = anchors, []
        for rung in range(3):
            asked = open_.select("vec_id", "label", "v", "windows").mapInArrow(pack, _ASKED)
            asked = asked.select(F.col("n").alias("m"), *(F.col(c).alias("a_" + c) for c in ("ids", "labels", "values", "low", "high", "least")),
                                 F.explode(F.sequence(F.lit(0), F.lit(self.slots - 1))).alias("slot"))
            met = asked.join(self.blocks, "slot").drop("slot").mapInArrow(_meet(k, same, rung), _FOUND)
            found = met.withColumn("rank", F.expr(
                "row_number() over (partition by anchor_id, window order by score desc, vec_id)")).filter(F.col("rank") <= k)
            found = C.staged(found, f"negatives-found-{rung}")
            parts.append(found)
            if rung == 2:
                break
            # A window is full with k vectors; a threshold at its lower end has nothing below it.
            full = found.filter(F.col("rank") == k).groupBy("anchor_id").agg(F.count("*").alias("full"))
            wanted = F.size(F.filter("windows", lambda w: w[0] <= w[1]))
            rest = open_.join(full, F.col("vec_id") == F.col("anchor_id"), "left").filter(
                F.coalesce("full", F.lit(0)) < wanted).drop("anchor_id", "full")
            rest = C.staged(rest, f"negatives-open-{rung}")
            parts[-1] = found.join(rest.select(F.col("vec_id").alias("anchor_id")), "anchor_id", "left_anti")
            open_ = rest
            if rest.isEmpty():
                break
        return reduce(DataFrame.unionByName, parts)


def hard_negatives(vectors: DataFrame, is_anchor: Column, scale: int = SCALE, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = VECTORS,
                   sample: int = SAMPLE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    For each anchor its best rows of the same label, and for each of these the best rows of
    other labels with ``low * positive <= 100 * score <= high * positive``. Scores are inner
    products of integer vectors, ties go to the smaller id. ``vectors`` has ``vec_id, label,
    embedding``, other columns have no part; see ``integer_vectors`` for the rows that count.
    Shorter vectors end in zeros. Anchors without a positive, and positives without a
    negative, have no rows. An empty table gives an empty table.
    """
    rows = C.staged(integer_vectors(vectors, scale), "negatives-vectors")
    index = Index(rows, block, sample)
    anchors = rows.filter(is_anchor)
    everything = F.array(F.array(F.lit(_NONE).cast("long"), F.lit(-_NONE).cast("long")))
    near = C.staged(index.top(anchors.withColumn("windows", everything), positives, True), "negatives-positives")
    near = near.select("anchor_id", F.col("rank").alias("of"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # Windows of integers: from the ceiling of the lower share to the floor of the higher one.
    bounds = F.array(
        -F.floor(F.col("positive_score") * -low / 100).cast("long"), F.floor(F.col("positive_score") * high / 100).cast("long"))
    asked = near.withColumn("bounds", bounds).filter("bounds[0] <= bounds[1]")
    windows = asked.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("of", "bounds"))).alias("w"))
    nothing = F.array(F.lit(-_NONE).cast("long"), F.lit(_NONE).cast("long"))
    listed = F.concat(F.transform("w", lambda x: x["bounds"]), F.array_repeat(nothing, F.lit(positives) - F.size("w")))
    places = F.transform("w", lambda x: x["of"])
    wanted = C.staged(windows.select("anchor_id", listed.alias("windows"), places.alias("places")), "negatives-windows")
    seekers = anchors.join(wanted.select(F.col("anchor_id").alias("vec_id"), "windows"), "vec_id")
    far = index.top(seekers, negatives, False).join(wanted.select("anchor_id", "places"), "anchor_id")
    far = far.select("anchor_id", F.expr("places[window]").alias("of"), "rank",
                     F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return far.join(near, ["anchor_id", "of"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def sql(every: int = 100) -> str:
    """DuckDB SQL over ``embeddings``, with every 7th label moved on by one and every ``every``-th row an anchor."""
    return f"""
    with rows as materialized (
        select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
               list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v
        from embeddings where label is not null and embedding is not null and len(list_filter(
            embedding, lambda x: x is null or not isfinite(x))) = 0),
    scores as materialized (
        select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
               list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::bigint as score
        from rows a join rows b on a.vec_id <> b.vec_id where a.vec_id % {every} = 0),
    positives as (
        select * from scores where same
        qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {POSITIVES})
    select p.anchor_id, p.vec_id as positive_id,
           row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id)::integer as rank,
           n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
    from positives p join scores n on p.anchor_id = n.anchor_id and not n.same
         and {LOW} * p.score <= 100 * n.score and 100 * n.score <= {HIGH} * p.score
    qualify rank <= {NEGATIVES}"""

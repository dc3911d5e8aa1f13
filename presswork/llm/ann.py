"""Nearest vectors by inner product: a neighbour graph by NN-descent, greedy search on it.

Inner products become angles: vectors are scaled below length 1 and get one more
coordinate that fills them up to it, queries get a zero there. Equal vectors are one
node of the graph.

NN-descent (Dong, Charikar, Li, WWW 2011) starts here from random-projection trees
instead of random lists: nodes that share a leaf are compared with each other. Each
round then joins, at every node, its neighbours in both directions with each other and
merges what they find: neighbours of neighbours become neighbours. Rounds go on until
less than ``DELTA`` of all list entries are new. The upper levels of the trees are fitted
on a bounded sample of ``SAMPLE`` nodes; leaves that are still too large are split by
further planes at the median of all their nodes. Every vector is indexed.

A query starts at its own node (it is one of the indexed vectors) and greedily expands
the best nodes of its beam that are not expanded yet, until no beam of any query holds
such a node. Where lengths differ it starts at the longest vectors too, since those have
the largest products. The beam is then scored in double precision on the original vectors.

Graph and search use half-precision vectors; the exact scores at the end do not.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswork.llm import common as C

SAMPLE = 8192
TREES = 16
LEAF = 2048          # nodes compared with each other; larger leaves are split by further planes
LEAST_SAMPLE = 8     # sampled nodes that a leaf needs, which bounds the levels fitted on the sample
DEGREE = 32
DELTA = 0.001        # share of new list entries below which the rounds end
LOCAL = 32           # neighbours in either direction that meet at a node
OFFERS = 8           # best of them that each is offered
BEAM, EXPAND = 64, 12
ENTRIES = 64         # longest vectors where queries also start, if lengths differ
TOP = 20


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Rows of a list or binary column of equal lengths."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, unordered."""
    return np.argpartition(-sims, k - 1, axis=1)[:, :k] if sims.shape[1] > k else \
        np.broadcast_to(np.arange(sims.shape[1]), sims.shape)


# -- vectors --------------------------------------------------------------------------

def _usable(vectors: DataFrame) -> DataFrame:
    """Vectors that take part: without nulls, finite, not zero, of the commonest length."""
    whole = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("vec")).filter(
        "vec_id is not null and vec is not null and size(vec) > 0").filter(
        F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0))
    common = whole.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return whole.filter(F.size("vec") == (common[0].n if common else 0))


def _unit_maker(largest: float, width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1), "f8", width) / largest
            fill = np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))
            rows = np.hstack([x, fill]).astype("<f2")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in rows], pa.binary())],
                                             ["node", "vec", "unit"])
    return work


# -- first lists from trees -----------------------------------------------------------

def _fit_trees(sample: np.ndarray, depth: int, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """Random hyperplanes with the sample's medians: ``planes[tree, node]`` and ``cuts[tree, node]``."""
    rng = np.random.Generator(np.random.PCG64(7))
    inner = (1 << depth) - 1
    planes = rng.standard_normal((trees, inner, sample.shape[1])).astype("f4")
    cuts = np.zeros((trees, inner), "f4")
    for t in range(trees):
        at = np.zeros(len(sample), np.int64)
        for level in range(depth):
            value = (sample * planes[t, at]).sum(axis=1)
            for node in range((1 << level) - 1, (1 << (level + 1)) - 1):
                own = value[at == node]
                cuts[t, node] = np.median(own) if len(own) else 0.0
            at = 2 * at + 1 + (value > cuts[t, at])
    return planes, cuts


def _planter(planes: np.ndarray, cuts: np.ndarray, width: int):
    trees, inner = cuts.shape
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1), "<f2", width).astype("f4")
            for t in range(trees):
                at = np.zeros(len(x), np.int64)
                while inner and at[0] < inner:
                    at = 2 * at + 1 + ((x * planes[t, at]).sum(axis=1) > cuts[t, at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t, np.int32)), pa.array(at), *batch.columns],
                    ["tree", "leaf", "node", "unit"])
    return work


def _projector(width: int):
    """The place of each node along a random direction of its own leaf."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(3), "<f2", width).astype("f4")
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            leaves, of = np.unique(keys, axis=0, return_inverse=True)
            planes = np.stack([np.random.Generator(np.random.PCG64([7, int(t), int(leaf)])).standard_normal(width)
                               for t, leaf in leaves]).astype("f4")
            value = (x * planes[of.ravel()]).sum(axis=1).astype("f8")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], ["tree", "leaf", "node", "unit", "value"])
    return work


_PLANTED = "tree int, leaf long, node long, unit binary"


def _small_leaves(planted: DataFrame, width: int) -> DataFrame:
    """``planted`` with every leaf of more than ``LEAF`` nodes split at medians until none is left.

    Nodes on the median are dealt by hash, so a leaf of equal directions is split too.
    """
    done = []
    for level in itertools.count():
        sizes = planted.groupBy("tree", "leaf").count()
        large = C.staged(sizes.filter(F.col("count") > LEAF).select("tree", "leaf"), f"ann-large-{level}")
        if large.isEmpty():
            break
        done.append(planted.join(large, ["tree", "leaf"], "left_anti"))
        placed = C.staged(planted.join(large, ["tree", "leaf"], "left_semi").select("tree", "leaf", "node", "unit").mapInArrow(
            _projector(width), f"{_PLANTED}, value double"), f"ann-placed-{level}")
        cuts = placed.groupBy("tree", "leaf").agg(F.percentile_approx("value", 0.5, 1000).alias("cut"))
        tied = F.pmod(F.xxhash64("node", "tree", "leaf"), F.lit(2)) == 1
        right = (F.col("value") > F.col("cut")) | (F.col("value") == F.col("cut")) & tied
        planted = placed.join(cuts, ["tree", "leaf"]).select(
            "tree", (2 * F.col("leaf") + 1 + right.cast("long")).alias("leaf"), "node", "unit")
    for part in done:
        planted = planted.unionByName(part)
    return planted


def _all_pairs_in(width: int, degree: int):
    def work(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        x = np.frombuffer(b"".join(table.column("unit").to_pylist()), "<f2").reshape(-1, width).astype("f4")
        found, sims = [], []
        for i in range(0, len(x), 512):
            s = x[i:i + 512] @ x.T
            s[np.arange(len(s)), i + np.arange(len(s))] = -9
            place = _top(s, min(degree, max(1, len(x) - 1)))
            found.append(node[place])
            sims.append(np.take_along_axis(s, place, axis=1))
        found, sims = np.vstack(found), np.vstack(sims).astype("f4")
        keep = sims > -9
        lengths = keep.sum(axis=1)
        return pa.table({"node": node, "near": C.list_array(found[keep], lengths, pa.int64()),
                         "sim": C.list_array(sims[keep], lengths, pa.float32())})
    return work


def _merger(degree: int):
    """Joins the lists of a node to its ``degree`` best."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, sim, lengths = [], [], []
            for own_near, own_sim in zip(batch.column(1), batch.column(2)):
                ids = np.concatenate([np.zeros(0, np.int64), *(x.values.to_numpy() for x in own_near)])
                values = np.concatenate([np.zeros(0, "f4"), *(x.values.to_numpy() for x in own_sim)])
                best = np.lexsort((-values, ids))  # a pair scored twice may differ in its last bit
                ids, values = ids[best], values[best]
                ids, first = np.unique(ids, return_index=True)
                values = values[first]
                order = np.lexsort((ids, -values))[:degree]
                near.append(ids[order])
                sim.append(values[order])
                lengths.append(len(order))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), C.list_array(np.concatenate([np.zeros(0, np.int64), *near]), lengths, pa.int64()),
                 C.list_array(np.concatenate([np.zeros(0, "f4"), *sim]), lengths, pa.float32())], ["node", "near", "sim"])
    return work


_GRAPH = "node long, near array<long>, sim array<float>"


def _merged(lists: DataFrame, degree: int, name: str) -> DataFrame:
    """One list for each node; a node has a bounded number of lists."""
    rows = lists.groupBy("node").agg(F.collect_list("near").alias("near"), F.collect_list("sim").alias("sim"))
    return C.staged(rows.mapInArrow(_merger(degree), _GRAPH), name)


def _first_lists(units: DataFrame, count: int, width: int, degree: int) -> DataFrame:
    rows = units.select("node", "unit")
    picked = rows.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect()
    sample = np.frombuffer(b"".join(bytes(r.unit) for r in picked), "<f2").reshape(-1, width).astype("f4")
    wanted = max(0, int(np.ceil(np.log2(max(count, 1) / LEAF))))
    depth = min(wanted, max(0, int(np.log2(max(len(sample), 1) / LEAST_SAMPLE))))
    planes, cuts = _fit_trees(sample, depth, TREES if depth else 1)
    planted = C.staged(rows.mapInArrow(_planter(planes, cuts, width), _PLANTED), "ann-leaves")
    lists = _small_leaves(planted, width).groupBy("tree", "leaf").applyInArrow(_all_pairs_in(width, degree), _GRAPH)
    return _merged(lists, degree, "ann-first")


# -- rounds of descent ------------------------------------------------------------------

def _offers(width: int, offers: int):
    """At each node its neighbours meet; each gets the best of the others."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, near, sim, lengths = [], [], [], []
            for ids, units in zip(batch.column(0), batch.column(1)):
                ids = ids.values.to_numpy()
                if len(ids) < 2:
                    continue
                x = np.frombuffer(b"".join(units.values.to_pylist()), "<f2").reshape(-1, width).astype("f4")
                s = x @ x.T
                np.fill_diagonal(s, -9)
                place = _top(s, min(offers, len(ids) - 1))
                node.append(ids)
                near.append(ids[place].ravel())
                sim.append(np.take_along_axis(s, place, axis=1).ravel())
                lengths.append(np.full(len(ids), place.shape[1]))
            if node:
                lengths = np.concatenate(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(node)), C.list_array(np.concatenate(near), lengths, pa.int64()),
                     C.list_array(np.concatenate(sim).astype("f4"), lengths, pa.float32())], ["node", "near", "sim"])
    return work


def _descend(graph: DataFrame, units: DataFrame, width: int, degree: int, step: int) -> DataFrame:
    edges = graph.select("node", F.explode(F.arrays_zip("near", "sim")).alias("e")).select(
        "node", F.col("e.near").alias("near"), F.col("e.sim").alias("sim"))
    both = edges.unionByName(edges.select(F.col("near").alias("node"), F.col("node").alias("near"), "sim")).distinct()
    best = Window.partitionBy("node").orderBy(F.desc("sim"), "near")
    met = both.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= LOCAL).select("node", "near")
    met = met.join(units.select(F.col("node").alias("near"), "unit"), "near")
    met = met.groupBy("node").agg(F.collect_list(F.struct("near", "unit")).alias("m"))
    offered = met.select("m.near", "m.unit").mapInArrow(_offers(width, OFFERS), _GRAPH)
    # A node met at many others gets an offer from each; they are cut to the best first.
    flat = offered.select("node", F.explode(F.arrays_zip("near", "sim")).alias("e")).select("node", "e.near", "e.sim")
    flat = flat.groupBy("node", "near").agg(F.max("sim").alias("sim"))
    flat = flat.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= degree)
    lists = flat.groupBy("node").agg(F.collect_list("near").alias("near"), F.collect_list("sim").alias("sim"))
    return _merged(graph.unionByName(lists), degree, f"ann-round-{step}")


def _new_share(graph: DataFrame, before: DataFrame) -> float:
    """Share of the list entries of ``graph`` that ``before`` did not have."""
    old = before.select("node", F.col("near").alias("old"))
    seen = graph.join(old, "node", "left").agg(
        F.sum(F.size(F.array_except("near", F.coalesce("old", F.array().cast("array<long>"))))).alias("new"),
        F.sum(F.size("near")).alias("all")).first()
    return (seen.new or 0) / max(seen.all or 0, 1)


def neighbour_graph(units: DataFrame, count: int, width: int, degree: int = DEGREE, delta: float | None = None) -> DataFrame:
    """``node, near, sim``: the ``degree`` nearest found of each node of ``units(node, unit)``.

    Up to ``LEAF`` nodes the first lists are complete. The similarities of a list only grow,
    so the rounds end.
    """
    delta = DELTA if delta is None else delta
    graph = _first_lists(units, count, width, degree)
    for step in itertools.count() if count > LEAF else ():
        before, graph = graph, _descend(graph, units, width, degree, step)
        share = _new_share(graph, before)
        C.discard(before)
        if share < delta:
            break
    return graph


# -- search -----------------------------------------------------------------------------

def _beam_step(width: int, beam: int, expand: int):
    """New beam of each query from its old one and the scored candidates."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("query", "unit", "beam", "sim", "done", "next")}
            for query, unit, old, sims, done, near, units in zip(*(c.to_pylist() for c in batch.columns)):
                q = np.frombuffer(unit, "<f2").astype("f4")
                ids, values = np.array(old or [], np.int64), np.array(sims or [], "f4")
                if near:
                    new, first = np.unique(np.array(near, np.int64), return_index=True)
                    first = first[~np.isin(new, ids)]
                    x = np.frombuffer(b"".join(units[i] for i in first), "<f2").reshape(-1, width).astype("f4")
                    ids, values = np.append(ids, np.array(near, np.int64)[first]), np.append(values, x @ q)
                order = np.lexsort((ids, -values))[:beam]
                ids, values = ids[order], values[order]
                done = set(done or [])
                ahead = [i for i in ids.tolist() if i not in done][:expand]
                out["query"].append(query)
                out["unit"].append(unit)
                out["beam"].append(ids.tolist())
                out["sim"].append(values.tolist())
                out["done"].append(sorted((done & set(ids.tolist())) | set(ahead)))
                out["next"].append(ahead)
            yield pa.RecordBatch.from_arrays([
                pa.array(out["query"], pa.int64()), pa.array(out["unit"], pa.binary()),
                *(pa.array(out[k], pa.list_(t)) for k, t in (
                    ("beam", pa.int64()), ("sim", pa.float32()), ("done", pa.int64()), ("next", pa.int64())))], list(out))
    return work


_STATE = "query long, unit binary, beam array<long>, sim array<float>, done array<long>, next array<long>"


def _query_units(width: int):
    """The query's own direction, with a zero for the filling coordinate."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1), "f8", width)
            x = np.hstack([x / np.sqrt((x * x).sum(axis=1, keepdims=True)), np.zeros((len(x), 1))]).astype("<f2")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["query", "unit"])
    return work


def greedy_search(graph: DataFrame, units: DataFrame, queries: DataFrame, width: int, entries: list[int]) -> DataFrame:
    """``query, beam``: the best nodes found for each of ``queries(query, vec)``, nodes themselves."""
    step = _beam_step(width + 1, BEAM, EXPAND)
    state = queries.mapInArrow(_query_units(width), "query long, unit binary").select(
        "query", "unit", *(F.array().cast(f"array<{t}>").alias(n) for n, t in (("beam", "long"), ("sim", "float"), ("done", "long"))),
        F.array("query", *map(F.lit, entries)).alias("next"))
    for hop in itertools.count():
        ahead = state.select("query", F.explode("next").alias("node"))
        near = ahead.join(graph.select("node", "near"), "node", "left").select(
            "query", F.explode(F.array_union(F.array("node"), F.coalesce("near", F.array().cast("array<long>")))).alias("node")).distinct()
        scored = near.join(units.select("node", F.col("unit").alias("u")), "node").groupBy("query").agg(
            F.collect_list(F.struct("node", "u")).alias("c"))  # at most EXPAND * (DEGREE + 1)
        rows = state.select("query", "unit", "beam", "sim", "done").join(scored, "query", "left").select(
            "query", "unit", "beam", "sim", "done", F.col("c.node").alias("near"), F.col("c.u").alias("units"))
        before, state = state, C.staged(rows.mapInArrow(step, _STATE), f"ann-hop-{hop}")
        if hop:
            C.discard(before)
        if state.filter(F.size("next") > 0).isEmpty():
            break
    return state.select("query", "beam")


def _exact(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = _matrix(batch.column(2), "f8", width), _matrix(batch.column(3), "f8", width)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array((a * b).sum(axis=1))], ["query", "node", "score"])
    return work


def nearest(vectors: DataFrame, is_query, top: int = TOP) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` nearest found of each query of ``vectors(vec_id, embedding)``.

    ``is_query`` is a condition on ``vec_id``. Nearness is the inner product; ties go to
    the smaller ``vec_id``. A query is not its own neighbour; equal vectors are.

    Vectors that are null, empty, zero, of another length than most, or hold null or
    non-finite components take no part, nor do rows without an id; rows that repeat an
    id and vector count once. With few vectors every one is compared. An empty table
    gives an empty table. ``top`` is at most ``BEAM``.
    """
    whole = C.staged(_usable(vectors).distinct(), "ann-vectors")
    first = whole.select(F.size("vec").alias("w")).limit(1).collect()
    width = first[0].w if first else 1
    nodes = whole.groupBy("vec").agg(F.min("vec_id").alias("node")).select("node", "vec")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    lengths = whole.agg(F.max(norm).alias("largest"), F.min(norm).alias("least")).first()
    largest = lengths.largest or 1.0
    units = C.staged(nodes.mapInArrow(_unit_maker(largest, width), "node long, vec array<float>, unit binary"), "ann-units")
    graph = neighbour_graph(units, units.count(), width + 1)

    members = C.staged(whole.join(units.select("node", "vec"), "vec").select("vec_id", "node"), "ann-members")
    asked = members.filter(is_query)
    starts = asked.select(F.col("node").alias("query")).distinct().join(
        units.select(F.col("node").alias("query"), "vec"), "query").select("query", "vec")
    entries = []
    if lengths.largest and lengths.least < 0.99 * largest:
        entries = [r.node for r in units.orderBy(norm.desc(), "node").select("node").limit(ENTRIES).collect()]
    found = greedy_search(graph, units, starts, width, entries).select("query", F.explode("beam").alias("node"))
    pairs = found.join(units.select(F.col("node").alias("query"), F.col("vec").alias("a")), "query").join(
        units.select("node", F.col("vec").alias("b")), "node").select("query", "node", "a", "b")
    scored = pairs.mapInArrow(_exact(width), "query long, node long, score double")

    # Of equal vectors the first top + 1 ids are enough for every query.
    least = Window.partitionBy("node").orderBy("vec_id")
    short = members.withColumn("r", F.row_number().over(least)).filter(F.col("r") <= top + 1).select("node", "vec_id")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = scored.join(short, "node").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top + 1)
    lists = lists.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("l"))
    # One list for all queries with the same vector, each without itself.
    rows = asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")).join(lists, "query")
    own = F.slice(F.filter("l", lambda x: x["vec_id"] != F.col("query_id")), 1, top)
    return rows.select("query_id", F.posexplode(own).alias("p", "x")).select(
        "query_id", (F.col("p") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))

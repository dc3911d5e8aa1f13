"""Toxicity by nearest labelled examples, exact TF-IDF cosine, block-max index.

Terms are all words of the labelled examples. Their document frequencies are counted over
all documents. A document's vector has the weights ``(1 + ln tf) * (ln((1 + N) / (1 + df)) + 1)``
and length 1; words that no example has count for its length, as words of one document.
Significance only weighs: words, and first 4 and 5 letters of longer words, that stand in
toxic examples significantly (two-proportion z) and several times more often than in clean
ones count ``BOOST`` times, so that a few telling words aren't lost in a long text.

The index is an inverted list for each term, ordered by example and cut into blocks
that know their largest weight (Ding and Suel, "Faster Top-k Document Retrieval Using
Block-Max Indexes", SIGIR 2011). The lists of rarer terms are added up; the long lists of
frequent ones are read block by block, for the queries whose bound for the block reaches
their k-th best cosine so far, so the neighbours are exact.

The score is the share of toxic neighbours, each weighted by its nearness,
``cos^2 / (1 - cos^2 + NEAR)``, and by how many labelled rows of its class it stands for,
shrunk towards the share of toxic rows; a document without any term gets the share of
toxic rows among examples without any. ``doc_id``, ``lang``, ``source`` and the document's
own label take no part.

The examples are a bounded sample: at most ``EXAMPLES`` of each class, those with the
least hashes of their id. Every document is searched against all of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm import common as C

EXAMPLES = 4000      # most examples of each class
LEAST_Z = 5.0        # a telling term's significance,
LEAST_LIFT = 6.0     # share of toxic examples with it to that of clean ones,
BOOST = 30.0         # and weight
NEAR = 0.02
NEIGHBOURS = 15
DENSE = 512          # terms that are multiplied as a matrix
QUERIES = 128        # texts that are searched together
LOOKS = (16,)        # numbers of scored blocks after which the k-th best is looked up
BLOCK = 64
SHRINK = 1.0         # weight of the overall share among the votes

_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¡¿·"


def terms_of(token: str) -> list[str]:
    """Terms of one lower-case token: the word, and its first letters marked with ``^``."""
    word = token.strip(_EDGES)
    if not word:
        return []
    out = [word]
    if len(word) >= 5:
        out.append("^" + word[:4])
    if len(word) >= 6:
        out.append("^" + word[:5])
    return out


_MARK = f"[{re.escape(_EDGES)}]"
# Runs of marks at the end and at the start of a token; a run is tried once, at its first mark.
_AT_END = re.compile(rf"{_MARK}(?<!{_MARK}.){_MARK}*+(?!\S)", re.DOTALL)
_AT_START = re.compile(rf"{_MARK}(?<!\S.){_MARK}*+", re.DOTALL)


def words_of(text: str) -> list[str]:
    """The words of a text in lower case, as in ``terms_of``."""
    return _AT_START.sub("", _AT_END.sub("", text.lower())).split()


class Vectors:
    """Term counts of texts over a vocabulary."""

    def __init__(self, vocabulary: list[str]):
        self.places = {t: i for i, t in enumerate(vocabulary)}
        self.heads = {t[1:5] for t in vocabulary if t[0] == "^"}  # of the first letters that are terms

    def _beginnings(self, word: str) -> Iterator[int]:
        """Places of the first letters of a word, as in ``terms_of``."""
        for n in (4, 5):
            if len(word) > n and (place := self.places.get("^" + word[:n])) is not None:
                yield place

    def distinct(self, text: str) -> set[int]:
        """The terms of a text."""
        words, heads = set(words_of(text)), self.heads
        found = set(map(self.places.get, words))
        found.discard(None)
        if heads:
            for word in [w for w in words if w[:4] in heads]:
                found.update(self._beginnings(word))
        return found

    def counts(self, text: str) -> tuple[dict[int, int], list[int]]:
        """Occurrences of the terms, and of each word that is none."""
        words, heads = Counter(words_of(text)), self.heads
        places = list(map(self.places.get, words))
        found = dict(zip(places, words.values()))
        others = [n for place, n in zip(places, words.values()) if place is None] if None in found else []
        found.pop(None, None)
        if heads:
            for word in [w for w in words if w[:4] in heads]:
                for place in self._beginnings(word):
                    found[place] = found.get(place, 0) + words[word]
        return found, others


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all spans, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


@dataclass
class Index:
    """Inverted lists of the examples, in blocks that know their largest weight."""

    factors: np.ndarray    # idf of each term, times its boost
    foreign: float         # idf of a word that no example has
    ids: np.ndarray        # doc_id of each example
    toxic: np.ndarray      # 0.0 or 1.0
    weight: np.ndarray     # labelled rows that the example stands for
    plain: float           # share of toxic rows without any term
    overall: float
    examples: np.ndarray   # postings by term, block and example
    counts: np.ndarray     # how often each posting's example has the term, in the least bytes that hold it
    lengths: np.ndarray    # of the vector of each example
    terms: np.ndarray      # first block of each term's list, and the end
    starts: np.ndarray     # first posting of each such block, and the end

    def _parts(self, places: np.ndarray, counts: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, float]:
        v = (1 + np.log(counts)) * self.factors[places]
        rest = ((1 + np.log(others)) * self.foreign) if len(others) else np.zeros(1)
        return v, np.sqrt((v * v).sum() + (rest * rest).sum())

    def vector(self, places: np.ndarray, counts: np.ndarray, others: np.ndarray) -> np.ndarray:
        v, length = self._parts(places, counts, others)
        return v / length

    @cached_property
    def weights(self) -> np.ndarray:
        """The weight of each posting. Made where it is used; the counts alone travel."""
        sizes = self.starts[self.terms[1:]] - self.starts[self.terms[:-1]]
        return (1 + np.log(self.counts.astype(float))) * np.repeat(self.factors, sizes) / self.lengths[self.examples]

    @cached_property
    def dense(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ``DENSE`` terms of most postings as columns over the examples, their block tops, and each term's column or -1.

        Made where it is used; the lists alone travel.
        """
        sizes = self.starts[self.terms[1:]] - self.starts[self.terms[:-1]]
        often = np.sort(np.argsort(-sizes, kind="stable")[:DENSE])
        columns = np.zeros((len(often), self.n_blocks * BLOCK))
        for row, term in enumerate(often):
            at = slice(self.starts[self.terms[term]], self.starts[self.terms[term + 1]])
            columns[row, self.examples[at]] = self.weights[at]
        place = np.full(len(sizes), -1)
        place[often] = np.arange(len(often))
        return columns, columns.reshape(len(often), self.n_blocks, BLOCK).max(2), place

    @property
    def n_blocks(self) -> int:
        return -(-len(self.ids) // BLOCK)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each ``(places, vector)`` the k examples of highest positive cosine, ties to the earlier example.

        The postings of the rarer terms are added up; for the others every block has a
        bound. A block is scored for the queries whose bound there reaches their k-th
        best cosine so far.
        """
        columns, tops, place = self.dense
        often, width = np.zeros((len(queries), len(columns))), self.n_blocks * BLOCK
        scores = np.zeros((len(queries), width))
        for row, (places, vector) in enumerate(queries):
            own = place[places]
            often[row, own[own >= 0]] = vector[own >= 0]
            rare, q = places[own < 0], vector[own < 0]
            begin = self.starts[self.terms[rare]]
            sizes = self.starts[self.terms[rare + 1]] - begin
            at = _spans(begin, sizes)
            scores[row] = np.bincount(self.examples[at], np.repeat(q, sizes) * self.weights[at], width)
        bounds = often @ tops + scores.reshape(len(queries), self.n_blocks, BLOCK).max(2)
        rank, kth = min(k, width), np.zeros(len(queries))
        seen = np.zeros((len(queries), self.n_blocks), bool)
        for turn, b in enumerate(np.argsort(-bounds.max(0), kind="stable")):
            if turn in LOOKS:  # scores of blocks not seen yet are too low, so this is a lower bound
                kth = np.partition(scores, -rank, 1)[:, -rank]
            asked = np.flatnonzero((bounds[:, b] > 0) & (bounds[:, b] >= kth - 1e-9))
            at = slice(b * BLOCK, (b + 1) * BLOCK)
            scores[asked, at] += often[asked] @ columns[:, at]
            seen[asked, b] = True
        # What a query has not scored can't be among its nearest, but must not stand half scored.
        scores.reshape(len(queries), self.n_blocks, BLOCK)[~seen] = 0
        out = []
        for row, least in zip(scores, kth):
            hit = np.flatnonzero(row > max(1e-12, least - 1e-9))
            if len(hit) > k:
                hit = hit[row[hit] >= np.partition(row[hit], -k)[-k] - 1e-12]
            hit = hit[np.lexsort((hit, -np.round(row[hit], 12)))[:k]]
            out.append((hit, row[hit]))
        return out

    def scored(self, counts: list[tuple[dict[int, int], list[int]]], k: int) -> list[tuple[float, list[tuple]]]:
        """Score and evidence of each text, given the occurrences of its terms and other words."""
        out: list = [(self.plain if len(self.ids) else self.overall, [])] * len(counts)
        asked = [row for row, (own, _) in enumerate(counts) if own] if len(self.ids) else []
        for first in range(0, len(asked), QUERIES):
            rows, queries = asked[first:first + QUERIES], []
            for row in rows:
                own, others = counts[row]
                places = np.array(sorted(own), np.int64)
                queries.append((places, self.vector(
                    places, np.array([own[i] for i in places.tolist()], float), np.array(others, float))))
            for row, (at, cosine) in zip(rows, self.nearest(queries, k)):
                if len(at):
                    out[row] = self._vote(at, cosine)
        return out

    def _vote(self, at: np.ndarray, cosine: np.ndarray) -> tuple[float, list[tuple]]:
        square = np.minimum(cosine, 1.0) ** 2
        votes = square / (1 - square + NEAR) * self.weight[at] / self.weight[at].mean()
        score = (float((votes * self.toxic[at]).sum()) + SHRINK * self.overall) / (float(votes.sum()) + SHRINK)
        return min(max(score, 0.0), 1.0), [
            (int(self.ids[i]), int(self.toxic[i]), float(c)) for i, c in zip(at[:3], cosine[:3])]


def build_index(rows: list[tuple], df: np.ndarray, n_docs: int, boost: np.ndarray | None = None) -> Index:
    """Index over ``(doc_id, toxic, weight, places, counts)`` rows; examples of a class stand together."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    factors = (np.log((1 + n_docs) / (1 + df)) + 1) * (1.0 if boost is None else boost)
    total = sum(r[2] for r in rows)
    overall = sum(r[1] * r[2] for r in rows) / total if total else 0.0
    bare = [r for r in rows if not len(r[3])]
    plain = (sum(r[1] * r[2] for r in bare) + overall) / (sum(r[2] for r in bare) + 1)
    none = np.zeros(0, np.int64)
    index = Index(
        factors, math.log((1 + n_docs) / 2) + 1, np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float),
        np.array([r[2] for r in rows], float), plain, overall, none, none, np.ones(len(rows)), none, none)
    term, no_terms = [np.asarray(r[3], np.int32) for r in rows], np.zeros(0, np.int32)
    for i, (places, r) in enumerate(zip(term, rows)):
        if len(places):
            index.lengths[i] = index._parts(places, np.asarray(r[4], float), none)[1]
    example = np.repeat(np.arange(len(rows), dtype=np.int32), [len(p) for p in term])
    counts = np.concatenate([no_terms, *(np.asarray(r[4], np.int32) for r in rows)])
    term = np.concatenate([no_terms, *term])
    order = np.lexsort((example, term))
    term, index.examples = term[order], example[order].astype(np.min_scalar_type(len(rows)))
    index.counts = counts[order].astype(np.min_scalar_type(int(counts.max(initial=0))))
    # An entry for each term and block that has postings.
    block = index.examples // BLOCK
    fresh = np.ones(len(term), bool)
    fresh[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
    begin = np.flatnonzero(fresh)
    index.starts = np.append(begin, len(term)).astype(np.int32 if len(term) < 1 << 31 else np.int64)
    index.terms = np.searchsorted(term[begin], np.arange(len(factors) + 1))
    return index


# -- Spark --------------------------------------------------------------------------

def examples_of(labels: DataFrame, learn_from: Column | None, most: int = EXAMPLES) -> DataFrame:
    """At most ``most`` labelled rows of each class: ``doc_id, toxic, weight``.

    An id with several labels takes the larger share, ties count as toxic.
    """
    known = labels.filter("doc_id is not null and toxic is not null")
    known = known if learn_from is None else known.filter(learn_from)
    known = known.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    totals = dict(known.groupBy("toxic").count().collect())
    picked = None
    for toxic in (0, 1):
        total = totals.get(toxic, 0)
        own = known.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        own = own.withColumn("weight", F.lit(total / min(most, total) if total else 1.0))
        picked = own if picked is None else picked.unionByName(own)
    return C.staged(picked, "toxicity-examples")


def _term_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic: Counter = Counter()
    clean: Counter = Counter()
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
            found = {t for token in set((text.as_py() or "").lower().split()) for t in terms_of(token)}
            (toxic if label else clean).update(found)
    names = list(toxic.keys() | clean.keys())
    yield pa.RecordBatch.from_pydict({
        "term": pa.array(names, pa.string()), "t": pa.array([toxic[n] for n in names], pa.int64()),
        "c": pa.array([clean[n] for n in names], pa.int64())})


def choose_terms(texts: DataFrame) -> tuple[list[str], np.ndarray]:
    """All words of ``texts(text, toxic)`` and the telling first letters, with their boosts."""
    sizes = dict(texts.groupBy("toxic").count().collect())
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    seen = texts.select("text", "toxic").mapInArrow(_term_counter, "term string, t long, c long").groupBy("term").agg(
        F.sum("t").alias("t"), F.sum("c").alias("c"))
    telling = F.lit(False)
    if n1 and n0:
        pooled = (F.col("t") + F.col("c")) / (n1 + n0)
        spread = F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))
        z = F.when(spread > 0, (F.col("t") / n1 - F.col("c") / n0) / spread)
        telling = F.coalesce((z >= LEAST_Z) & (F.col("t") / n1 >= LEAST_LIFT * (F.col("c") + 0.5) / n0), F.lit(False))
    kept = seen.select("term", telling.alias("telling")).filter(F.col("telling") | ~F.startswith(F.col("term"), F.lit("^")))
    rows = kept.orderBy("term").toArrow()  # the words of the bounded examples
    return rows["term"].to_pylist(), np.where(rows["telling"].to_numpy(), BOOST, 1.0)


def _frequencies(vocabulary: list[str]):
    """Numbers of texts that have each term, summed up for each task."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, n = Vectors(vocabulary), 0
        seen: Counter = Counter()
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0):
                seen.update(vectors.distinct(text.as_py() or ""))
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *seen.keys()], pa.int64()), pa.array([n, *seen.values()], pa.int64())], ["place", "n"])
    return work


def _vectoriser(vocabulary: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors(vocabulary)
        for batch in batches:
            places, counts, lengths = [], [], []
            for text in batch.column("text"):
                own, _ = vectors.counts(text.as_py() or "")
                keys = sorted(own)
                places += keys
                counts += [own[i] for i in keys]
                lengths.append(len(keys))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), batch.column("weight"),
                 C.list_array(np.array(places, np.int32), lengths, pa.int32()),
                 C.list_array(np.array(counts, np.int32), lengths, pa.int32())], ["doc_id", "toxic", "weight", "places", "counts"])
    return work


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that a task holds few texts twice."""
    for batch in batches:
        for first in range(0, batch.num_rows, 8 * QUERIES):
            yield batch.slice(first, 8 * QUERIES)


class _Scorer:
    def __init__(self, vocabulary: list[str], index: Index, k: int):
        self.vectors, self.index, self.k = Vectors(vocabulary), index, k

    def __call__(self, texts: pa.Array) -> list[tuple[float, list[tuple]]]:
        out = []
        for first in range(0, len(texts), QUERIES):
            part = texts[first:first + QUERIES]
            out += self.index.scored([self.vectors.counts(t.as_py() or "") for t in part], self.k)
        return out


def _text_scorer(vocabulary: list[str], index: Index, k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(vocabulary, index, k)
        evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
        for batch in _parts(batches):
            got = scorer(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in got], pa.float64()),
                 pa.array([[dict(zip(("doc_id", "toxic", "cosine"), e)) for e in ev] for _, ev in got], evidence)],
                ["doc_id", "score", "evidence"])
    return work


def _row_filter(vocabulary: list[str], index: Index, k: int, threshold: float, text_at: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(vocabulary, index, k)
        for batch in _parts(batches):
            keep = [score < threshold for score, _ in scorer(batch.column(text_at))]
            yield batch.filter(pa.array(keep, pa.bool_()))
    return work


def _fit(docs: DataFrame, labels: DataFrame, learn_from: Column | None) -> tuple[list[str], Index]:
    """Vocabulary and index; reads the examples' texts, then all texts for the frequencies."""
    examples = examples_of(labels, learn_from)
    # The examples are at most 2 * EXAMPLES narrow rows.
    texts = C.staged(docs.select("doc_id", "text").join(F.broadcast(examples), "doc_id"), "toxicity-texts")
    vocabulary, boost = choose_terms(texts)
    seen = docs.select("text").mapInArrow(_frequencies(vocabulary), "place long, n long").groupBy("place").agg(
        F.sum("n").alias("n")).toArrow()
    place, n = seen["place"].to_numpy(), seen["n"].to_numpy()
    df = np.zeros(len(vocabulary))
    df[place[place >= 0]] = n[place >= 0]
    n_docs = int(n[place < 0].sum())
    rows = texts.mapInArrow(
        _vectoriser(vocabulary), "doc_id long, toxic int, weight double, places array<int>, counts array<int>")
    # Rows that share an id give one example: the ids bound what the driver sees.
    rows = rows.groupBy("doc_id", "toxic", "weight").agg(F.min(F.struct("places", "counts")).alias("v"))
    found = rows.select("doc_id", "toxic", "weight", "v.places", "v.counts").toArrow()
    lists = [[x.values.to_numpy(zero_copy_only=False) for x in found[c]] for c in ("places", "counts")]
    rows = list(zip(*(found[c].to_pylist() for c in ("doc_id", "toxic", "weight")), *lists))
    C.discard(texts)
    C.discard(examples)
    return vocabulary, build_index(rows, df, n_docs, boost)


def toxicity(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, k: int = NEIGHBOURS) -> DataFrame:
    """``doc_id, score, evidence`` for each row of ``docs(doc_id, text)``.

    ``labels(doc_id, toxic)`` teach, all of them or those where ``learn_from`` holds. ``score`` is between 0
    and 1; ``evidence`` names up to three nearest examples with label and cosine.

    Null and empty texts have no term and get the score of such examples. Rows without
    an id are scored, labels without an id or a value are left out, repeated rows give
    repeated results. Without labels every score is 0. Other columns are not read. An
    empty table gives an empty table.
    """
    vocabulary, index = _fit(docs, labels, learn_from)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _text_scorer(vocabulary, index, k),
        "doc_id long, score double, evidence array<struct<doc_id:long,toxic:int,cosine:double>>")


def drop_toxic(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, threshold: float = 0.5,
               k: int = NEIGHBOURS) -> DataFrame:
    """``docs`` with all columns, without the rows that score ``threshold`` or more.

    Rows are scored where they are; texts are not shuffled. Otherwise as ``toxicity``.
    """
    vocabulary, index = _fit(docs, labels, learn_from)
    work = _row_filter(vocabulary, index, k, threshold, docs.columns.index("text"))
    return docs.mapInArrow(work, docs.schema)

"""Distinct sampled segmentations of whole texts into SentencePiece pieces, and decoding.

A segmentation is a path through the lattice of pieces; its probability is the product
of its pieces' weights over the sum of all paths. The ``k`` samples are drawn without
replacement by Gumbel top-k (Kool, van Hoof, Welling, ICML 2019): every path has a
Gumbel-perturbed log-probability, and the k largest win. They are found by A* search
(Maddison, Tarlow, Minka, NIPS 2014): an agenda holds sets of paths with the exact
perturbed maximum of each; the best set is taken, its best path drawn, and what is left
of it falls into the sets of paths that first differ at each later choice. A set's
maximum is a Gumbel truncated at the one it was part of, so nothing is enumerated.

Pieces never reach across the start of a run of spaces or over a character that only
byte pieces cover, so the lattice is a chain of short ones. Those of equal words are
built once, forward sums turn them into chains of conditional choices, and the choices
of all texts of a slice are drawn together.

``inclusion`` is the probability that a path's perturbed value exceeds the first one
left out, the weight that makes sums over the sample unbiased.

Unigram models weigh a piece by its score. BPE models only rank pieces, so there a
piece of rank r weighs ``1 / (r + 2)``, normalised over the vocabulary.

Random numbers are hashes of the row key and of the place of a choice, so results don't
depend on how rows are spread over tasks.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from presswork.llm import common as C

SAMPLES = 2
SLICE = 3 << 18
SPACE = 0x20
# Sets of paths below these log-probabilities are looked at only if they can matter.
NEAR = -45.0
# log of the least exponential variate that ``_uniform`` can give, with a margin
LEAST_LOG_E = -37.0

_U = np.uint64
_CHARS = C.fmix(np.arange(1 << 16, dtype=_U) + _U(0x632BE59BD9B4E019))


def _values(points: np.ndarray) -> np.ndarray:
    values = _CHARS[points & np.uint32(0xFFFF)]
    if len(points) and points.max() > 0xFFFF:
        values = np.where(points > 0xFFFF, C.fmix(points.astype(_U) + _U(0x632BE59BD9B4E019)), values)
    return values


def _uniform(seed: np.ndarray, *parts) -> np.ndarray:
    """Numbers in (0, 1) from a seed and the place of a choice."""
    x = seed
    for i, part in enumerate(parts):
        x = C.fmix(x + np.asarray(part).astype(_U) * _U(0x9E3779B97F4A7C15) + _U(i + 1))
    return ((x >> _U(11)).astype(np.float64) + 0.5) / (1 << 53)


class Pieces:
    """Vocabulary of a model file: weights and a hash table from text to piece."""

    _of_worker: dict[str, Pieces] = {}

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        self.byte_ids = np.full(256, -1, np.int64)
        self.data: list[bytes] = [b""] * n
        texts, scores = {}, np.array([model.get_score(i) for i in range(n)])
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.data[i] = bytes([int(piece[3:5], 16)])
            elif not special[i]:
                texts[i] = piece.replace("▁", " ")
                self.data[i] = texts[i].encode()
        if (self.byte_ids < 0).any():
            raise ValueError("the model needs byte pieces")
        own = scores[list(texts)]
        if (own == np.round(own)).all():  # ranks, not log-probabilities
            weights = -np.log(2 - own)
            weights -= np.log(np.exp(weights).sum())
        else:
            weights = own
        self.log_weight = np.full(n + 1, -np.inf)  # the last is that of id -1, no piece
        self.log_weight[list(texts)] = weights
        self.byte_weight = float(weights.min())
        self.longest = max(map(len, texts.values()))
        self.single = np.full(1 << 16, -1, np.int64)
        self.single_high: dict[int, int] = {}
        for i, text in texts.items():
            if len(text) == 1:
                if ord(text) < 1 << 16:
                    self.single[ord(text)] = i
                else:
                    self.single_high[ord(text)] = i
        self._hash(texts)

    @classmethod
    def of_worker(cls, path: str) -> Pieces:
        if path not in cls._of_worker:
            cls._of_worker[path] = cls(path)
        return cls._of_worker[path]

    def _hash(self, texts: dict[int, str]) -> None:
        points = np.frombuffer("".join(texts.values()).encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(t) for t in texts.values()])
        starts = ends - [len(t) for t in texts.values()]
        hashes, ids = C.span_hash(C.prefix_hashes(_values(points)), starts, ends), np.array(list(texts), np.int32)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[hashes >> _U(44)] = True
        self.tables, bits = [], 17
        while len(ids):
            table, keys = np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, _U)
            slot = (hashes >> _U(11 * len(self.tables) % 45)) & _U((1 << bits) - 1)
            _, first = np.unique(slot, return_index=True)
            table[slot[first]], keys[slot[first]] = ids[first], hashes[first]
            self.tables.append((_U(11 * len(self.tables) % 45), _U((1 << bits) - 1), table, keys))
            rest = np.ones(len(ids), bool)
            rest[first] = False
            hashes, ids = hashes[rest], ids[rest]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Id of the piece with each hash, -1 for none."""
        out = np.full(len(hashes), -1, np.int32)
        at = np.flatnonzero(self.maybe[hashes >> _U(44)])
        for shift, mask, table, keys in self.tables:
            slot = (hashes[at] >> shift) & mask
            hit = keys[slot] == hashes[at]
            out[at[hit]] = table[slot[hit]]
            at = at[~hit]
        return out

    def covered(self, points: np.ndarray) -> np.ndarray:
        out = self.single[points & np.uint32(0xFFFF)] >= 0
        high = points > 0xFFFF
        if high.any():
            out[high] = [p in self.single_high for p in points[high].tolist()]
        return out

    def decode(self, ids) -> str:
        """The text behind ids: pieces and bytes end to end, without the space put in front."""
        text = b"".join(map(self.data.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


class Words:
    """The lattices of the distinct words of a slice as chains of conditional choices.

    Row ``off[t] + rank[w]`` is about the piece that ends at character t + 1 of word w, long
    words first, so the rows of a place t are one block: their ``ids``, the ``weight`` of the
    ways and the running sum ``upto`` of their probabilities for each piece length; ``alpha``
    is the weight of all, ``ways`` their number.
    """

    def __init__(self, pieces: Pieces, points: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        order = np.argsort(starts - ends, kind="stable")  # longest first
        length = (ends - starts)[order]
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        at, total, longest = np.cumsum(length) - length, int(length.sum()), int(length.max(initial=0))
        live = np.searchsorted(-length, -np.arange(1, longest + 1), "right")
        self.off = off = np.concatenate([[0], np.cumsum(live)])
        text = points[np.repeat(starts[order] - at, length) + np.arange(total)]
        prefix, width = C.prefix_hashes(_values(text)), max(min(pieces.longest, longest), 1)
        end = np.concatenate([at[:k] + t + 1 for t, k in enumerate(live.tolist())]) if longest else at
        ids, last = np.full((total, width), -1, np.int32), 1
        for n in range(1, min(width, longest) + 1):
            own = end[off[n - 1]:]
            ids[off[n - 1]:, n - 1] = pieces.find(C.span_hash(prefix, own - n, own))
            if (ids[off[n - 1]:, n - 1] >= 0).any():
                last = n
        self.ids = np.ascontiguousarray(ids[:, :last])
        del ids, prefix, end
        weight = pieces.log_weight[self.ids]
        # A word that no piece covers is one character; its bytes are one way.
        single = int(np.searchsorted(-length, -1, "left"))
        bare = single + np.flatnonzero(self.ids[single:len(order), 0] < 0)
        self.foreign: list[np.ndarray] = []
        for row in bare.tolist():
            own = pieces.byte_ids[list(chr(int(text[at[row]])).encode())]
            weight[row, 0] = pieces.byte_weight * len(own)
            self.ids[row, 0] = own[0] if len(own) == 1 else pieces.size + len(self.foreign)
            if len(own) > 1:
                self.foreign.append(own)
        # Forward sums: a way to end at t with a piece of n characters weighs alpha[t - n] + weight.
        self.weight, self.alpha = weight, np.full(total, -np.inf)
        self.upto = np.full((total, last), 2.0, np.float32)
        for t in range(longest):
            rows, most, count = slice(off[t], off[t + 1]), min(t + 1, last), int(live[t])
            for n in range(1, min(t, last) + 1):
                weight[rows, n - 1] += self.alpha[off[t - n]:off[t - n] + count]
            own = weight[rows, :most]
            top = own.max(axis=1)
            share = np.exp(own - top[:, None])
            np.cumsum(share, axis=1, out=share)
            self.alpha[rows] = top + np.log(share[:, -1])
            share /= share[:, -1:]
            share[share >= 1 - 1e-9] = 2.0  # the last way takes what rounding left over
            self.upto[rows, :most] = share
        self.ways = np.isfinite(weight).sum(axis=1)

    def place(self, row: np.ndarray) -> np.ndarray:
        """The place t of each row."""
        return np.searchsorted(self.off, row, "right") - 1

    def log_p(self, row: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log-probability of a piece of ``n`` characters, given where it ends."""
        return self.weight[row, n - 1] - self.alpha[row]


class _Paths:
    """One path each of some texts: for each choice the word occurrence, row and piece length."""

    def __init__(self, docs: np.ndarray, at: np.ndarray, occ: np.ndarray, row: np.ndarray, n: np.ndarray):
        self.docs, self.at, self.occ, self.row, self.n = docs, at, occ, row, n
        self.slot = {d: i for i, d in enumerate(docs.tolist())}
        self.total = np.zeros(len(docs))
        self.gumbel = np.zeros(len(docs))


def _draw(words: Words, seeds: np.ndarray, tag: int, occ: np.ndarray, rank: np.ndarray, left: np.ndarray):
    """Draw the choices of word occurrences with ``left`` characters to go; in order of occurrence."""
    live = np.flatnonzero(left > 0)
    count, steps = np.zeros(len(occ), np.int64), []
    seeds, occ, rank, left, step = seeds[live], occ[live], rank[live], left[live], 0
    while len(live):
        r = words.off[left - 1] + rank
        u = _uniform(seeds, tag, occ, left).astype(np.float32)
        n = 1 + np.count_nonzero(words.upto[r] < u[:, None], axis=1)
        steps.append((live, step, r, n))
        count[live] = step = step + 1
        left = left - n
        more = left > 0
        live, seeds, occ, rank, left = live[more], seeds[more], occ[more], rank[more], left[more]
    start = np.cumsum(count) - count
    rows, ns = np.zeros(int(count.sum()), np.int64), np.zeros(int(count.sum()), np.int64)
    for who, step, r, n in steps:
        rows[start[who] + step], ns[start[who] + step] = r, n
    return count, rows, ns


def _open(agendas: list, words: Words, paths: _Paths, seeds: np.ndarray, tag: int, first: np.ndarray,
          closed: list[frozenset], most: int) -> None:
    """Put the sets that leave each path at a choice from ``first`` on into the agendas.

    ``closed`` are the lengths no longer open at ``first``. Only the ``most`` best can
    ever be taken. Sets of little mass are left out of the first look; it counts if no
    Gumbel could lift them over the ones it found.
    """
    sizes = np.diff(paths.at)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(owner)) - paths.at[owner]
    lp = words.log_p(paths.row, paths.n)
    sums = np.concatenate([[0.0], np.cumsum(lp)])
    before = sums[:-1] - sums[paths.at[:-1]][owner]
    paths.total = sums[paths.at[1:]] - sums[paths.at[:-1]]
    open_here = place >= first[owner]
    near = before >= NEAR
    chosen, redo = _best(words, paths, seeds, tag, lp, before, owner, place, np.flatnonzero(near & open_here), first,
                         closed, most)
    if redo.any():
        far = np.zeros(len(sizes), bool)
        far[owner[open_here & ~near]] = True
        redo &= far
        chosen = [c for c in chosen if not redo[c[0]]]
        again = np.flatnonzero(open_here & redo[owner])
        chosen += _best(words, paths, seeds, tag, lp, before, owner, place, again, first, closed, most)[0]
    for i, value, m, at in chosen:
        taken = frozenset({int(paths.n[at])}) | (closed[i] if m == first[i] else frozenset())
        heapq.heappush(agendas[paths.docs[i]], (-value, tag, m, taken))


def _best(words, paths, seeds, tag, lp, before, owner, place, at, first, closed, most):
    """The ``most`` sets of each path with the highest maxima among the choices ``at``."""
    own, m = owner[at], place[at]
    p = np.exp(lp[at])
    ways = words.ways[paths.row[at]]
    for j in np.flatnonzero(m == first[own]).tolist():
        for n in closed[own[j]]:
            p[j] += np.exp(words.weight[paths.row[at[j]], n - 1] - words.alpha[paths.row[at[j]]])
            ways[j] -= 1
    some = ways > 1
    at, own, m, p = at[some], own[some], m[some], p[some]
    mass = before[at] + np.log1p(-np.minimum(p, 1 - 1e-16))
    log_e = np.log(-np.log(_uniform(seeds[paths.docs[own]], tag, np.full(len(m), 1 << 40), m)))
    best = -np.logaddexp(-paths.gumbel[own], log_e - mass)
    # Only choices up to the ``most``-th best value of a path are sorted.
    heads = np.flatnonzero(np.diff(own, prepend=-1))
    counts, rest = np.diff(heads, append=len(own)), best
    for i in range(most if len(own) else 0):
        bound = np.repeat(np.maximum.reduceat(rest, heads), counts)
        if i < most - 1:
            rest = np.where(rest == bound, -np.inf, rest)
    high = np.flatnonzero(best >= bound) if len(own) and most else np.zeros(0, np.int64)
    order = high[np.lexsort((-best[high], own[high]))]
    starts = np.searchsorted(own[order], np.arange(len(first)))
    rank = np.arange(len(order)) - starts[own[order]]
    order = order[rank < most]
    worst = np.full(len(first), np.inf)
    np.minimum.at(worst, own[order], best[order])
    worst[np.bincount(own[order], minlength=len(first)) < most] = -np.inf
    chosen = list(zip(own[order].tolist(), best[order].tolist(), m[order].tolist(), at[order].tolist()))
    return chosen, worst <= NEAR - LEAST_LOG_E


def sample_texts(pieces: Pieces, texts: list[str], keys: list[int], k: int) -> list[list[tuple]]:
    """For each text up to ``k`` samples ``(ids, log_prob, gumbel, inclusion)``, best first."""
    lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    points = np.frombuffer("".join(" " + t if t else "" for t in texts).encode("utf-32-le"), "<u4")
    total, doc_at = len(points), np.concatenate([[0], np.cumsum(lengths)])
    cover = pieces.covered(points) & (points != 0x2581)
    border = np.zeros(total + 1, bool)
    border[doc_at] = True
    space = points == SPACE
    border[1:-1] |= space[1:] & ~space[:-1] | ~cover[1:] | ~cover[:-1]
    starts = np.flatnonzero(border[:-1])
    ends = np.append(starts[1:], total) if len(starts) else starts
    hashes = C.span_hash(C.prefix_hashes(_values(points)), starts, ends)
    _, one, word = np.unique(hashes, return_index=True, return_inverse=True)
    words = Words(pieces, points, starts[one], ends[one])
    size = ends - starts
    rank = words.rank[word]
    occ_at = np.searchsorted(starts, doc_at)
    seeds = C.fmix(np.array([key & 0xFFFFFFFFFFFFFFFF for key in keys], _U) ^ _U(0xD1B54A32D192ED03))
    doc_of = np.repeat(np.arange(len(texts)), np.diff(occ_at))
    local = np.arange(len(starts)) - occ_at[doc_of]

    count, rows, ns = _draw(words, seeds[doc_of], 0, local, rank, size)
    at = np.concatenate([[0], np.cumsum(count)])[occ_at]
    paths = _Paths(np.arange(len(texts)), at, np.repeat(local, count), rows, ns)
    paths.gumbel = -np.log(-np.log(_uniform(seeds, 0, np.full(len(texts), 1 << 41))))
    agendas: list[list] = [[] for _ in texts]
    found = [paths]
    _open(agendas, words, paths, seeds, 0, np.zeros(len(texts), np.int64), [frozenset()] * len(texts), k)
    for tag in range(1, k):
        paths = _next(words, found, agendas, seeds, tag, k, occ_at, rank, size)
        if paths is None:
            break
        found.append(paths)

    out: list[list[tuple]] = [[] for _ in texts]
    for paths in found:
        ids, at = _ids(words, pieces, paths)
        for i, d in enumerate(paths.docs.tolist()):
            phi, threshold = float(paths.total[i]), -agendas[d][0][0] if agendas[d] else -np.inf
            inclusion = float(-np.expm1(-np.exp(phi - threshold))) if threshold > -np.inf else 1.0
            out[d].append((ids[at[i]:at[i + 1]], phi, float(paths.gumbel[i]), inclusion))
    return out


def _next(words, found, agendas, seeds, tag, k, occ_at, rank, size) -> _Paths | None:
    """Take the best set of each text and draw its best path; the new parts of all texts at once."""
    docs = np.array([d for d, agenda in enumerate(agendas) if agenda], np.int64)
    if not len(docs):
        return None
    taken = [heapq.heappop(agendas[d]) for d in docs]
    m = np.array([t[2] for t in taken])
    old = [(found[t[1]], found[t[1]].slot[d]) for d, t in zip(docs.tolist(), taken)]
    begin = np.array([p.at[i] for p, i in old])
    row = np.array([p.row[b + j] for (p, _), b, j in zip(old, begin, m)])
    occ = np.array([p.occ[b + j] for (p, _), b, j in zip(old, begin, m)])
    share = np.exp(words.weight[row] - words.alpha[row][:, None])
    for i, t in enumerate(taken):
        share[i, [n - 1 for n in t[3]]] = 0
    share = np.cumsum(share, axis=1)
    u = _uniform(seeds[docs], tag, np.full(len(docs), 1 << 42)) * share[:, -1]
    n = 1 + np.minimum((share <= u[:, None]).sum(axis=1), share.shape[1] - 1)

    here, end = occ_at[docs] + occ, occ_at[docs + 1]
    span = end - here
    part = np.repeat(np.arange(len(docs)), span)
    head = np.cumsum(span) - span
    where = here[part] + np.arange(len(part)) - head[part]
    left = size[where]
    left[head] = words.place(row) + 1 - n
    occs_ = where - occ_at[docs][part]
    count, rows, ns = _draw(words, seeds[docs][part], tag, occs_, rank[where], left)
    occs = np.repeat(occs_, count)
    ends = np.cumsum(count)[head + span - 1]
    parts, a = [], 0
    for i, ((p, _), b) in enumerate(zip(old, ends.tolist())):
        x, y = begin[i], begin[i] + m[i]
        parts += [(p.occ[x:y], p.row[x:y], p.n[x:y]), (occ[i:i + 1], row[i:i + 1], n[i:i + 1]), (occs[a:b], rows[a:b], ns[a:b])]
        a = b
    sizes = m + 1 + np.diff(ends, prepend=0)
    paths = _Paths(docs, np.concatenate([[0], np.cumsum(sizes)]), *(np.concatenate(x) for x in zip(*parts)))
    paths.gumbel = np.array([-t[0] for t in taken])
    # The set's other paths, without those that the taken lengths lead to.
    _open(agendas, words, paths, seeds, tag, m, [t[3] for t in taken], k - tag)
    return paths


def _ids(words: Words, pieces: Pieces, paths: _Paths) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of the paths end to end in the order of the text, and where each path starts."""
    total = len(paths.occ)
    fresh = np.ones(total, bool)
    fresh[1:] = paths.occ[1:] != paths.occ[:-1]
    fresh[paths.at[:-1][np.diff(paths.at) > 0]] = True
    start = np.flatnonzero(fresh)
    length = np.diff(np.append(start, total))
    # Choices run backwards inside a word.
    turned = np.repeat(2 * start + length - 1, length) - np.arange(total)
    ids = words.ids[paths.row[turned], paths.n[turned] - 1]
    if not words.foreign or not total or ids.max() < pieces.size:
        return ids, paths.at
    width = np.ones(total, np.int64)
    high = np.flatnonzero(ids >= pieces.size)
    own = [words.foreign[i - pieces.size] for i in ids[high].tolist()]
    width[high] = [len(x) for x in own]
    out = np.repeat(ids, width)
    places = np.concatenate([[0], np.cumsum(width)])
    for place, x in zip(places[high].tolist(), own):
        out[place:place + len(x)] = x
    return out, places[paths.at]


# -- Spark --------------------------------------------------------------------------

def _key(doc_id, text: str) -> int:
    """Seed of a row: its id, or a hash of its text where it has none."""
    if isinstance(doc_id, int):
        return doc_id
    return int.from_bytes(hashlib.blake2b((f"{doc_id}\n" if doc_id is not None else text).encode(), digest_size=8).digest())


def _encoder(path: str, k: int, key_type: pa.DataType):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of_worker(path)
        for batch in batches:
            _, offsets = C.utf8(batch.column(1))
            for first, last in C.slices(offsets, SLICE):
                part = batch.slice(first, last - first)
                ids = part.column(0).to_pylist()
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = sample_texts(pieces, texts, [_key(i, t) for i, t in zip(ids, texts)], k)
                rows = [(doc_id, r, *s) for doc_id, own in zip(ids, found) for r, s in enumerate(own)]
                lengths = np.array([len(r[2]) for r in rows], np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows], key_type), pa.array([r[1] for r in rows], pa.int32()),
                    C.list_array(np.concatenate([r[2] for r in rows]), lengths, pa.int32()),
                    *(pa.array([r[i] for r in rows], pa.float64()) for i in (3, 4, 5))],
                    ["doc_id", "sample", "ids", "log_prob", "gumbel", "inclusion"])
    return work


def sample_segmentations(docs: DataFrame, model_path: str, k: int = SAMPLES) -> DataFrame:
    """Up to ``k`` distinct segmentations of each row of ``docs(doc_id, text)``.

    Columns: ``doc_id, sample`` (from 0, in the order of the perturbed values), ``ids``,
    ``log_prob``, ``gumbel``, ``inclusion``. Texts are taken whole, with one space put in
    front of them; whatever no piece covers becomes byte pieces, so decoding gives back
    every text.

    A null or empty text has one segmentation, the empty one, of probability 1; a text
    with fewer than ``k`` segmentations gives them all. Rows that share id and text give
    the same samples; a row without an id is seeded by its text. Other columns are not
    read. An empty table gives an empty table. Memory follows the longest text, at a few
    hundred bytes for each character of its distinct words.
    """
    kind = dict(docs.dtypes)["doc_id"]
    narrow = docs.select("doc_id", "text")
    key_type = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    return narrow.mapInArrow(
        _encoder(model_path, k, key_type),
        f"doc_id {kind}, sample int, ids array<int>, log_prob double, gumbel double, inclusion double")


def _decoder(path: str, at: int, names: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of_worker(path)
        for batch in batches:
            texts = [None if ids is None else pieces.decode(ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)
    return work


def decode_segmentations(encoded: DataFrame, model_path: str, name: str = "text") -> DataFrame:
    """``encoded`` with all columns and the text behind ``ids`` as ``name``; null ids give null."""
    name = C.free_name(encoded, name)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(
        _decoder(model_path, encoded.columns.index("ids"), [*encoded.columns, name]), f"{fields}, `{name}` string")

"""Hard negatives, license spans and periodic runs against brute force, and their odd cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from presswork.llm import licenses, negatives, periodic
from presswork.llm.queries import REGISTRY
from test_edges import CLASH, ROWS


# -- hard negatives ---------------------------------------------------------------

def brute_negatives(rows, every=100, k=5, n=10):
    out = []
    for a, label, v in rows:
        if a % every:
            continue
        score = {b: sum(x * y for x, y in zip(v, w)) for b, _, w in rows}
        ranked = sorted((b for b, _, _ in rows if b != a), key=lambda b: (-score[b], b))
        of = {b: other for b, other, _ in rows}
        for p in [b for b in ranked if of[b] == label][:k]:
            fits = [b for b in ranked if of[b] != label and 30 * score[p] <= 100 * score[b] <= 90 * score[p]]
            out += [(a, p, i + 1, b, score[p], score[b]) for i, b in enumerate(fits[:n])]
    return sorted(out)


@pytest.mark.parametrize("block, sample", [(2048, 8192), (16, 5)])
def test_negatives_equal_brute_force(spark, block, sample):
    rng = random.Random(block)
    centres = [[rng.randint(-40, 40) for _ in range(9)] for _ in range(4)]
    rows = []
    for i in range(260):
        c = rng.randrange(4)
        v = [x + rng.randint(-25, 25) for x in centres[c]] if rng.random() < 0.8 else centres[c]
        rows.append((i, c if i % 13 else 9, v))
    vectors = spark.createDataFrame([(i, l, [x / 256 for x in v]) for i, l, v in rows], "vec_id long, label int, embedding array<float>")
    found = negatives.hard_negatives(vectors, F.col("vec_id") % 20 == 0, block=block, sample=sample)
    assert sorted(map(tuple, found.collect())) == brute_negatives(rows, 20)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0]), (2, 1, [0.5, 0.5, 0.5]), (2, 1, [0.5, 0.5, 0.5]), (2, 2, [0.0]), (3, 2, [0.5, 9.0]),
            (4, 2, [0.4]), (5, None, [0.5]), (6, 2, None), (7, 2, [nan, 0.5]), (8, 2, [inf]), (9, 2, [None]), (None, 2, [0.5]),
            (10, 2, []), (11, 2, [3e38]), (20, 3, [0.0, 0.0]), (40, 5, [1.0]), (60, 6, []), (61, 6, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    vectors = vectors.selectExpr("*", "1 as anchor_id", "2 as score", "3 as slot", "4 as rank")
    rows = [(0, 1, [256, 0, 0]), (1, 1, [256, 0, 0]), (2, 1, [128, 128, 128]), (3, 2, [128, 2304, 0]), (4, 2, [102, 0, 0]),
            (10, 2, [0, 0, 0]), (20, 3, [0, 0, 0]), (40, 5, [256, 0, 0]), (60, 6, [0, 0, 0]), (61, 6, [0, 0, 0])]
    got = negatives.hard_negatives(vectors, F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 20)
    assert negatives.hard_negatives(vectors.filter("false"), F.col("vec_id") % 20 == 0).collect() == []


def test_omitted_dimensions_are_counted():
    """Scores stay exact when most dimensions are left out of the index."""
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(50, 40)) * np.geomspace(300, 1, 40)).astype(np.int32)
    ids, labels = np.arange(50), np.arange(50) % 2
    block = negatives.Block(50, ids.tobytes(), labels.tobytes(), x.tobytes())
    none = np.full((50, 1), -(1 << 62))
    asked = negatives.Anchors(50, ids.tobytes(), labels.tobytes(), x.tobytes(), none.tobytes(), (-none).tobytes(), b"")
    for least in (-(1 << 62), 0, 5000, 10 ** 5, 10 ** 9):
        scores, kept = asked.join(block, np.full(50, least))
        assert (scores == x.astype(np.int64) @ x[kept].astype(np.int64).T).all()
        reached = (x.astype(np.int64) @ x.astype(np.int64).T >= least).any(0)
        assert set(np.flatnonzero(reached)) <= set(kept)


# -- licenses ---------------------------------------------------------------------

def brute_phrases(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = []
    for label, phrase in licenses.PHRASES:
        parts = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i:i + len(parts)] == parts]
    return len(words), found


LICENSED = [
    (101, "Released under the MIT License."), (102, "mit-license, MIT  license; apache\nLicense cc/by"), (103, "mit licenses"),
    (104, "x " * 40 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this fine software and"
        " associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    (105, "This work is licensed under the GNU General Public License, version 3."), (106, "gnu general public license " * 50),
    (107, "Licensed under CC BY-NC 4.0."), (108, "licensed under cc by nc"), (109, "Licensed under the Apache License, Version 1.1"),
    (110, "MITKLicense mit licİense"), (111, "permission is hereby granted"), (None, "MIT License"), (112, "cc by"), (112, "cc by")]


def test_licenses(spark, documents):
    rows = licenses.scan_licenses(documents(LICENSED + ROWS, **CLASH, t="x", label="y", key=1)).collect()
    assert len(rows) == len(LICENSED + ROWS)
    want = []
    for i, text in LICENSED + ROWS:
        n, found = brute_phrases(text)
        places = [p for p, _ in found]
        want.append((str(i), n, len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))))
    assert sorted(map(str, want)) == sorted(
        str((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in rows)
    labels = {r.doc_id: (r.labels, r.score) for r in rows}
    assert labels[101] == ("mit", 1.0) and labels[105] == ("gpl,gpl-3.0", 1.0) and labels[107] == ("cc-by,cc-by-nc-4.0", 1.0)
    assert labels[104][0] == "mit" and 0.9 < labels[104][1] < 1  # one word put in, the phrase itself is not there
    assert labels[109][0] == "apache" and labels[108][0] == "cc-by" and labels[111][0] == "" and 0 < labels[111][1] < 0.8
    assert all(r.score == 0 for r in rows if r.doc_id == 6 and r.n_words > 1000)
    spans = licenses.license_spans(documents([LICENSED[3]])).collect()
    assert [(r.label, r.first, r.phrase) for r in spans] == [("mit", 40, False)] and spans[0].end > 60


def test_licenses_without_broadcast(spark, documents, monkeypatch):
    docs = documents(LICENSED)
    wide = sorted(map(str, licenses.scan_licenses(docs).collect()))
    monkeypatch.setattr(licenses, "BROADCAST_RUNS", 0)
    assert sorted(map(str, licenses.scan_licenses(docs).collect())) == wide
    assert licenses.scan_licenses(docs.filter("false")).collect() == []
    none = licenses.default_templates(spark).filter("false")
    assert {(r.labels, r.score) for r in licenses.scan_licenses(docs, none).collect()} == {("", 0.0)}


# -- periodic runs ----------------------------------------------------------------

def brute_runs(words):
    out = []
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            s = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            length = i - s + p
            part = words[s:s + length]
            if length >= max(6, 4 * p) and not any(part[q:] == part[:-q] for q in range(1, p)):
                out.append((s, p, length))
            i = max(i, s + 1)
    return sorted(out)


def as_runs(rows):
    return sorted((int(s), int(p), int(e - s + p)) for p, s, e in rows if e - s + p >= max(6, 4 * p))


blocks = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=14), st.integers(1, 7)), min_size=1, max_size=6)


@settings(max_examples=200, deadline=None)
@given(blocks, st.sampled_from([16, 48]))
def test_runs_equal_brute_force(parts, piece):
    words = [w for block, times in parts for w in block * times]
    codes, want = np.array(words, np.int64), brute_runs(words)
    assert as_runs(periodic.solve(codes, 0, periodic.octaves(len(words)), 0, len(words))) == want
    found = [np.zeros((0, 3), np.int64)]
    for low, high, first, last, begin, end in periodic.pieces(len(words), piece):
        pad = begin % (1 << (high - 1))
        rows = periodic.solve(np.concatenate([-2 - np.arange(pad), codes[begin:end]]), low, high, first - begin + pad, last - begin + pad)
        rows[:, 1:] += begin - pad
        found.append(rows)
    assert as_runs(periodic._stitched(np.concatenate(found))) == want


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = brute_runs(words)
    gone = {i for s, p, n in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[2], r[0], r[1]), default=None)
    best = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    texts = "".join(f"{s},{n},{p}\n" for s, p, n in runs), " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(words), len(runs), *best, *(hashlib.sha256(t.encode()).hexdigest() for t in texts))


LOOPS = [(20, "a " * 3000), (21, "x y " * 1000 + "z"), (22, "a b c a b c a b c a b c"), (23, "a a a a a"), (24, "a a a a a a"),
         (25, "           "), (None, "n n n n n n n"), (26, ("q " * 9 + "r ") * 12), (26, "t " * 8)]


@pytest.mark.parametrize("long_chars, piece", [(4_000_000, 1 << 18), (-1, 64), (1000, 256)])
def test_scan_runs(spark, documents, long_chars, piece):
    rows = [r for r in ROWS if r[0] != 6] + LOOPS
    docs = documents(rows, **CLASH, key=1, period=2, body="b", runs=3)
    got = periodic.scan_runs(docs, long_chars, piece)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(expected(*r)) for r in rows)
    assert periodic.scan_runs(docs.filter("false"), long_chars).collect() == []
    spans = sorted((r.start, r.period, r.length) for r in periodic.run_spans(docs.filter("doc_id = 26"), long_chars, piece).collect())
    assert spans == sorted(brute_runs((rows[-2][1]).split()) + brute_runs(["t"] * 8))


def test_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    looped = {r.doc_id: r.text for r in periodic.with_loops(docs).collect()}
    for r in docs.collect():
        words, h = re.findall(r"[^\x20\x09-\x0D]+", r.text or ""), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            assert looped[r.doc_id] == " ".join(words[a + (i - a) % p] if i >= a else words[i] for i in range(len(words)))
        else:
            assert looped[r.doc_id] == r.text
    found = REGISTRY["op13_periodic_runs"](spark, sf)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(str(expected(i, t)) for i, t in looped.items())

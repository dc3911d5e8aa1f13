"""Steps that must not grow past their input: what is staged, joined and built again."""

import math
import pickle
import random

import numpy as np
import public_tokenizers
import pytest

from presswork.llm import common, lattice, line_dedup, secrets, toxicity
from presswork.plans import skew


@pytest.fixture
def written(monkeypatch):
    """Name, rows and columns of each staged table."""
    own, seen = common.staged, []

    def staged(df, name, **options):
        out = own(df, name, **options)
        seen.append((name, out.count(), out.columns))
        return out

    monkeypatch.setattr(common, "staged", staged)
    return seen


def long_lines(n=40, size=150, words=2000):
    rng = random.Random(5)
    return [" ".join(rng.sample([f"w{i}" for i in range(words)], size)) for _ in range(n)]


def test_lines_stage_no_prefix_words(spark, documents, written):
    line_dedup.dedup_lines(documents(["\n".join(long_lines())])).collect()
    assert max(rows for _, rows, _ in written) == 40


def test_long_lines_that_differ_are_no_candidates(spark, documents, written):
    line_dedup.dedup_lines(documents(long_lines())).collect()
    assert [rows for name, rows, _ in written if name in ("line-stars", "line-pairs")] == [0] * 10


def test_lines_same_in_any_number_of_passes(spark, documents, monkeypatch):
    lines = long_lines(12) + [f"a b c d e{i % 3} f g h i j{i}" for i in range(12)]
    lines += [" ".join(line.split()[:-9]) for line in lines]
    docs = documents(["\n".join(lines[i::3]) for i in range(3)])
    found = []
    for passes in (1, 4, 7):
        monkeypatch.setattr(line_dedup, "PASSES", passes)
        found.append(sorted((r.doc_id, r.text, r._n_removed) for r in line_dedup.dedup_lines(docs).collect()))
    assert found[0] == found[1] == found[2] and sum(r[2] for r in found[0]) > 12


def test_lines_of_unlike_lengths_do_not_meet(spark, documents, monkeypatch, written):
    monkeypatch.setattr(line_dedup, "_may_match", lambda x, y, percent: "true")
    line_dedup.dedup_lines(documents([" ".join(["rare", *(f"w{i}" for i in range(n))]) for n in (9, 19, 39, 79, 159)])).collect()
    assert [rows for name, rows, _ in written if name == "line-pairs"] == [0] * 5


@pytest.mark.parametrize("percent", [34, 50, 80, 100])
def test_lines_of_many_lengths_against_brute_force(spark, documents, percent):
    rng = random.Random(percent)
    lines = [rng.sample(range(40), rng.randint(1, 30)) for _ in range(60)]
    lines += [rng.sample(line + [50, 51], max(1, len(line) - rng.randint(0, 3))) for line in lines]
    texts = [" ".join(f"w{i}" for i in line) for line in lines]
    texts = [rng.choice(["", "\t", " \x0b"]) + t.replace(" ", rng.choice([" ", "\r", "\x0c \t"])) + rng.choice(["", "  "]) for t in texts]
    sets, want = [set(line) for line in lines], set()
    for i, own in enumerate(sets):
        if any(100 * len(own & other) >= percent * len(own | other) for other in sets[:i]):
            want.add(i)
    got = line_dedup.dedup_lines(documents(["\n".join(texts)]), percent).first()
    left = [t for i, t in enumerate(texts) if i not in want]
    assert got._n_removed == len(want) > 0 and got.text == "\n".join(left)


def test_keys_of_lines_are_built_once(spark, documents, monkeypatch):
    plans, own = {}, common.staged

    def staged(df, name, **options):
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        return own(df, name, **options)

    monkeypatch.setattr(common, "staged", staged)
    line_dedup.dedup_lines(documents(["a b\n\n \t\nc"])).collect()
    assert plans["lines"].count("sort_array(") == 1


def test_candidates_are_staged_without_values(spark, documents, written):
    text = "x (harbour_lantern|token=abcd1efgh92,meadow//lantern) y\n z harbour_lantern"
    found = secrets.candidates(documents([text]))
    kept = secrets._staged(found)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, found.collect())) and kept.columns == found.columns
    assert "value" not in written[-1][2]


def test_heavy_values_need_no_join_of_their_own(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"v{i % 5}" if i % 3 else None) for i in range(60)], "id long, v string")
    side = spark.createDataFrame([("hot", 1.0), ("v0", 2.0), ("v1", None)], "v string, s double")
    want = sorted(map(str, rows.join(side, "v", "left").select("id", "v", "s").collect()))
    for heavy in ([], ["hot"], ["hot", "v4"]):
        out = skew.attach_dealt(rows, side, "v", heavy, "id")
        assert sorted(map(str, out.collect())) == want
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_rows_of_a_place_are_one_block():
    pieces = lattice.Pieces.of_worker(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [" the", "é", " there", "\U000f0000", " in"]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    ends = np.cumsum([len(t) for t in texts])
    words = lattice.Words(pieces, points, ends - [len(t) for t in texts], ends)
    assert np.diff(words.off).tolist() == [sum(len(t) > place for t in texts) for place in range(6)]
    weights = {pieces.data[i].decode(): pieces.log_weight[i] for i in range(pieces.size) if np.isfinite(pieces.log_weight[i])}
    for text, rank in zip(texts, words.rank.tolist()):
        sums = [0.0]
        for t in range(1, len(text) + 1):
            ways = [math.exp(sums[t - n] + weights[text[t - n:t]]) for n in range(1, t + 1) if text[t - n:t] in weights]
            sums.append(math.log(sum(ways)) if ways else pieces.byte_weight * len(text.encode()))
        got = words.alpha[words.off[:len(text)] + rank]
        assert np.allclose(got, sums[1:]) and (words.place(words.off[:len(text)] + rank) == np.arange(len(text))).all()


def test_index_of_examples_travels_without_weights():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        places = np.sort(rng.choice(2000, rng.integers(0, 400), replace=False))
        rows.append((i, i % 2, 1.0, places, rng.integers(1, 300 if i == 7 else 9, len(places))))
    index = toxicity.build_index(rows, rng.integers(1, 500, 2000).astype(float), 1000)
    there = pickle.loads(pickle.dumps(index))
    postings = sum(len(r[3]) for r in rows)
    assert len(pickle.dumps(index)) < 5 * postings + 50_000
    found = np.zeros((300, 2000))
    found[there.examples, np.repeat(np.arange(2000), np.diff(there.starts[there.terms]))] = there.weights
    for row, (_, _, _, places, counts) in zip(found, sorted(rows, key=lambda r: (r[1], r[0]))):
        want = index.vector(places, counts.astype(float), np.zeros(0)) if len(places) else []
        assert (row[places] == want).all() and np.count_nonzero(row) == len(places)

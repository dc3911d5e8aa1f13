"""De-duplication against a plain sequential reading of the rule."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from presswork.operators import dedup

SCHEMA = "ingest_seq long, source_url string, title string, source_name string"


def sequential(batch, store=()):
    urls = {u or "" for _, u, _, _ in store}
    titles = {(t, s) for _, _, t, s in store if t and s}
    kept = []
    for seq, url, title, source in sorted(batch):
        if (url or "") in urls or (title and source and (title, source) in titles):
            continue
        kept.append(seq)
        urls.add(url or "")
        if title and source:
            titles.add((title, source))
    return kept


def accepted(spark, batch, store=None, **options):
    df = spark.createDataFrame(batch, SCHEMA)
    known = None if store is None else spark.createDataFrame(store, SCHEMA)
    return sorted(r[0] for r in dedup.accepted_keys(df, known, **options).collect())


record = st.tuples(st.sampled_from([None, "", "u1", "u2", "u3", "u4", "U1"]),
                   st.sampled_from([None, "", "t1", "t2", "t3", "T1"]), st.sampled_from(["", "s1", "s2"]))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(batch=st.lists(record, min_size=1, max_size=25), store=st.lists(record, min_size=1, max_size=4))
def test_small_batches(spark, batch, store):
    rows = [(i, *r) for i, r in enumerate(batch)]
    known = [(100 + i, *r) for i, r in enumerate(store)]
    assert accepted(spark, rows, known) == sequential(rows, known)


def test_examples(spark):
    for rows in (
        [(1, "u1", "t1", "s"), (2, "u1", "t2", "s"), (3, "u2", "t2", "s")],
        [(1, "u1", "t1", "s"), (2, "u2", "t1", "s"), (3, "u2", "t2", "s")],
        [(1, "u1", "", "s"), (2, "u2", "", "s"), (3, "u3", "t", ""), (4, "u4", "t", "")],
        [(1, "u", "1:", "a"), (2, "v", ":", "a1")],
    ):
        assert accepted(spark, rows) == sequential(rows)


@pytest.mark.parametrize("floor", [10, 10**6])
def test_one_key_holds_a_third(spark, floor):
    rnd = random.Random(7)
    rows = []
    for i in range(1500):
        url = "hot" if rnd.random() < 0.33 else f"u{rnd.randrange(400)}"
        title = "hot title" if rnd.random() < 0.33 else rnd.choice(["", f"t{rnd.randrange(500)}"])
        rows.append((i, url, title, rnd.choice(["s1", "s2", ""])))
    store = [(5000 + i, f"u{i}", f"t{i * 3}", "s1") for i in range(0, 60, 2)]
    assert accepted(spark, rows, heavy_floor=floor) == sequential(rows)
    assert accepted(spark, rows, store, heavy_floor=floor) == sequential(rows, store)
    df, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(store, SCHEMA)
    urls, titles = {r[1] for r in store}, {(r[2], r[3]) for r in store}
    want = [r[0] for r in rows if r[1] in urls or (r[2] and r[3] and (r[2], r[3]) in titles)]
    got = sorted(r[0] for r in dedup.existing_in(df, known, floor).collect())
    assert got == want


def test_long_chain(spark):
    rows = [(i, f"u{(i + 1) // 2}", f"t{i // 2}", "s") for i in range(12)]
    assert accepted(spark, rows) == sequential(rows)
    with pytest.raises(RuntimeError):
        accepted(spark, rows, max_rounds=2)


def test_chain_in_logarithmic_rounds(spark):
    n = 10_000
    rows = [(i, f"u{(i + 1) // 2}", f"t{i // 2}", "s") for i in range(n)]
    assert accepted(spark, rows, max_rounds=20) == list(range(0, n, 2)) == sequential(rows)


def test_chains_with_side_records(spark):
    """Chains that branch, end in groups, cross and carry records that have two earlier rivals."""
    rnd = random.Random(3)
    rows = []
    for c in range(6):
        length = rnd.randrange(20, 60)
        chain = [(f"u{c}-{(i + 1) // 2}", f"t{c}-{i // 2}") for i in range(length)]
        for u, t in chain:
            rows.append((u, t))
            if rnd.random() < 0.25:
                rows.append((u, f"x{rnd.randrange(40)}"))
            if rnd.random() < 0.2:
                rows.append((f"u{rnd.randrange(6)}-{rnd.randrange(20)}", t))
    rows = [(i, u, t, "s") for i, (u, t) in enumerate(rows)]
    assert accepted(spark, rows) == sequential(rows)


def test_twice_is_once_and_batches_join(spark):
    rows = [(i, f"u{i * 7 % 20}", f"t{i * 5 % 23}", "s") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    once = dedup.greedy_dedup(df)
    assert dedup.greedy_dedup(df, once).isEmpty()
    first = dedup.greedy_dedup(df.filter("ingest_seq < 30"))
    second = dedup.greedy_dedup(df.filter("ingest_seq >= 30"), first)
    both = sorted(r[0] for r in first.unionByName(second).collect())
    assert both == sorted(r[0] for r in once.collect())


@pytest.mark.parametrize("limit", [0, 4, 100])
def test_rows_are_kept_whichever_way(spark, limit):
    rows = [(i, f"u{i % 40}", f"t{i}", "s") for i in range(43)]
    kept = dedup.greedy_dedup(spark.createDataFrame(rows, SCHEMA), broadcast_rows=limit)
    assert sorted(r["ingest_seq"] for r in kept.collect()) == sequential(rows)


def test_merge_by_url(spark):
    old = [(1, "a", "x", "s"), (2, "a", "y", "s")]
    new = [(3, "b", "x", "s"), (4, "a", "q", "s"), (5, "b", "z", "s"), (6, "c", "x", "s")]
    got = dedup.merge_by_url(spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA))
    assert sorted(r[0] for r in got.collect()) == [1, 2, 3, 6]

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from presswork.operators import extract
from presswork.plans.rules import Site, Title, selector
from presswork.schema import PUBLIC_COLUMNS
from presswork.sources import files
from presswork.sources import store as store_module
from presswork.sources.pages import read_pages
from presswork.sources.seed import seed_articles
from presswork.sources.store import ArticleStore, with_ingest_seq
from presswork.streaming import ingest
from workload import queries as Q


def stored(store):
    return sorted((r["id"], r["source_url"], r["content"]) for r in store.articles().collect())


def test_create_add_clear(spark, sf, tmp_path):
    store = ArticleStore(spark, str(tmp_path / "s")).create().create()
    assert store.articles().count() == 0 and store.history().count() == 0 and store.next_batch() == 1
    batch = Q.doc_articles(spark, sf)
    assert store.add(batch.filter("ingest_seq < 100"), now=Q.now()).count() > 0
    before = stored(store)
    store.add(batch.filter("ingest_seq < 100"), batch_id=1, now=Q.now())
    assert stored(store) == before
    assert store.add(batch.filter("ingest_seq < 100"), now=Q.now()).count() == 0
    store.add(batch, now=Q.now())
    assert store.articles().count() == Q.REGISTRY["dedup_greedy"](spark, sf).count()
    assert store.articles().select("source_url").distinct().count() == store.articles().count()
    totals = {r["batch_id"]: (r["total"], r["added"]) for r in store.metrics().collect()}
    assert totals[1] == (100, len(before)) and totals[2] == (100, 0) and totals[3][0] == 200
    store.clear()
    assert store.articles().count() == 0 and store.metrics().count() == 0 and store.next_batch() == 1


def links(store):
    return sorted(r["source_url"] for r in store.articles().collect())


def batch_of(spark, rows):
    return spark.createDataFrame(rows, "ingest_seq long, source_url string, title string, source_name string")


def test_writers_that_start_together(spark, tmp_path):
    """What the first commit rejects of the second batch gives way to records that only it had kept out."""
    one = [(1, "u1", "t1", "s"), (2, "u9", "t9", "s")]
    two = [(1, "u1", "t2", "s"), (2, "u2", "t2", "s"), (3, "u2", "t3", "s"), (4, None, "", "s")]
    store = ArticleStore(spark, str(tmp_path / "s")).create()
    first, second, third = (store.begin(batch_of(spark, rows), now=Q.now()) for rows in (one, two, two))
    assert sorted(r.source_url for r in first.commit().collect()) == ["u1", "u9"]
    assert sorted(r.source_url for r in second.commit().collect()) == ["", "u2"]
    assert third.commit().collect() == []
    assert links(store) == ["", "u1", "u2", "u9"]
    batches = sorted((r.batch_id, r.total, r.added) for r in store.metrics().collect())
    assert batches == [(1, 2, 2), (2, 4, 2), (3, 4, 0)]
    rows = store.articles()
    assert rows.select("ingest_seq").distinct().count() == rows.count() == 4


def test_threads_fill_one_store(spark, sf, tmp_path):
    batch = Q.doc_articles(spark, sf)
    store = ArticleStore(spark, str(tmp_path / "s"), fan=2).create()
    with ThreadPoolExecutor(4) as pool:  # overlapping batches, each its own writer
        list(pool.map(lambda k: ArticleStore(spark, store.root, fan=2).add(
            batch.filter(F.col("ingest_seq").between(k * 30, k * 30 + 79)), writer=f"w{k}", now=Q.now()), range(4)))
    stored_urls = links(store)
    assert len(set(stored_urls)) == len(stored_urls)
    wanted = {r.source_url for r in batch.filter("ingest_seq < 170").collect()}
    assert set(stored_urls) <= wanted
    titles = [(r.title, r.source_name) for r in store.articles().collect() if r.title]
    assert len(set(titles)) == len(titles)
    # Nothing is missing: whatever is not stored has a key that is.
    have = set(titles)
    for r in batch.filter("ingest_seq < 170").collect():
        assert r.source_url in set(stored_urls) or (r.title, r.source_name) in have
    rows = store.articles()
    assert rows.select("ingest_seq").distinct().count() == rows.count()
    assert {r.writer for r in store.metrics().collect()} == {"w0", "w1", "w2", "w3"}


def read_bytes(df):
    """Bytes of the files that the scans of ``df`` chose."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text = [plan.toString()]
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        metrics = node.metrics()
        if metrics.contains("filesSize") and node.nodeName().startswith("Scan parquet"):
            total += metrics.apply("filesSize").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        if node.nodeName() == "ReusedExchange":
            todo.append(node.child())
    assert total, text
    return total


def test_a_batch_reads_the_buckets_it_hits(spark, tmp_path):
    """The index bytes of a small batch stay level while the store grows tenfold."""
    def rows(start, n):
        return spark.range(start, start + n).select(
            F.col("id").alias("ingest_seq"), F.concat(F.lit("https://x/"), "id").alias("source_url"),
            F.concat(F.lit("t"), "id").alias("title"), F.lit("s").alias("source_name"))

    store = ArticleStore(spark, str(tmp_path / "s"), keys_per_bucket=2000).create()
    seen = []
    for start, n in ((0, 20_000), (20_000, 180_000)):
        store.add(rows(start, n), now=Q.now())
        few = spark.range(3).select(F.lit("u").alias("kind"), F.unhex(F.md5(F.concat(F.lit("https://x/"), "id"))).alias("key"))
        found = store.known_keys(few, store.state()["keys"][-1:] if start else store.state()["keys"])
        seen.append(read_bytes(found))
    assert store.articles().count() == 200_000
    assert [p["buckets"] for p in store.state()["keys"]] == [32, 256]
    assert seen[1] < 2 * seen[0]
    assert store.add(rows(0, 3), now=Q.now()).count() == 0


def test_small_parts_are_merged(spark, tmp_path):
    store = ArticleStore(spark, str(tmp_path / "s"), fan=4).create()
    before = store.articles()
    for k in range(18):
        rows = [(i, f"u{k}-{i}", f"t{k}-{i}", "s") for i in range(2)] + [(9, "u0-0", "other", "s")]
        store.add(batch_of(spark, rows), now=Q.now())
        if k == 8:
            middle, urls = store.articles(), links(store)
    state = store.state()
    assert links(store) == sorted({f"u{k}-{i}" for k in range(18) for i in range(2)})
    assert all(len(state[kind]) <= 9 for kind in ("articles", "keys", "metrics"))
    assert sum(p["rows"] for p in state["articles"]) == 36
    # A reader of an older state still finds its parts; they go when they are old enough.
    assert sorted(r.source_url for r in middle.collect()) == urls and before.count() == 0
    assert store.vacuum() == 0 and store.vacuum(hours=-1) > 20
    assert len(links(store)) == 36 and store.metrics().count() == 18
    assert store.metrics().filter("added = 2 and total = 3").count() == 18


def test_lookups_skip_row_groups(spark, tmp_path):
    from presswork.operators import catalog
    store = ArticleStore(spark, str(tmp_path / "s"), fan=100).create()
    for k in range(4):
        store.add(spark.range(5000).select(
            F.col("id").alias("ingest_seq"), F.concat(F.lit(f"https://x/{k}/"), "id").alias("source_url"),
            F.concat(F.lit(f"t{k}-"), "id").alias("title"), F.lit(f"s{k}").alias("source_name")), now=Q.now())
    whole = store.articles()
    one = whole.filter("title = 't2-77'").first()["id"]
    found = catalog.article_by_id(whole, one)
    assert [r.id for r in found.collect()] == [one]
    assert scanned_rows(found) <= 5000
    assert scanned_rows(catalog.of_source(whole, "s1")) <= 5000


def scanned_rows(df):
    """Rows that came out of the scans of ``df``: those of the row groups that were not skipped."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
    return total


def test_clear_takes_side_data_along(spark, tmp_path):
    store = ArticleStore(spark, str(tmp_path / "s")).create()
    store.add(seed_articles(spark, Q.now()))
    files.write_content(store.articles(), str(tmp_path / "content"))
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "a.jpg").write_bytes(b"x")
    store.clear(str(tmp_path / "content"), str(tmp_path / "images"), str(tmp_path / "absent"))
    assert store.articles().count() == 0 and store.history().count() == 0
    assert not (tmp_path / "content").exists() and not (tmp_path / "images").exists()
    assert store.add(seed_articles(spark, Q.now())).count() == 3


def test_export_and_envelopes(spark, tmp_path):
    store = ArticleStore(spark, str(tmp_path / "s")).create()
    store.add(seed_articles(spark, Q.now()))
    files.export(store, str(tmp_path / "out"), now=Q.now())
    lines = [json.loads(line) for f in (tmp_path / "out").glob("*.json") for line in f.read_text().splitlines()]
    assert len(lines) == 3 and list(lines[0]) == PUBLIC_COLUMNS
    assert [tuple(r)[1:] for r in store.history().collect()] == [(str(tmp_path / "out"), 3)]

    files.write_envelope(store.articles(), str(tmp_path / "parts"), Q.now())
    (tmp_path / "env").mkdir()
    whole = "".join(f.read_text() for f in sorted((tmp_path / "parts").glob("part-*")))
    assert json.loads(whole)["article_count"] == 3
    (tmp_path / "env" / "a.json").write_text(whole)
    back = files.read_envelope_strict(spark, str(tmp_path / "env")).orderBy("pos").drop("pos").collect()
    assert [r.asDict() for r in back] == lines
    new = spark.createDataFrame(
        [(1, "n1", lines[0]["source_url"]), (2, "n2", "https://new"), (3, "n3", "https://new")],
        "ingest_seq long, title string, source_url string")
    files.merge_dataset(spark, str(tmp_path / "env"), new, str(tmp_path / "merged"))
    merged = [json.loads(line)["title"] for f in sorted((tmp_path / "merged").glob("*.json"))
              for line in f.read_text().splitlines()]
    assert merged == [line["title"] for line in lines] + ["n2"]
    with pytest.raises(ValueError):
        files.merge_dataset(spark, str(tmp_path / "env"), new, str(tmp_path / "env"))
    (tmp_path / "bad").mkdir()
    broken = tmp_path / "bad" / "broken.json"
    broken.write_text('{"scrape_timestamp": "x", "articles": [{"id": "a"')
    assert files.read_envelope(spark, str(tmp_path / "bad")).count() == 0
    assert files.corrupt_envelopes(spark, str(tmp_path / "bad")).count() == 1
    with pytest.raises(files.CorruptEnvelope):
        files.read_envelope_strict(spark, str(tmp_path / "bad"))
    assert broken.exists()


def test_batch_then_streams(spark, sf, tmp_path):
    """Batch jobs and two streams fill one store; nothing is lost, nothing doubled."""
    pages = read_pages(spark, f"{sf}/pages.parquet")
    store = ArticleStore(spark, str(tmp_path / "s")).create()
    first = pages.filter("page_id < 20")
    ingest.ingest_pages(store, first.unionByName(first), now=Q.now())
    for part, checkpoint in ((1, "one"), (2, "two")):
        folder = str(tmp_path / f"in{part}")
        own = pages.filter(F.col("page_id").between(part * 15, part * 15 + 19))
        own.unionByName(own).coalesce(1).write.parquet(folder)
        for _ in range(2):  # the second start finds nothing new
            running = ingest.start_ingest(
                store, ingest.page_stream(spark, folder), str(tmp_path / checkpoint), once=True, now=Q.now())
            running.awaitTermination()
    whole = ArticleStore(spark, str(tmp_path / "w")).create()
    ingest.ingest_pages(whole, pages.filter("page_id < 50"), now=Q.now())
    assert stored(store) == stored(whole)
    rows = store.articles()
    assert rows.select("ingest_seq").distinct().count() == rows.count()
    assert store.metrics().filter("total > 0").count() == 3


def test_side_contents(spark, tmp_path):
    store = ArticleStore(spark, str(tmp_path / "s")).create()
    rows = [(1, "One", "", "https://x/1", "S"), (2, "Two", "", "https://x/2", "S"), (3, "Three", "own", "https://x/3", "S")]
    batch = spark.createDataFrame(rows, "ingest_seq long, title string, content string, source_url string, source_name string")
    from presswork.functions.ids import article_id
    id_ = batch.filter("ingest_seq = 1").select(article_id(F.col("title"), F.col("source_url"))).first()[0]
    side = spark.createDataFrame([(id_, "text"), (id_, "text"), (id_, "")], "id string, content string")
    store.add(batch, now=Q.now(), content=side)
    assert sorted(r.content for r in store.articles().collect()) == ["", "own", "text"]
    files.export(store, str(tmp_path / "out"), now=Q.now())
    bodies = sorted(r.content for r in spark.read.json(str(tmp_path / "out")).collect())
    assert bodies[1:] == ["own", "text"] and "https://x/2" in bodies[0]


def test_envelopes_of_other_shape(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"articles": [{"id": "1"}, {"id": "2"}]}')
    (tmp_path / "b.json").write_text('{"articles": [{"id": "3"}]}')
    got = files.read_envelope(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.id for r in got] == ["1", "2", "3"]
    (tmp_path / "c.json").write_text('{"articles": "none"}')
    assert files.corrupt_envelopes(spark, str(tmp_path)).count() == 1
    with pytest.raises(files.CorruptEnvelope):
        files.read_envelope_strict(spark, str(tmp_path))


def test_content_files(spark, tmp_path):
    folder = tmp_path / "content"
    folder.mkdir()
    (folder / "abc.txt").write_text("two\nlines")
    got = files.read_content_files(spark, str(folder)).collect()
    assert [tuple(r) for r in got] == [("abc", "two\nlines")]
    files.write_content(spark.createDataFrame([("x", "text")], "id string, content string"), str(tmp_path / "side"))
    assert [tuple(r) for r in files.read_content(spark, str(tmp_path / "side")).collect()] == [("x", "text")]


def test_image_files(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8" + b"x" * 5000)
    (tmp_path / "b.png").write_bytes(b"no image")
    (tmp_path / "c.svg").write_bytes(b"GIF89a" + b"x" * 5000)
    got = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["ok"]) for r in files.image_report(
        files.read_images(spark, str(tmp_path))).collect()}
    assert got == {"a.jpg": ("jpeg", True), "b.png": (None, False), "c.svg": ("gif", False)}


def test_stream_equals_batch(spark, sf, tmp_path):
    pages = read_pages(spark, f"{sf}/pages.parquet")
    ArticleStore(spark, str(tmp_path / "batch")).create()
    batch = ArticleStore(spark, str(tmp_path / "batch"))
    ingest.ingest_pages(batch, pages, now=Q.now())
    for part in range(3):
        overlap = F.col("page_id").between(part * 17, part * 17 + 16) | (F.col("page_id") < 5)
        pages.filter(overlap).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = ArticleStore(spark, str(tmp_path / "stream"))
    running = ingest.start_ingest(store, ingest.page_stream(spark, str(tmp_path / "in"), 1),
                                  str(tmp_path / "state"), once=True, now=Q.now(), export_to=str(tmp_path / "out"))
    running.awaitTermination()
    exported = {r["filename"].rsplit("/", 1)[1]: r["article_count"] for r in store.history().collect()}
    assert set(exported) == {"batch-1", "batch-2", "batch-3"}
    assert exported["batch-3"] == store.articles().count()
    assert {r["source_url"] for r in store.articles().collect()} == {r["source_url"] for r in batch.articles().collect()}
    rows = store.metrics().filter("total > 0").collect()
    assert len(rows) == 3 and sum(r["added"] for r in rows) == batch.articles().count()
    assert sum(r["total"] for r in rows) == 50 + 10


def test_new_site_is_data(spark):
    site = Site(name="Mine", base="https://mine.example", titles=(Title("text", ("h3.head",)),),
                containers=("div#body",), one_container=True, min_paragraphs=0, gated=False, names_itself=False)
    page = "<h3 class='x head'>My &amp; title</h3><div id='body'><p>One<p>Two</div><p>no"
    pages = spark.createDataFrame([(1, "https://mine.example/a", page), (2, "https://mine.example/b", None)],
                                  "page_id long, url string, html string")
    row = extract.articles(pages, [site]).first()
    assert (row["title"], row["content"], row["source_name"]) == ("My & title", "One Two", "Mine")
    assert [tuple(r) for r in extract.rejects(pages, [site]).collect()] == [(2, "no page")]
    with pytest.raises(ValueError):
        selector("a > b")


def test_pandas_rule(spark):
    def rule(batches):
        for b in batches:
            yield b.assign(n=b["html"].str.len())[["page_id", "n"]]
    pages = spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string")
    assert [tuple(r) for r in extract.extract_with(pages, rule, "page_id long, n long").collect()] == [(1, 3)]


def test_ingest_seq(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "k string")
    got = with_ingest_seq(df, "k", start=10).orderBy("ingest_seq").collect()
    assert [r["k"] for r in got] == ["a", "b", "c"] and got[0]["ingest_seq"] >= 10


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    """Few long articles take as many files as their texts need, in order, when added and when merged."""
    monkeypatch.setattr(store_module, "FILE_BYTES", 50_000, raising=False)
    rows = [(i, f"u{i}", f"t{i}", "ab"[i % 2], None if i == 7 else str(i) * 5_000) for i in range(40)]
    batch = spark.createDataFrame(rows, "ingest_seq long, source_url string, title string, source_name string, content string")
    store = ArticleStore(spark, str(tmp_path / "s"), fan=2).create()

    def files():
        found = store.articles().groupBy(F.col("_metadata.file_path")).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("bytes"))
        return found.select("n", "bytes").collect()

    assert store.add(batch.filter("ingest_seq < 20"), now=Q.now()).count() == 20
    first = files()
    assert len(first) >= 3 and max(r["bytes"] for r in first) < 100_000
    assert store.add(batch.filter("ingest_seq >= 10"), now=Q.now()).count() == 20
    assert len(store.state()["articles"]) == 1
    merged = files()
    assert len(merged) >= 6 and max(r["bytes"] for r in merged) < 100_000 and sum(r["n"] for r in merged) == 40
    assert sorted((r["source_url"], r["content"]) for r in store.articles().collect()) == sorted((u, c or "") for _, u, _, _, c in rows)


def test_no_task_reads_a_whole_batch(spark, tmp_path, monkeypatch):
    """A batch that makes one file is read in as many tasks as before."""
    plans = []
    plain = DataFrameWriter.parquet

    def noted(writer, path, *args, **kwargs):
        plans.append((path, writer._df._jdf.queryExecution().optimizedPlan().toString()))
        return plain(writer, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    store = ArticleStore(spark, str(tmp_path / "s")).create()
    store.add(batch_of(spark, [(1, "u1", "t1", "s"), (2, "u2", "t2", "s")]), now=Q.now())
    wide = [plan for path, plan in plans if "/articles/" in path or "/keys/" in path]
    # ``Repartition 1, false`` is a coalesce: one task reads all that is below it.
    assert len(wide) == 2 and not any("Repartition 1, false" in plan for plan in wide)
    assert links(store) == ["u1", "u2"]

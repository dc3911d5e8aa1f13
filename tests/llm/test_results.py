"""Each operator against brute force, an exact round trip or planted cases on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from check_oracles import canonical
from presswork.llm import ann, html_region, lattice, line_dedup, minhash, mixing, secrets, tokenfile, toxicity, winnow
from presswork.llm.queries import REGISTRY, SQL, held_out, table

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents").collect()


# -- near-duplicates ----------------------------------------------------------------

def brute_components(rows):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[j:j + 5]) for j in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def planted_texts(seed=5):
    """Copies, near copies on both sides of the threshold, chains, and a passage that many share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([3, 5, 30, 120]))
        texts += [" ".join(base)] * 2
        for changes in (1, 2, 4, 9):
            other = list(base)
            for at in rng.sample(range(len(other)), min(changes, len(other))):
                other[at] = rng.choice(words)
            texts.append(" ".join(other))
            base = other if rng.random() < 0.5 else base
    texts += [passage + " " + " ".join(rng.choices(words, k=rng.choice([5, 15, 40]))) for _ in range(40)]
    rng.shuffle(texts)
    return texts


def test_minhash(spark, docs, documents):
    for rows in ([(r.doc_id, r.text) for r in docs], list(enumerate(planted_texts()))):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents(rows)).collect()}
        assert got == brute_components(rows)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2 ** 64, 3000, dtype=np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[500:2500])
    same = np.mean(minhash.signature(a, 512) == minhash.signature(b, 512))
    assert abs(same - 1500 / 2500) < 0.08


# -- lines and mixing against SQL -----------------------------------------------------

@pytest.fixture(scope="module")
def duck(sf):
    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, duck, name):
    df = REGISTRY[name](spark, sf)
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert canonical(df.collect(), df.columns) == canonical(result.fetchall(), columns)


def test_lines_planted(spark, documents):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(1, 4)):
            line = rng.choices(words, k=rng.choice([1, 3, 6, 12]))
            lines.append(" ".join(line))
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = rng.choice(words)
                lines.append(" ".join(line).upper())
        texts.append("\n".join(lines))
    texts += texts[:10]
    seen, want = [], {}
    for i, text in enumerate(texts):
        kept = []
        for line in text.split("\n"):
            own = set(line.lower().split())
            if not any(100 * len(own & s) >= line_dedup.PERCENT * len(own | s) for s in seen):
                kept.append(line)
            seen.append(own)
        want[i] = "\n".join(kept)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(texts)).collect()}
    assert got == want
    left = {r.doc_id for r in line_dedup.drop_repeats(documents(texts)).collect()}
    assert left == {i for i, t in want.items() if t}


def test_raking_in_place_and_by_joins(spark):
    rows = [(f"s{i % 7}", "en" if i % 3 else "de", "note" if i % 2 else "book", 10 + i * i) for i in range(40)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long").groupBy(
        *mixing.DIMENSIONS).agg(F.sum("tokens").alias("tokens")).checkpoint()
    one = {tuple(r[:3]): r.mass for r in mixing.rake(cells).collect()}
    two = {tuple(r[:3]): r.mass for r in mixing.rake(cells, in_place=0).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)
    assert abs(sum(m for k, m in one.items() if k[2] == "note") - 0.1 / 0.35) < 1e-9
    chances = mixing.keep_probabilities(mixing.rake(cells), 0.5).collect()
    tokens = {tuple(r[:3]): r.tokens for r in cells.collect()}
    expected = sum(tokens[tuple(r[:3])] * r.keep for r in chances)
    assert abs(expected - 0.5 * sum(tokens.values())) < 1e-6 * expected


# -- token files ------------------------------------------------------------------------

@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2 ** min(bits, 32), 1001).astype("<u4")
    assert (tokenfile.unpack(tokenfile.pack(ids, bits), len(ids), bits) == ids).all()


def test_word_encoder_is_exact():
    plain, words = Tokenizer.from_file(BPE), tokenfile.WordEncoder(BPE)
    texts = ["", " ", "  a  b\n c ", "don't we'll", "x 　 z", "a \nb\nc.\n\nd, e,f.", "<|endoftext|> x", "日本 語",
             "a\x1c b \x85c", "x " * 50, "foo. foo foo, Foo.\nfoo", "\n", "é.", "1. 2,"]
    for _ in range(2):
        for text, ids in zip(texts, words.encode(texts)):
            assert plain.encode(text, add_special_tokens=False).ids == ids.tolist(), text


def test_token_files(spark, docs, documents, tmp_path):
    manifest = tokenfile.write_tokens(documents([(r.doc_id, r.text) for r in docs]), BPE, str(tmp_path / "t"), block=64)
    got = {r.doc_id: tuple(r)[1:] for r in tokenfile.read_digest(manifest).collect()}
    plain, start = Tokenizer.from_file(BPE), 0
    for r in sorted(docs, key=lambda r: r.doc_id):
        ids = np.array([*plain.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        assert got[r.doc_id] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    file = tokenfile.TokenFile(manifest.first().file)
    whole = file.ids(0, file.n_ids)
    assert (file.ids(100, 333) == whole[100:333]).all()
    assert (file.document(3) == whole[file.starts[3]:file.starts[4]]).all()


# -- fingerprints ------------------------------------------------------------------------

def test_winnowing_by_definition():
    k, w = 5, 7
    rng = random.Random(3)
    for n in (0, 1, 4, 5, 6, 11, 12, 60, 300):
        text = "".join(rng.choice("ab é\U0001f600") for _ in range(n))
        hashes = [int(winnow.fingerprints([text[i:i + k]], k, w)[0].hashes[0]) for i in range(max(1, n - k + 1))] if n else []
        want = []
        for i in range(max(1, len(hashes) - w + 1) if hashes else 0):
            window = hashes[i:i + w]
            at = i + max(j for j, h in enumerate(window) if h == min(window))
            if not want or want[-1][1] != at:
                want.append((hashes[at], at))
        got = winnow.fingerprints(["x" * 9, text, "y"], k, w)[1]
        assert list(zip(got.hashes.tolist(), got.places.tolist())) == want
        assert winnow.parse(got.text()).places.tolist() == got.places.tolist()
    shared = "".join(rng.choice("abcdefgh") for _ in range(k + w - 1))
    a, b = winnow.fingerprints(["left" + shared, shared + "right side"], k, w)
    assert set(a.hashes.tolist()) & set(b.hashes.tolist())


def test_edited_texts(spark, docs, documents):
    got = {r.doc_id: r for r in winnow.document_fingerprints(documents([(r.doc_id, r.text) for r in docs])).collect()}
    order = sorted(docs, key=lambda r: -r.doc_id)
    for r, following in zip(order, order[1:] + order[:1]):
        m = len(r.text) // 3
        edited = r.text[:len(r.text) - m] + following.text[:m]
        assert got[r.doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    long = [r for r in got.values() if r.n_chars > 100]
    assert all(r.near_edited > r.near_next for r in long)


# -- segmentations ------------------------------------------------------------------------

def all_segmentations(p, text):
    vocabulary = {d.decode(): i for i, d in enumerate(p.data) if d and i not in set(p.byte_ids.tolist())}
    text, out = " " + text, {}

    def go(at, ids, weight):
        if at == len(text):
            out[tuple(ids)] = weight
            return
        for n in range(1, p.longest + 1):
            i = vocabulary.get(text[at:at + n]) if at + n <= len(text) else None
            if i is not None:
                go(at + n, [*ids, i], weight + p.log_weight[i])
        if text[at] not in vocabulary:
            data = text[at].encode()
            go(at + 1, [*ids, *p.byte_ids[list(data)].tolist()], weight + p.byte_weight * len(data))

    go(0, [], 0.0)
    total = np.logaddexp.reduce(list(out.values()))
    return {ids: w - total for ids, w in out.items()}


@pytest.mark.parametrize("text", ["the cat", "ab", "über\nx  y", "日本é \U0001f600 ▁z"])
def test_samples_against_enumeration(text):
    p, n = lattice.Pieces.of_worker(PIECES), 3000
    ways = all_segmentations(p, text)
    found = lattice.sample_texts(p, [text] * n, list(range(n)), 3)
    for own in found:
        assert len({tuple(s[0].tolist()) for s in own}) == len(own) == min(3, len(ways))
        assert [s[2] for s in own] == sorted((s[2] for s in own), reverse=True)
        for ids, log_p, _, inclusion in own:
            assert abs(ways[tuple(ids.tolist())] - log_p) < 1e-9 and 0 < inclusion <= 1
            assert p.decode(ids) == text
    first = Counter(tuple(own[0][0].tolist()) for own in found)
    pairs = Counter(tuple(tuple(s[0].tolist()) for s in own[:2]) for own in found)
    best = sorted(ways, key=ways.get, reverse=True)
    assert abs(first[best[0]] / n - np.exp(ways[best[0]])) < 0.04
    if len(best) > 1:
        x, y = np.exp(ways[best[0]]), np.exp(ways[best[1]])
        assert abs(pairs[best[0], best[1]] / n - x * y / (1 - x)) < 0.04
    mean = np.mean([sum(np.exp(s[1]) / s[3] for s in own) for own in found])
    assert abs(mean - 1) < 0.05


def test_decoding(spark, docs, documents):
    rows = documents([(r.doc_id, r.text) for r in docs])
    back = lattice.decode_segmentations(lattice.sample_segmentations(rows, PIECES), PIECES)
    assert back.join(rows.select("doc_id", F.col("text").alias("t")), "doc_id").filter("not (text <=> t)").count() == 0


# -- toxicity, pages, secrets, vectors ------------------------------------------------------

def test_block_max_search_is_exact():
    rng = np.random.default_rng(4)
    rows = []
    for i in range(700):
        places = np.sort(rng.choice(50, rng.integers(0, 6), replace=False))
        rows.append((i, int(rng.random() < 0.3), 1.0, places.tolist(), rng.integers(1, 4, len(places)).tolist()))
    rows.sort(key=lambda r: (r[1], r[0]))  # as the index has them
    index = toxicity.build_index(rows, rng.integers(1, 300, 50).astype(float), 1000)
    dense = np.zeros((len(rows), 50))
    for i, (_, _, _, places, counts) in enumerate(rows):
        if places:
            dense[i, places] = index.vector(np.array(places), np.array(counts, float), np.zeros(0))
    for few in (512, 7, 0):
        toxicity.DENSE, index.__dict__["dense"] = few, None
        del index.__dict__["dense"]
        queries = []
        for _ in range(100):
            places = np.sort(rng.choice(50, 4, replace=False))
            queries.append((places, index.vector(places, rng.integers(1, 4, 4).astype(float), np.array([2.0]))))
        for (places, query), (at, cosine) in zip(queries, index.nearest(queries, 15)):
            want = dense[:, places] @ query
            order = np.lexsort((np.arange(len(rows)), -np.round(want, 12)))[:15]
            assert np.allclose(cosine, want[order]) and (at == order).all()
    toxicity.DENSE = 512


def test_toxic_documents_are_found(spark, documents):
    rng = random.Random(6)
    bad = ["fooltastic", "nastyword", "grimcurse"]
    rows = []
    for i in range(600):
        words = [f"word{rng.randrange(300)}" for _ in range(40)]
        if i % 5 == 0:
            words[rng.randrange(40)] = rng.choice(bad) + rng.choice(["", "s", "ed"])
            words[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(documents(rows), labels, ~held_out()).withColumn("h", held_out()).filter("h").collect()
    assert len(got) > 60 and all((r.score >= 0.5) == (r.doc_id % 5 == 0) for r in got)
    left = {r.doc_id for r in toxicity.drop_toxic(documents(rows), labels).collect()}
    assert left == {i for i in range(600) if i % 5}


def test_copies_of_toxic_examples_are_found(spark, documents):
    """Whole and near copies of labelled toxic texts that no other example shares a rare word with; scores by brute force."""
    rng = random.Random(9)
    text = lambda i: [f"word{rng.randrange(400)}" for _ in range(40)] + [f"rare{i}a", f"rare{i}b"]
    texts = {i: text(i) for i in range(300)}
    rows = [(i, " ".join(t)) for i, t in texts.items()]
    rows += [(1000 + i, " ".join(texts[i])) for i in range(0, 300, 10)]
    rows += [(2000 + i, " ".join(texts[i][:18] + ["other"] + texts[i][19:])) for i in range(0, 300, 10)]
    rows += [(3000 + i, " ".join(text(3000 + i))) for i in range(50)] + [(4000, ""), (4001, None)]
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(documents(rows), labels).collect()}
    assert all(got[n + i].score >= 0.5 and got[n + i].evidence[0].doc_id == i for n in (0, 1000, 2000) for i in range(0, 300, 10))
    assert all(got[i].score < 0.5 for i in got if i >= 3000 or i < 300 and i % 10)

    # The whole query in plain Python: vectors over all words, every example compared.
    split = {i: Counter((t or "").split()) for i, t in rows}
    df = Counter(w for c in split.values() for w in c)
    words = {w for i in range(300) for w in texts[i]}
    idf = {w: math.log((1 + len(rows)) / (1 + (df[w] if w in words else 1))) + 1 for w in df}
    vector = {i: {w: (1 + math.log(n)) * idf[w] for w, n in c.items()} for i, c in split.items()}
    size = {i: math.sqrt(sum(x * x for x in v.values())) or 1.0 for i, v in vector.items()}
    for i in rng.sample(list(split), 60):
        cosine = {j: sum(x * vector[j].get(w, 0) for w, x in vector[i].items()) / size[i] / size[j] for j in range(300)}
        best = sorted((-round(c, 9), j % 10 == 0, j) for j, c in cosine.items() if c > 0)[:15]
        if not best:
            continue
        # Each class is whole among the examples, so every weight is 1.
        best = [(-c, int(toxic)) for c, toxic, _ in best]
        votes = [(min(c, 1.0) ** 2 / (1 - min(c, 1.0) ** 2 + toxicity.NEAR), t) for c, t in best]
        want = (sum(v * t for v, t in votes) + 0.1) / (sum(v for v, _ in votes) + 1)
        assert abs(got[i].score - want) < 1e-4


def test_page_regions(spark):
    page = """<html><body><div class="site-header"><a href=/>Home</a></div><main><h2>Title here now</h2>
    <p>if a < b &amp; c para one with <a href=x>linked words</a> more.</p><pre>x   y
    z</pre><div class="related-links"><ul><li><a>one two</a></li></ul></div><p>Second para here goes.</p>
    <section id="comments"><p>Nice post by me and all the others here</p></section></main>
    <div class="cookie-notice">We use cookies to improve everything about you here</div>
    <form>Your name <input name=a> email</form><footer>foot &copy; words</footer></body></html>"""
    pages = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    text = html_region.main_texts(pages).first().text
    assert text == "Title here now\nif a < b & c para one with linked words more.\nx y z\nSecond para here goes."


@pytest.mark.parametrize("before, after", [
    ('<div class="content with-sidebar">', "</div>"), ('<div id="wrap-no-header">', "</div>"),
    ('<div class="row ad-free"><article>', "</article></div>"), ('<section class="share tags">', "</section>"),
    ('<article><div class="content with-sidebar">', "</div></article>")])
def test_marked_wrappers_keep_the_article(before, after):
    words = "one two three four five six seven eight nine ten "
    page = (f"<html><body><nav>{'menu ' * 40}</nav>" if before.startswith("<article") else "<html><body>") + (
        f'{before}<div class="post-header"><h1>The title</h1></div><p>{words * 3}</p>'
        f'<div class="related-links">see also this</div><p>{words * 2}</p>{after}<div class="ad">Buy now</div></body></html>')
    text = html_region.extract(page, html_region.DEFAULTS)
    assert text == "\n".join(["The title", (words * 3).strip(), (words * 2).strip()])


def test_best_region_is_maximal():
    rng = random.Random(8)
    weights = {"word": 1.0, "linked": 0.2, "p": -1.5, "a": -2.0}
    for _ in range(200):
        rows = [("text", "", "w " * rng.randint(0, 4), rng.random() < 0.3) if rng.random() < 0.5
                else ("open", rng.choice(["p", "a", "b"]), "", False) for _ in range(12)]
        score = [len(t.split()) * weights["linked" if linked else "word"] if kind == "text" else
                 weights.get(name, html_region.OTHER_TAG) for kind, name, t, linked in rows]
        best = max([0.0, *(sum(score[i:j]) for i in range(12) for j in range(i + 1, 13))])
        first, last = html_region.best_region(rows, weights)
        assert abs(sum(score[first:last]) - best) < 1e-9


def test_secrets_planted(spark, documents):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9)))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows, want = [], set()
    for i in range(400):
        words = [word() for _ in range(30)]
        kind = i % 4
        if kind == 0:
            words[10:10] = ["token", "=", f'"{hexa(40)}"']
            want.add((i, 12))
        elif kind == 1:
            words[5] = f"password={hexa(18)}"
            want.add((i, 5))
        elif kind == 2:
            words[7] = str(rng.randrange(10 ** 15, 10 ** 16))
        else:
            words[8] = f"{word()}.{rng.randrange(100)}@mail{rng.randrange(9)}.example.com"
        rows.append((i, " ".join(words)))
    got = secrets.scan_secrets(documents(rows), learn_from=~held_out()).filter("is_secret").collect()
    assert {(r.doc_id, r.place) for r in got} == want


def test_secrets_inside_words(spark, documents):
    rng = random.Random(10)
    signs = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    ghp = lambda: "ghp_" + "".join(rng.choice(signs) for _ in range(36))
    plain = lambda: "ghp_" + "".join(rng.choice(signs[:52]) for _ in range(36))
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 12)))
    shapes = ['{{"token":"{0}","user":"bob"}}', "https://{0}@host/repo.git", "x.example/?key={0}&v=1", "{0}</td>", "a;{0};{1};b", "{1}"]
    rows, want = [], set()
    for i in range(400):
        words = [word() for _ in range(30)]
        if i % 2 == 0:
            shape, values = shapes[i // 2 % len(shapes)], (ghp(), plain())
            words[7] = shape.format(*values)
            want |= {(i, 7, words[7].index(v), v) for v in values if v in words[7]}
        rows.append((i, " ".join(words)))
    got = secrets.scan_secrets(documents(rows), learn_from=~held_out()).filter("is_secret").collect()
    assert {(r.doc_id, r.place, r["at"], r.value) for r in got} == want


def test_secret_pairs_that_are_very_rare(spark, documents):
    docs = documents(["qzqzqzqzqz and harbour_lantern"])
    words = spark.createDataFrame([("harbour", 10**10), ("qz", 1)], "run string, n long")
    rows = {r["value"]: r["pairs"] for r in secrets.featured(secrets.candidates(docs), words).collect()}
    assert rows["qzqzqzqzqz"] is not None and rows["qzqzqzqzqz"] < rows["harbour_lantern"]


def test_secret_statistics_cover_all_texts(spark, documents):
    docs = documents(["harbour lantern meadow one two", "harbour two one lantern", "x harbour_lantern_meadow y"])
    words = secrets.word_counts(docs)
    assert {r.run: r.n for r in words.collect()} == {
        "harbour": 3, "lantern": 3, "meadow": 2, "one": 2, "two": 2, "x": 1, "y": 1}
    rows = secrets.featured(secrets.candidates(docs), words).filter("value = 'harbour_lantern_meadow'").collect()
    assert len(rows) == 1 and abs(rows[0].known - 20 / 22) < 1e-9
    counts = Counter()
    for r in words.collect():
        for i in range(len(r.run) - 1):
            counts[r.run[i:i + 2]] += r.n
    letters = "harbourlanternmeadow"
    logs = [np.log(counts[p] / counts.total() if counts[p] else 1e-6) for p in map("".join, zip(letters, letters[1:]))]
    assert abs(rows[0].pairs - np.mean(logs)) < 1e-5


def test_nearest_vectors(spark):
    rng = np.random.default_rng(11)
    m = rng.standard_normal((3000, 16)).astype("f4") * rng.uniform(0.8, 1.25, (3000, 1)).astype("f4")
    m[100:400] = m[100]
    vectors = spark.createDataFrame([(i, m[i].tolist()) for i in range(len(m))], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(vectors, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    wide, hits = m.astype("f8"), 0
    assert set(got) == set(range(0, 3000, 20))
    for q, own in got.items():
        scores = wide @ wide[q]
        scores[q] = -np.inf
        want = np.lexsort((np.arange(len(m)), -scores))[:20].tolist()
        hits += len(set(want) & {v for v, _ in own.values()})
        assert sorted(own) == list(range(1, 21)) and all(abs(scores[v] - s) < 1e-9 for v, s in own.values())
        ranked = [own[i] for i in range(1, 21)]
        assert ranked == sorted(ranked, key=lambda x: (-x[1], x[0]))
    assert hits / (20 * len(got)) > 0.9


def test_graph_of_small_leaves_converges(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 64)
    monkeypatch.setattr(ann, "SAMPLE", 32)
    monkeypatch.setattr(ann, "TREES", 2)
    rng = np.random.default_rng(12)
    m = rng.standard_normal((4000, 12)).astype("f4")
    m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
    m[:300] = m[0]  # one direction, as after rounding: ties are split as well
    unit = np.hstack([m, np.zeros((len(m), 1), "f4")]).astype("<f2")
    units = spark.createDataFrame([(i, bytearray(u.tobytes())) for i, u in enumerate(unit)], "node long, unit binary")
    planted = units.selectExpr("0 as tree", "3L as leaf", "node", "unit")
    leaves = {}
    for r in ann._small_leaves(planted, 13).select("leaf", "node").collect():
        leaves.setdefault(r.leaf, []).append(r.node)
    assert sorted(n for own in leaves.values() for n in own) == list(range(4000))
    assert max(map(len, leaves.values())) <= 64
    found = {r.node: list(r.near) for r in ann.neighbour_graph(units, 4000, 13).collect()}
    wide, hits = unit.astype("f8"), 0
    for i in range(300, 4000, 10):
        scores = wide @ wide[i]
        scores[i] = -np.inf
        hits += len(set(np.argsort(-scores)[:20].tolist()) & set(found[i]))
    assert hits / (20 * 370) > 0.9


# -- pipeline ---------------------------------------------------------------------------------

def test_pipeline(spark, sf):
    docs = table(spark, sf, "documents").checkpoint()
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf).checkpoint()
        if name != "sentencepiece":
            assert docs.columns == columns
            assert docs.select("doc_id").join(before, "doc_id", "left_anti").count() == 0
            kept.append(docs.count())
        if name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert {r.doc_id for r in docs.collect()} == {i for i, (_, c) in brute_components(rows).items() if i == c}
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0
    back = lattice.decode_segmentations(docs, PIECES)
    assert back.join(before.select("doc_id", F.col("text").alias("t")), "doc_id").filter("not (text <=> t)").count() == 0
    assert corpus_pipeline.run(spark, sf).count() == docs.count()

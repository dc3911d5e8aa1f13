"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for all operators."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from presswork.llm import ann, html_region, lattice, line_dedup, minhash, mixing, secrets, tokenfile, toxicity, winnow

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"word{i % 977} und{i % 31}" for i in range(30_000))
ROWS = [
    (1, "one two three four five six seven"), (2, None), (3, ""), (4, " \n\t "), (5, "x" * 5000), (6, LONG),
    (7, "one two three four five six seven"), (7, "one two three four five six seven"), (None, "no id here at all today"),
    (None, None), (8, "line a b c\nline a b c\nother"), (9, "\U0001f600 ▁ é\u0000 日本")]
# Names that the operators use inside.
CLASH = dict(score=1, kept=False, component_id=5, node=1, places=2, w=3, sid=4, _n_lines=5, topic="t", mass=1.0, ids="i")


def labels(spark, rows=((1, 0), (2, 1), (7, None), (8, 1), (9, 0), (None, 1))):
    return spark.createDataFrame([(i, 1, t) for i, t in rows], "doc_id long, quality int, toxic int")


OPERATORS = {
    "toxicity": lambda s, d: toxicity.toxicity(d, labels(s)),
    "drop_toxic": lambda s, d: toxicity.drop_toxic(d, labels(s)),
    "lines": lambda s, d: line_dedup.dedup_lines(d),
    "drop_repeats": lambda s, d: line_dedup.drop_repeats(d),
    "mix": lambda s, d: mixing.mix(d),
    "sample_mix": lambda s, d: mixing.sample_mix(d),
    "minhash": lambda s, d: minhash.near_duplicates(d),
    "drop_near": lambda s, d: minhash.drop_near_duplicates(d),
    "tokens": lambda s, d: tokenfile.read_digest(tokenfile.write_tokens(d, BPE)),
    "winnow": lambda s, d: winnow.document_fingerprints(d),
    "pieces": lambda s, d: lattice.sample_segmentations(d, PIECES),
    "secrets": lambda s, d: secrets.scan_secrets(d),
}
ONE_EACH = {"toxicity", "lines", "mix", "minhash", "tokens", "winnow"}
FILTERS = {"drop_toxic", "drop_repeats", "sample_mix", "drop_near"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, documents, name):
    docs = documents(ROWS, **CLASH)
    out = OPERATORS[name](spark, docs)
    rows = out.collect()
    if name in ONE_EACH:
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in ROWS)
    if name in FILTERS:
        assert out.columns == docs.columns
        assert len(rows) <= len(ROWS)
    plain = OPERATORS[name](spark, documents(ROWS)).collect()
    assert len(plain) == len(rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, documents, name):
    assert OPERATORS[name](spark, documents([(1, "a")]).filter("false")).collect() == []


def test_toxicity_without_labels(spark, documents):
    rows = toxicity.toxicity(documents(ROWS), labels(spark, ()).filter("false")).collect()
    assert {r.score for r in rows} == {0.0} and len(rows) == len(ROWS)


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "plain words"), (3, "w", "<p>a" * 20_000), (3, "w", "<p>a" * 20_000),
            (4, "x", "<<<>>> &amp; <"), (5, "y", "<!-- open"), (6, "z", "<div><p>unclosed <b>bold")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = html_region.main_texts(pages.selectExpr("*", "'t' as text", "1 as n_chars")).collect()
    assert len(out) == len(rows)
    got = {r.page_id: r.text for r in out}
    assert got[1] == "" and got[2] == "" and got[None] == "plain words" and got[6] == "unclosed bold"
    assert got[3].count("\n") == 19_999
    assert html_region.main_texts(pages.filter("false")).collect() == []


def test_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (8, [1.0]), (20, [0.0, 2.0]), (21, [0.5, 0.5]), (None, [1.0, 1.0]), (21, [0.5, 0.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as node", "2 as score")
    out = ann.nearest(vectors, F.col("vec_id") % 20 == 0)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {0: [(1, 1.0), (2, 1.0), (21, 0.5), (20, 0.0)], 20: [(21, 1.0), (0, 0.0), (1, 0.0), (2, 0.0)]}
    assert ann.nearest(vectors.filter("false"), F.col("vec_id") > 0).collect() == []


def test_words_reach_the_tokenizer_together():
    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer, self.given = tokenizer, 0

        def encode_batch_fast(self, texts, **how):
            self.given += len(texts)
            return self.tokenizer.encode_batch_fast(texts, **how)

    encoder = tokenfile.WordEncoder(BPE)
    whole = encoder.tokenizer
    encoder.tokenizer = counting = Counting(whole)
    texts = [" ".join(f"w{i}x{j}" for j in range(50)) + f".\nrow{i}, it's" for i in range(40)]
    texts += ["", " ", " a", "a ", "a  b", "a\tb c\n d", "x\n\ny z", "\n", "\na b\n", "a\xa0b 　c", "᠎a b᠎ c",
              "é 日本 語\n次", "Ġ ĠĠa Ċ", "a <|endoftext|> b<|endoftext|>c d", "a\x1cb \x85c d", "w, v. x,y z.\nq, r."]
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode(texts)):
            assert np.array_equal(ids, whole.encode(text, add_special_tokens=False).ids), text
    assert counting.given < 100


def test_terms_are_found_without_remembering_tokens():
    def sizes(vectors):
        return {name: len(value) for name, value in vars(vectors).items() if hasattr(value, "__len__")}

    vectors = toxicity.Vectors(["^abcd", "^abcde", "a", "abc", "it's", "x-y", "σ"])
    before = sizes(vectors)
    texts = [f"w{i} (a) abc. --x-y-- .... ABCDEF, abcde it's «Σ» a\x85b　abc" for i in range(300)]
    for text in ["", " ", "...", "-" * 300_000 + "a", *texts]:
        found = [t for token in text.lower().split() for t in toxicity.terms_of(token)]
        own = {vectors.places[t]: found.count(t) for t in set(found) if t in vectors.places}
        others = sorted(found.count(t) for t in set(found) if t not in vectors.places and t[0] != "^")
        got, rest = vectors.counts(text)
        assert (got, sorted(rest)) == (own, others) and vectors.distinct(text) == set(own)
    assert sizes(vectors) == before


def test_staging_leaves_no_shuffle(spark):
    import time

    from presswork.llm import common as C

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().endswith(".data")}

    before = shuffled()
    rows = C.staged(spark.range(1000).repartition(4, "id"), "shuffled")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not {f for f in shuffled() - before if f.startswith("shuffle_")}
    assert rows.count() == 1000 and spark.conf.get(C._CLEANUP) == "false"


def test_findings_are_not_staged_with_their_features(spark, documents, monkeypatch):
    from presswork.llm import common as C

    staged, whole = [], C.staged
    monkeypatch.setattr(C, "staged", lambda df, name, **how: staged.append(df.columns) or whole(df, name, **how))
    rows = secrets.scan_secrets(documents([f"token=abcd{i}efgh9{i}12 and harbour_lantern{i} here" for i in range(30)]))
    assert rows.count() == 60 and not [c for c in staged if "doc_id" in c and "entropy" in c]
    word = rows.filter("doc_id = 3 and place = 0").first()
    assert word.word[word.at:word.at + len(word.value)] == word.value == "abcd3efgh9312"

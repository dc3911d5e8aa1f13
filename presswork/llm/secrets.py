"""Secret scan: candidates by shape, false positives removed by a random forest.

A candidate is a run of 8 or more token characters, anywhere in a word and with or
without digits; a word may hold several.
Its features are the length of the value, character transitions (changes of class, and
the mean log-frequency of its letter pairs in the words of the corpus), entropy, the
share of its letter runs that are words of a dictionary, the path of its document, and
the words around it. The forest is trained on labelled findings and gives each
candidate the probability of being a secret.

The dictionary and the pair table come from all words of all texts. All of it is DataFrame code and Spark ML, without Python in the tasks.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm import common as C
from presswork.plans import skew

# The forest is fitted on at most so many labelled findings, those with the least hashes.
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 24, 6, 17
# Letter pairs that the table holds; others count as unseen.
PAIRS = 1024
LEAST_WORD = 4
THRESHOLD = 0.5
HEAVY_FLOOR = 10_000  # rows of one value that are not worth spreading

# The slashes behind the scheme of a URL are no part of the run.
_VALUE = "(?:(?<=//)|(?<![A-Za-z0-9+/_~-])(?!//))[A-Za-z0-9+/_~-]{8,}=*"
_KEY = "(?i)key|secret|token|passw|pwd|auth|credential|private"
_ASIDE = "(?i)test|example|sample|dummy|mock|doc"
# Formats that issuers publish, for labels where none are given.
_ISSUED = "^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abp]-[A-Za-z0-9-]{10,}$|^sk_live_[A-Za-z0-9]{16,}$"

FEATURES = [
    "length", "digits", "upper", "lower", "marks", "changes", "entropy", "pairs", "known", "is_hex", "all_digits",
    "key_before", "key_inside", "assigned", "quoted", "path_aside", "path_like", "plain_before", "plain_after"]


def candidates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, place, path, before, word, after, value, at``, one row for each run; ``at`` is its offset in the word."""
    words = F.split("text", "\\s+")
    near = F.transform(
        F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
                 lambda x: (F.length(x["w"]) >= 8) & x["w"].rlike(_VALUE)),
        lambda x: F.struct(x["i"].alias("place"), x["w"].alias("word")))
    rows = docs.select(
        "doc_id", (F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")).alias("path"),
        words.alias("words"), near.alias("near")).filter(F.size("near") > 0)
    # The words around are taken inside each text, before its candidates become rows.
    around = F.transform("near", lambda x: F.struct(
        x["place"].alias("place"), x["word"].alias("word"),
        F.concat_ws(" ", F.slice("words", F.greatest(x["place"] - 1, F.lit(1)), F.least(x["place"], F.lit(2)))).alias("before"),
        F.coalesce(F.try_element_at("words", x["place"] + 2), F.lit("")).alias("after")))
    out = rows.select("doc_id", "path", F.explode(around).alias("c")).select("doc_id", "path", "c.*")
    # Runs stand in order and apart, so each is found behind the end of the one before.
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<value:string,at:int>>").alias("runs"))
    runs = F.aggregate(F.regexp_extract_all("word", F.lit(_VALUE), 0), start, lambda acc, v: F.struct(
        (_found(v, acc["next"]) + F.length(v)).alias("next"),
        F.concat(acc["runs"], F.array(F.struct(v.alias("value"), (_found(v, acc["next"]) - 1).alias("at")))).alias("runs")),
        lambda acc: acc["runs"])
    return out.withColumn("run", F.explode(runs)).select(*out.columns, "run.value", "run.at")


def _found(value: Column, start: Column) -> Column:
    """Place of ``value`` in the word, from 1, at or behind ``start``."""
    return F.call_function("locate", value, F.col("word"), start)


def _staged(found: DataFrame) -> DataFrame:
    """``candidates``, written without their values: these are parts of their words, and this is most of the disk."""
    kept = found.withColumn("_length", F.length("value")).drop("value")
    kept = C.staged(kept, "secret-candidates", compression="zstd")
    return kept.withColumn("value", F.expr("substring(word, at + 1, _length)")).select(*found.columns)


def _left() -> Column:
    return F.expr("substring(word, 1, at)")


def _plain(text: Column) -> Column:
    return text.rlike("^[\\p{L}]+[.,;]?$")


def _share(pattern: str) -> Column:
    return F.length(F.regexp_replace("value", pattern, "")) / F.length("value")


def _entropy() -> Column:
    signs = F.split("value", "")
    total = F.length("value")
    parts = F.transform(F.array_distinct(signs), lambda c: F.size(F.filter(signs, lambda x: x == c)) / total)
    return F.aggregate(parts, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def word_counts(docs: DataFrame) -> DataFrame:
    """``run, n``: the runs of letters in all texts, in lower case, with how often they stand there."""
    runs = docs.select(F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("run"))
    return C.staged(runs.filter(F.col("run") != "").groupBy("run").agg(F.count("*").alias("n")), "secret-words")


def _pair_table(words: DataFrame) -> Column | None:
    """Log-frequency of the letter pairs of all words, as one constant map."""
    parts = words.select(F.explode(F.split("run", "[^a-z]+")).alias("w"), "n").filter(F.length("w") >= 2)
    pairs = parts.select(
        F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring("w", i, F.lit(2)))).alias("p"), "n")
    rows = pairs.groupBy("p").agg(F.sum("n").alias("count")).orderBy(F.desc("count"), "p").limit(PAIRS).collect()
    if not rows:
        return None
    total = sum(r["count"] for r in rows)
    # The least share is that of the last place written: 0, which the rarest pairs of large tables come to, has no logarithm.
    text = ",".join(f"{r.p}:{max(r['count'] / total, 1e-8):.8f}" for r in rows)
    return F.str_to_map(F.lit(text), F.lit(","), F.lit(":"))


def _dictionary(words: DataFrame) -> DataFrame:
    return words.filter((F.length("run") >= LEAST_WORD) & (F.col("n") > 1)).select("run")


_AROUND = ["key_before", "key_inside", "assigned", "quoted", "path_aside", "path_like", "plain_before", "plain_after"]


def value_features(found: DataFrame, words: DataFrame) -> tuple[DataFrame, list[str]]:
    """The features of each value of ``found``, and the values that are heavy there, fewer than ``skew.HEAVY_KEYS``."""
    table = _pair_table(words)
    lowered = F.regexp_replace(F.lower("value"), "[^a-z]", "")
    pairs = F.transform(
        F.when(F.length(lowered) >= 2, F.sequence(F.lit(1), F.length(lowered) - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.substring(lowered, i, F.lit(2)))
    if table is None:
        mean = F.lit(-12.0)
    else:
        logs = F.transform(pairs, lambda p: F.ln(F.coalesce(F.try_element_at(table, p).cast("double"), F.lit(1e-6))))
        mean = F.when(F.size(logs) > 0, F.aggregate(logs, F.lit(0.0), lambda a, x: a + x) / F.size(logs)).otherwise(-12.0)
    signs = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        "value", "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A"), "[^0aA]", "_")

    values = C.staged(skew.key_counts(found, "value"), "secret-values")
    runs = values.select("value", F.explode(F.split(F.lower("value"), "[^\\p{L}]+")).alias("run"))
    known = runs.filter(F.length("run") >= LEAST_WORD).join(
        _dictionary(words).withColumn("hit", F.lit(1)), "run", "left").groupBy("value").agg(
        (F.sum(F.when(F.col("hit") == 1, F.length("run")).otherwise(0)) / F.first(F.length("value"))).alias("known"))
    number = lambda c: c.cast("double")
    own = C.staged(values.join(known, "value", "left").select(
        "value", F.length("value").cast("double").alias("length"), _share("[^0-9]").alias("digits"),
        _share("[^A-Z]").alias("upper"), _share("[^a-z]").alias("lower"), _share("[A-Za-z0-9]").alias("marks"),
        ((F.length(F.regexp_replace(signs, "(.)\\1+", "$1")) - 1) / F.length("value")).alias("changes"),
        _entropy().alias("entropy"), mean.alias("pairs"), F.coalesce("known", F.lit(0.0)).alias("known"),
        number(F.col("value").rlike("^[0-9a-f]+$")).alias("is_hex"),
        number(F.col("value").rlike("^[0-9]+$")).alias("all_digits")), "secret-value-features", compression="zstd")
    heavy = [r.value for r in skew.heavy_keys(values, "value", HEAVY_FLOOR).collect()]
    C.discard(values)
    return own, heavy


def _around() -> dict[str, Column]:
    """The features of the words around and of the rest of the word."""
    opening = F.expr("substring(word, at, 1)")
    return {
        "key_before": F.col("before").rlike(_KEY), "key_inside": _left().rlike(_KEY),
        "assigned": F.col("before").rlike("[=:]\\s*$") | _left().rlike("[=:][\"']?$"),
        "quoted": (F.col("at") > 0) & opening.isin("'", '"') & (opening == F.expr("substring(word, at + length(value) + 1, 1)")),
        "path_aside": F.col("path").rlike(_ASIDE),
        "path_like": F.col("word").rlike("/.*/|://|@|\\.[a-z]{2,4}$"),
        "plain_before": _plain(F.element_at(F.split("before", " "), -1)),
        "plain_after": _plain(F.col("after"))}


def with_features(found: DataFrame, own: DataFrame, heavy: list[str]) -> DataFrame:
    """``doc_id, place, at, before, word, value`` of ``found`` with a column for each of ``FEATURES``.

    Rows travel to the features of their values without the texts that these columns don't
    need: what stands around is 8 bits beside the place, and a word is what is left and right
    of its value. These and ``before`` are one text; none holds a line break.
    """
    around = _around()
    bits = sum((F.coalesce(around[c], F.lit(False)).cast("int") * (1 << i) for i, c in enumerate(_AROUND)), F.lit(0))
    right = F.expr("substring(word, at + length(value) + 1)")
    narrow = found.select(
        "doc_id", (F.shiftleft(F.col("place").cast("long"), len(_AROUND)) + bits).alias("place_bits"), "value",
        F.concat_ws("\n", _left(), right, "before").alias("rest"))
    wide = skew.attach_dealt(narrow, own, "value", heavy, "doc_id")
    left, right = F.substring_index("rest", "\n", 1), F.substring_index(F.substring_index("rest", "\n", 2), "\n", -1)
    return wide.select(
        "doc_id", F.shiftright("place_bits", len(_AROUND)).cast("int").alias("place"), F.length(left).alias("at"),
        F.substring_index("rest", "\n", -1).alias("before"), F.concat(left, "value", right).alias("word"), "value",
        *(c for c in FEATURES if c not in around),
        *(F.col("place_bits").bitwiseAND(F.lit(1 << i).cast("long")).cast("boolean").cast("double").alias(c)
          for i, c in enumerate(_AROUND)))


def featured(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with its features, by the ``word_counts`` of all texts; both are read more than once."""
    return with_features(found, *value_features(found, words))


def issued_labels(found: DataFrame) -> DataFrame:
    """``doc_id, place, at, label`` by rule: published formats, and random values given to a key name.

    For corpora without labelled findings. A value given to a key counts when it holds
    three digits.
    """
    left = F.concat_ws(" ", "before", _left())
    given = left.rlike(_KEY) & left.rlike("[=:][\\s\"']*$") & F.col("value").rlike("[0-9].*[0-9].*[0-9]")
    return found.select("doc_id", "place", "at", (F.col("value").rlike(_ISSUED) | given).cast("int").alias("label"))


def _forest(found: DataFrame, labels: DataFrame, own: DataFrame, heavy: list[str]):
    """The fitted forest, or the one label there is."""
    labels = labels.filter("label is not null").withColumn("label", F.col("label").cast("int"))
    keys = [c for c in ("doc_id", "place", "at") if c in labels.columns]
    totals = dict(labels.groupBy("label").count().collect())
    # Secrets are rare among all runs, so each label is sampled on its own and weighs what it stands for.
    picked = None
    for label, total in sorted(totals.items()):
        most = TRAIN_ROWS // len(totals)
        part = labels.filter(F.col("label") == label).orderBy(F.xxhash64(*keys), *keys).limit(most)
        part = part.withColumn("weight", F.lit(max(1.0, total / most)))
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        return 0.0
    picked = C.staged(picked, "secret-labels")
    taught = C.staged(found.join(F.broadcast(picked.select(keys).distinct()), keys, "left_semi"), "secret-findings")
    train = with_features(taught, own, heavy).join(F.broadcast(picked), keys).select(
        *FEATURES, F.col("label").cast("double").alias("label"), "weight")
    train = C.staged(train, "secret-training")
    seen = sorted(r.label for r in train.select("label").distinct().collect())
    if len(seen) < 2:
        return seen[0] if seen else 0.0
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(train)
    return RandomForestClassifier(
        labelCol="label", weightCol="weight", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED,
        cacheNodeIds=False).fit(ready)


def scan_secrets(docs: DataFrame, labels=issued_labels, learn_from: Column | None = None, path: str | None = None) -> DataFrame:
    """``doc_id, place, at, before, word, value, score, is_secret`` of all candidates in ``docs(doc_id, text)``.

    ``labels`` are labelled findings ``(doc_id, place, at, label)``, where a label without ``at`` holds
    for all runs of its word, or a function that gives
    them for the candidates; they teach where ``learn_from``, a condition on ``doc_id``,
    holds. ``place`` counts the words of the text from 0, ``at`` the characters of the word; ``path`` names a column with the
    path of the document.

    Null and empty texts have no candidates. Rows without an id are scanned but teach
    nothing; repeated rows give repeated findings. Without labels of both kinds every
    score is the one label, or 0. Other columns are not read. An empty table gives an
    empty table.
    """
    found = _staged(candidates(docs, path))
    words = word_counts(docs)
    own, heavy = value_features(found, words)
    C.discard(words)
    given = labels(found) if callable(labels) else labels
    given = given.filter("doc_id is not null")
    model = _forest(found, given if learn_from is None else given.filter(learn_from), own, heavy)
    rows = with_features(found, own, heavy)
    if isinstance(model, float):
        scored = rows.withColumn("score", F.lit(model))
    else:
        ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
        scored = model.transform(ready).withColumn("score", vector_to_array("probability")[1])
    return scored.select(
        "doc_id", "place", "at", "before", "word", "value", F.round("score", 6).alias("score"),
        (F.col("score") >= THRESHOLD).alias("is_secret"))

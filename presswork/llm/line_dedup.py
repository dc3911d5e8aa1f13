"""Remove lines that repeat earlier ones, by an exact set-similarity join.

A line is the set of its distinct lower-case words. It is removed when a line before it
(by document id, then place) has a Jaccard similarity of at least ``PERCENT`` hundredths,
whether that one was kept or not.

Words are ordered by rarity: by the class of how often words of the same hash bucket
occur in the corpus, then by hash. Two sets can only reach the threshold when they share
a word among the first ``n - ceil(n * PERCENT / 100) + 1`` of each (prefix filter), when
their sizes allow it (length filter), when enough words are left behind the shared one
(positional filter), and when their parity bitmaps differ in few enough bits; sets of
many words have four bitmaps, since one is full of chance bits there. What passes is
verified on the full sets.

Equal sets are collapsed to their first line first. Then every shared prefix word is a
star: its lines against the earliest one. A line that this removes needs no other
partner, so in a large group of variants nearly all are settled in linear work; only the
lines still open meet the other lines of their prefix words. There the longer set of a
pair asks: it meets the shorter one by a word and the class of its length, and of the
shorter one even fewer words are needed, so a frequent word brings few pairs that fail.

Prefix words are many times more rows than lines. They are worked on in ``PASSES``
parts, by the hash of the word, so only one part is shuffled and on disk at a time.

All of it is DataFrame code.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.llm import common as C

PERCENT = 80
BUCKETS = 1 << 16  # a power of two
CLASS_BITS = 6
# Candidate lines and settled sets are broadcast up to this many rows of 28 bytes;
# beyond it the other side is shuffled.
BROADCAST_LINES = 1_000_000
PASSES = 4
# Sets of so many words have four bitmaps.
LONG = 64

OTHER_SPACES = "\t\n\x0b\x0c\r"
WORDED = "[^ \\t-\\r]"


def _words(text: Column) -> Column:
    # One space is cut at without a pattern, in half the time.
    for space in OTHER_SPACES:
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(F.lower(text), " "), "")


def _classes(docs: DataFrame) -> Column:
    """For each hash bucket a class that grows with the occurrences of its words, as one constant."""
    words = docs.select(F.explode(_words(F.col("text"))).alias("w"))
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).agg(F.count("*").alias("n"))
    step = F.least(F.floor(F.log2(F.col("n").cast("double")) * 2), F.lit((1 << (CLASS_BITS - 1)) - 1))
    table = [0] * BUCKETS
    for b, c in counts.select("b", step).collect():  # at most BUCKETS rows
        table[b] = c
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")


def _keys(line: Column, classes: Column) -> Column:
    """The words of a line as sorted 64-bit keys, rare ones first."""
    low = (1 << (64 - CLASS_BITS)) - 1
    hashes = F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w)))

    def key(h: Column) -> Column:
        group = F.get(classes, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
        return F.shiftleft(group, 64 - CLASS_BITS).bitwiseOR(h.bitwiseAND(F.lit(low)))

    return F.sort_array(F.transform(hashes, key))


def _parity(keys: Column) -> Column:
    """61 bits, each the parity of the keys that fall on it; sets differ in at least as many words as bits."""
    one = F.lit(1).cast("bigint")
    return F.aggregate(keys, F.lit(0).cast("bigint"), lambda bits, k: bits.bitwiseXOR(
        F.call_function("shiftleft", one, F.pmod(k, F.lit(61)).cast("int"))))


def _quarter(keys: Column, part: int) -> Column:
    """The parity bits of one quarter of the keys of a long set; those of the last one follow from all."""
    own = F.filter(keys, lambda k: k.bitwiseAND(F.lit(3)) == part)
    return F.when(F.size(keys) >= LONG, _parity(own))


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, line`` of all texts; lines end at \\n."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _may_match(x: str, y: str, percent: int) -> str:
    """Length, positional and bitmap filters between two prefix rows."""
    need = f"ceil({percent} * ({x}.n + {y}.n) / {100 + percent})"
    apart = f"{x}.n + {y}.n - 2 * {need}"
    quarters = [f"{x}.q{i} ^ {y}.q{i}" for i in range(3)]
    quarters.append(f"{x}.bits ^ {y}.bits ^ " + " ^ ".join(quarters))
    # The first one is the bitmap filter without rounding; it is cheap and leaves few.
    return (f"bit_count({x}.bits ^ {y}.bits) * {100 + percent} <= {100 - percent} * ({x}.n + {y}.n)"
            f" and 100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n)"
            f" and least({x}.n - {x}.i, {y}.n - {y}.i) >= {need}"
            f" and bit_count({x}.bits ^ {y}.bits) <= {apart}"
            f" and coalesce({' + '.join(f'bit_count({q})' for q in quarters)} <= {apart}, true)")


def _length_class(n: str, percent: int) -> str:
    """Lengths that allow the threshold are in one class or in two adjacent ones."""
    # A little wider than the threshold asks for, lest rounding parts two lengths.
    return f"cast(floor(ln({n}) / {math.log(100 / percent) * 1.0001 + 1e-9!r}) as bigint)"


def _asking(rows: DataFrame, percent: int) -> DataFrame:
    """Prefix rows of the longer sets: one for each word and length class that a shorter set may have."""
    low = f"ceil({percent} * n / 100)"
    high = f"least(n, floor({100 + percent} * (n - i) / {percent}) - n)"
    classes = f"array_distinct(array({_length_class(low, percent)}, {_length_class(high, percent)}))"
    found = rows.filter(f"{high} >= {low}").withColumn("class", F.explode(F.expr(classes)))
    return found.withColumn("at", F.xxhash64("w", "class")).drop("w", "class")


def _asked(rows: DataFrame, percent: int) -> DataFrame:
    """Prefix rows of the shorter sets, which need the first words only that sets no longer than themselves need."""
    found = rows.filter(f"n - i >= ceil({2 * percent} * n / {100 + percent})")
    return found.withColumn("at", F.xxhash64("w", F.expr(_length_class("n", percent)))).drop("w")


def _in_passes(sets: DataFrame, name: str, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``later, earlier``: what ``find`` makes of the prefix words of ``sets``, a part of the words at a time."""
    rows = sets.select(*(c for c in sets.columns if c != "prefix"), F.posexplode("prefix").alias("i", "w"))
    parts = [C.staged(find(rows.filter(F.pmod("w", F.lit(PASSES)) == part)).distinct(), name) for part in range(PASSES)]
    pairs = C.staged(reduce(DataFrame.unionByName, parts).distinct(), name)
    for part in parts:
        C.discard(part)
    return pairs


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, classes: Column, percent: int) -> DataFrame:
    """``later`` of the pairs ``(later, earlier)`` of set ids whose full sets reach the threshold."""
    asked = pairs.select(F.explode(F.array("later", "earlier")).alias("sid")).distinct()
    places = C.staged(sets.select("sid", "doc_id", "line_no").join(asked, "sid", "left_semi"), "lines-asked")
    side = F.broadcast(places) if places.count() <= BROADCAST_LINES else places
    full = C.staged(
        lines_of(docs).join(side, ["doc_id", "line_no"])
        .select("sid", _keys(F.col("line"), classes).alias("keys")).dropDuplicates(["sid"]), "lines-words")
    x = full.select(F.col("sid").alias("later"), F.col("keys").alias("a"))
    y = full.select(F.col("sid").alias("earlier"), F.col("keys").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    both = pairs.join(x, "later").join(y, "earlier")
    out = C.staged(
        both.filter(100 * common >= percent * (F.size("a") + F.size("b") - common)).select("later").distinct(), "lines-late")
    C.discard(places)
    C.discard(full)
    return out


def repeated_lines(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The lines with words ``(doc_id, line_no, sid)``, and the kept ones among them.

    Rows with a null id or text have no part.
    """
    docs = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    classes = _classes(docs)
    # A filter on the keys would be moved below them and build them twice.
    worded = lines_of(docs).filter(F.col("line").rlike(WORDED))
    keyed = worded.select("doc_id", "line_no", _keys(F.col("line"), classes).alias("keys"))
    n = F.size("keys")
    prefix = n - F.ceil(n * percent / 100).cast("int") + 1
    wide = C.staged(keyed.select(
        "doc_id", "line_no", F.xxhash64("keys").alias("sid"), n.alias("n"), _parity(F.col("keys")).alias("bits"),
        *(_quarter(F.col("keys"), i).alias(f"q{i}") for i in range(3)),
        F.slice("keys", F.lit(1), prefix).alias("prefix")), "lines")
    lines = C.staged(wide.select("doc_id", "line_no", "sid"), "line-ids")
    full = wide.groupBy("sid").agg(F.min(F.struct("doc_id", "line_no", "n", "bits", "q0", "q1", "q2", "prefix")).alias("f"))
    full = C.staged(full.select("sid", "f.*"), "line-sets")
    sets = C.staged(full.select("sid", "doc_id", "line_no"), "line-firsts")
    C.discard(wide)

    def stars(rows: DataFrame) -> DataFrame:
        place = F.struct("doc_id", "line_no", "sid", "n", "bits", "q0", "q1", "q2", "i")
        x = rows.withColumn("y", F.min(place).over(Window.partitionBy("w")))
        x = x.select(F.struct(*rows.columns).alias("x"), "y").filter(f"x.sid <> y.sid and {_may_match('x', 'y', percent)}")
        return x.select(F.col("x.sid").alias("later"), F.col("y.sid").alias("earlier"))

    pairs = _in_passes(full, "line-stars", stars)
    settled = _verified(pairs, sets, docs, classes, percent)

    known = settled.select(F.col("later").alias("sid"), F.lit(True).alias("done"))
    known = F.broadcast(known) if known.count() <= BROADCAST_LINES else known
    marked = C.staged(full.join(known, "sid", "left").withColumn("open", F.col("done").isNull()).drop("done"), "line-marked")
    C.discard(full)

    def earlier(rows: DataFrame) -> DataFrame:
        x, y = _asking(rows, percent).alias("x"), _asked(rows, percent).alias("y")
        after = "struct(y.doc_id, y.line_no) < struct(x.doc_id, x.line_no)"
        before = "struct(x.doc_id, x.line_no) < struct(y.doc_id, y.line_no)"
        more = x.join(y, "at").filter(
            _may_match("x", "y", percent) + f" and y.n <= x.n and x.sid <> y.sid and ((x.open and {after}) or (y.open and {before}))")
        return more.select(
            F.expr(f"if({after}, x.sid, y.sid)").alias("later"), F.expr(f"if({after}, y.sid, x.sid)").alias("earlier"))

    more = _in_passes(marked, "line-pairs", earlier).join(pairs, ["later", "earlier"], "left_anti")
    C.discard(marked)
    late = _verified(more, sets, docs, classes, percent)
    gone = settled.unionByName(late).distinct().withColumnRenamed("later", "sid")
    kept = sets.select("sid", "doc_id", "line_no").join(gone, "sid", "left_anti")
    return lines, kept.select("doc_id", "line_no")


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with all columns, ``text`` without repeated lines, and ``_n_lines``, ``_n_removed``.

    Lines without words are never removed. A document all of whose lines with words are
    removed gets the empty text. A null text or id leaves the row as it is, with no
    line removed. Rows that share an id also share their lines' places, so a line of
    one is kept if the line at its place is the first of its set; a repeated row keeps
    what its first copy keeps. An empty table gives an empty table.
    """
    lines, kept = repeated_lines(docs, percent)
    names = [C.free_name(docs, n) for n in ("_n_lines", "_n_removed", "_gone")]
    gone = lines.select("doc_id", "line_no").distinct().join(kept, ["doc_id", "line_no"], "left_anti")
    gone = gone.groupBy("doc_id").agg(F.collect_set("line_no").alias(names[2]))
    all_lines = F.split("text", "\n")
    left = F.filter(all_lines, lambda line, i: ~F.array_contains(names[2], i))
    has = F.col(names[2]).isNotNull() & F.col("text").isNotNull()
    rest = F.array_join(left, "\n")
    bare = ~F.exists(left, lambda line: line.rlike(WORDED))
    return docs.join(gone, "doc_id", "left").select(
        *(F.when(has, F.when(bare, F.lit("")).otherwise(rest)).otherwise(F.col("text")).alias("text")
          if c == "text" else F.col(f"`{c}`") for c in docs.columns),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(all_lines)).cast("long").alias(names[0]),
        F.when(has, F.size(names[2])).otherwise(0).cast("long").alias(names[1]))


def drop_repeats(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without repeated lines and without the documents of which nothing is left.

    A document that had no line with words to begin with stays.
    """
    found = dedup_lines(docs, percent)
    removed = found.columns[-1]
    return found.filter((F.col(removed) == 0) | (F.col("text") != "")).select(*(F.col(f"`{c}`") for c in docs.columns))


def sql(percent: int = PERCENT) -> str:
    """DuckDB SQL for ``doc_id, n_lines, n_removed, text`` over ``documents``."""
    return f"""
    with lines as materialized (
        select doc_id, i - 1 as line_no, parts[i] as line from (
            select doc_id, parts, unnest(range(1, len(parts) + 1)) as i from (
                select doc_id, string_split(text, chr(10)) as parts from documents where text is not null))),
    worded as materialized (
        select doc_id, line_no, list_sort(list_distinct(list_filter(
            string_split_regex(lower(line), '[ \\t-\\r]+'), lambda w: w <> ''))) as words from lines),
    sets as materialized (
        select words, len(words) as n, min({{'d': doc_id, 'l': line_no}}) as f from worded where len(words) > 0 group by words),
    tokens as (select f, n, unnest(words) as w from sets),
    df as (select w, count(*) as c from tokens group by w),
    placed as (select f, n, t.w, row_number() over (partition by f order by c, t.w) as i from tokens t join df using (w)),
    prefix as materialized (select * from placed where i <= n - ceil(n * {percent} / 100.0) + 1),
    pairs as (
        select distinct x.f as later, y.f as earlier from prefix x join prefix y on x.w = y.w and y.f < x.f
        where 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)),
    gone as (
        select distinct later from pairs join sets a on a.f = later join sets b on b.f = earlier
        where 100 * len(list_intersect(a.words, b.words))
              >= {percent} * (a.n + b.n - len(list_intersect(a.words, b.words)))),
    kept as (select f.d as doc_id, f.l as line_no from sets where f not in (select later from gone)),
    marked as (
        select l.doc_id, l.line_no, l.line, len(w.words) > 0 as worded, len(w.words) > 0 and k.doc_id is null as removed
        from lines l join worded w using (doc_id, line_no) left join kept k using (doc_id, line_no)),
    found as (
        select doc_id, count(*) as n_lines, count(*) filter (removed) as n_removed,
               count(*) filter (worded and not removed) as left_,
               string_agg(line, chr(10) order by line_no) filter (not removed) as text from marked group by doc_id)
    select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed,
           case when n_removed > 0 and left_ = 0 then '' else coalesce(f.text, d.text) end as text
    from documents d left join found f using (doc_id)"""

"""License scans: phrases and notices found by voting on diagonals.

Every run of ``WIDTH`` words of a text (shorter for shorter templates) is joined by its
hash to the places where the templates have the same words. A hit at word ``i`` of the
text and place ``j`` of a template votes for the diagonal ``i - j``, on which that copy of
the template would start. Diagonals closer than ``1 / SLACK`` of the template are merged,
so that a copy with words put in or left out stays one span. A span is verified by the
words, not the hashes, that it has in common with the template:
``2 * common / (words of the template + words of the span)`` must reach the template's
threshold. With the threshold 1 all its words must stand there, consecutive, nothing
between; so it is for phrases.

The templates are a table of any size; it is broadcast while its runs are few.
All of it is DataFrame code, with one shuffle, of the hits and one row for each text.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 3
SLACK = 6
AGREE = 0.8
# Notices that single words tell from others must be there whole.
WHOLE = 1.0
# Template runs (about 100 bytes each) are broadcast up to this number.
BROADCAST_RUNS = 200_000

# The phrases of the base labels.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
# Opening words of common notices, as their publishers give them.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2.0", WHOLE),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", AGREE),
    ("gpl-2.0", "licensed under the gnu general public license version 2", WHOLE),
    ("gpl-3.0", "licensed under the gnu general public license version 3", WHOLE),
    ("gpl", "this program is free software you can redistribute it and/or modify it under the terms of the gnu general"
            " public license as published by the free software foundation", WHOLE),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", WHOLE),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", WHOLE),
    ("mit", "released under the mit license", AGREE),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
            " documentation files the software to deal in the software without restriction", AGREE),
    ("isc", "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby"
            " granted provided that the above copyright notice and this permission notice appear in all copies", AGREE),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"
            " the following conditions are met", AGREE),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior"
                     " written permission", AGREE),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v. 2.0", WHOLE),
    ("unlicense", "this is free and unencumbered software released into the public domain", AGREE),
    ("cc-by-4.0", "licensed under a creative commons attribution 4.0 international license", WHOLE),
    ("cc-by-nc-4.0", "licensed under cc by-nc 4.0", WHOLE),
    ("cc-by-sa-4.0", "licensed under cc by-sa 4.0", WHOLE),
]

_APART = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """A-Z lower-cased; words are runs of digits, letters and whatever is not ASCII."""
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), _APART), "")


def default_templates(spark: SparkSession) -> DataFrame:
    """``label, text, least, phrase``: the phrases and the notices."""
    rows = [(label, text, WHOLE, True) for label, text in PHRASES] + [(*row, False) for row in NOTICES]
    return spark.range(1).select(F.inline(F.array(*(
        F.struct(*(F.lit(v).alias(n) for n, v in zip(("label", "text", "least", "phrase"), row))) for row in rows))))


def _runs(found: Column) -> Column:
    """Each word with the ``WIDTH - 1`` behind it."""
    parts = [found] + [F.slice(found, j + 1, F.greatest(F.size(found), F.lit(1))) for j in range(1, WIDTH)]
    return F.arrays_zip(*(p.alias(f"w{j}") for j, p in enumerate(parts)))


def _hash(run: str, width: int) -> Column:
    return F.xxhash64(F.lit(width), *(F.col(f"{run}.w{j}") for j in range(width)))


def _template_runs(templates: DataFrame) -> DataFrame:
    """``t, label, least, phrase, size, width, place, h`` and the words ``v0..`` of each run of each template.

    A template is named by its label and words, so equal rows are one template. Those of
    fewer than two words, or without a label, are left out.
    """
    found = words(F.col("text"))
    rows = templates.select("label", F.coalesce("least", F.lit(AGREE)).alias("least"),
                            F.coalesce("phrase", F.lit(False)).alias("phrase"), found.alias("found"))
    rows = rows.filter(F.col("label").isNotNull() & (F.size("found") > 1)).groupBy("label", "found").agg(
        F.min("least").alias("least"), F.max("phrase").alias("phrase"))
    size = F.size("found")
    rows = rows.select(
        "label", "least", "phrase", size.alias("size"), F.least(size, F.lit(WIDTH)).alias("width"),
        F.md5(F.concat_ws(" ", "label", F.array_join("found", " "))).alias("t"), F.posexplode(_runs(F.col("found"))).alias("place", "v"))
    rows = rows.filter(F.col("place") <= F.col("size") - F.col("width"))
    h = F.lit(None).cast("long")
    for width in range(2, WIDTH + 1):
        h = F.when(F.col("width") == width, _hash("v", width)).otherwise(h)
    return rows.withColumn("h", h).select("t", "label", "least", "phrase", "size", "width", "place", "h", "v")


def _hits(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """Rows of hits, and for each text one row without a template."""
    found = words(F.col("text"))
    rows = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("key"), found.alias("found"))
    rows = rows.select("doc_id", "key", F.size("found").cast("long").alias("n_words"),
                       F.posexplode_outer(_runs(F.col("found"))).alias("at", "run"))
    marks = [F.struct(F.lit(width).alias("kind"), _hash("run", width).alias("h")) for width in range(2, WIDTH + 1)]
    head = F.struct(F.lit(0).alias("kind"), F.lit(None).cast("long").alias("h"))
    begins = F.coalesce(F.col("at"), F.lit(0)) == 0
    rows = rows.select("doc_id", "key", "n_words", "at", "run",
                       F.explode(F.when(begins, F.array(head, *marks)).otherwise(F.array(*marks))).alias("g"))
    rows = rows.select("doc_id", "key", "n_words", "at", "run", F.col("g.kind").alias("kind"), F.col("g.h").alias("g"))
    runs = _template_runs(templates)
    runs = F.broadcast(runs) if runs.count() <= BROADCAST_RUNS else runs
    same = (F.col("g") == F.col("h")) & (F.col("kind") == F.col("width"))
    for j in range(WIDTH):
        same &= (F.col("width") <= j) | (F.col(f"run.w{j}") == F.col(f"v.w{j}"))
    rows = rows.join(runs, same, "left").filter("t is not null or kind = 0")
    return rows.select("doc_id", "key", "n_words", "at", "t", "label", "least", "phrase", "size", "width", "place")


def _spans(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """One row for each text (``t`` null, ``rows`` its number of equal rows) and for each span in it."""
    # One shuffle for all that follows: every later group lies within these keys.
    hits = _hits(docs, templates).repartition("doc_id", "key")
    text, template = ["doc_id", "key", "n_words"], ["t", "label", "least", "phrase", "size", "width"]
    # Equal rows vote once, as places are sets.
    votes = hits.groupBy(*text, *template, (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places"), F.min("at").alias("first"),
        (F.max("at") + F.first("width")).alias("end"), F.count("*").alias("rows"))
    order = "partition by doc_id, key, t, size order by diagonal"
    far = F.expr(f"diagonal - lag(diagonal) over ({order}) > if(least >= 1, 0, floor(size / {SLACK}))")
    votes = votes.withColumn("new", F.coalesce(far.cast("int"), F.lit(0)))
    votes = votes.withColumn("copy", F.expr(f"sum(new) over ({order} rows unbounded preceding)"))
    spans = votes.groupBy(*text, *template, "copy").agg(
        F.min("first").alias("first"), F.max("end").alias("end"), F.flatten(F.collect_list("places")).alias("places"),
        F.sum("rows").alias("rows"))
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("width") - 1))))
    agreement = 2.0 * F.size(covered) / (F.col("size") + F.col("end") - F.col("first"))
    return spans.withColumn("agreement", agreement).select(*text, "t", "label", "least", "phrase", "first", "end", "agreement", "rows")


def license_spans(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """``doc_id, label, first, end, agreement, phrase`` of every verified span of words ``[first, end)``.

    Needs ``doc_id`` and ``text``; other columns have no part. A
    null or empty text has no spans, a row that is repeated shows its spans once.
    """
    templates = default_templates(docs.sparkSession) if templates is None else templates
    found = _spans(docs, templates).filter("agreement >= least")
    return found.select("doc_id", "label", "first", "end", "agreement", "phrase")


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """For each row of ``docs`` the phrases, the labels and the best agreement found.

    ``n_words``; ``n_base, first_word, last_word, base_labels`` of the phrases, whose
    places may overlap; ``labels`` of phrases and verified spans, sorted and joined by
    commas; ``score`` the highest agreement of any span, verified or not, 0 without one.
    Null and empty texts have no words and empty labels. Rows may share an id or be
    equal, and a null id is an id like others: each row gets its own result. An empty
    table gives an empty table.
    """
    templates = default_templates(docs.sparkSession) if templates is None else templates
    spans = _spans(docs, templates)
    ok = F.col("agreement") >= F.col("least")
    base = ok & F.col("phrase")

    def labels(which: Column) -> Column:
        return F.concat_ws(",", F.array_sort(F.collect_set(F.when(which, F.col("label")))))

    rows = spans.groupBy("doc_id", "key", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"), labels(base).alias("base_labels"),
        labels(ok).alias("labels"), F.coalesce(F.max("agreement"), F.lit(0.0)).alias("score"),
        F.sum(F.when(F.col("t").isNull(), F.col("rows"))).alias("rows"))
    return rows.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("_", "rows", "key")


def sql() -> str:
    """DuckDB SQL for ``scan_licenses`` over ``documents`` with the default templates."""
    rows = [(label, text, WHOLE, True) for label, text in PHRASES] + [(*row, False) for row in NOTICES]
    values = ", ".join(f"('{label}', '{text}', {least:.2f}, {phrase})" for label, text, least, phrase in rows)
    of = "regexp_extract_all(translate({}, '" + string.ascii_uppercase + "', '" + string.ascii_lowercase + \
        "'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    with templates as (
        select row_number() over () as t, label, words, len(words) as size, least, phrase,
               case when len(words) < {WIDTH} then len(words) else {WIDTH} end as width
        from (select distinct label, {of.format('text')} as words, least, phrase from (values {values}) v(label, text, least, phrase))),
    runs as materialized (
        select t, label, size, least, phrase, width, j - 1 as place, words[j:j + width - 1] as run
        from templates, unnest(range(1, size - width + 2)) u(j)),
    docs as materialized (
        select row_number() over () as r, doc_id, {of.format("coalesce(text, '')")} as words from documents),
    grams as (
        select r, i - 1 as spot, words[i:i + w - 1] as run, w from (
            select r, words, i from docs, unnest(range(1, len(words) + 1)) u(i)
            where words[i] in (select run[1] from runs)), unnest(range(2, {WIDTH + 1})) v(w)
        where i + w - 1 <= len(words)),
    hits as (
        select r, t, label, size, least, phrase, width, place, spot, spot - place as diagonal from grams join runs using (run)),
    votes as (
        select r, t, label, size, least, phrase, width, diagonal, list(place) as places, min(spot) as first, max(spot + width) as last
        from hits group by all),
    stepped as (
        select *, case when diagonal - lag(diagonal) over (partition by r, t order by diagonal)
                       > case when least >= 1 then 0 else size // {SLACK} end then 1 else 0 end as fresh from votes),
    copies as (select *, sum(fresh) over (partition by r, t order by diagonal rows unbounded preceding) as copy from stepped),
    merged as (
        select r, t, label, size, least, phrase, width, copy, min(first) as first, max(last) as last, flatten(list(places)) as places
        from copies group by all),
    covered as (
        select r, t, copy, count(distinct p + k) as n
        from merged, unnest(places) u(p), unnest(range(0, width)) v(k) group by all),
    spans as (
        select r, label, least, phrase, first, 2.0::double * n / (size + last - first)::double as agreement
        from merged join covered using (r, t, copy)),
    found as (
        select r, count(*) filter (agreement >= least and phrase) as n_base,
               min(first) filter (agreement >= least and phrase) as first_word,
               max(first) filter (agreement >= least and phrase) as last_word,
               string_agg(distinct label, ',' order by label) filter (agreement >= least and phrase) as base_labels,
               string_agg(distinct label, ',' order by label) filter (agreement >= least) as labels,
               max(agreement) as score
        from spans group by r)
    select doc_id, len(words) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
           coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
    from docs left join found using (r)"""

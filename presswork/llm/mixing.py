"""Mix sources to target weights: iterative proportional fitting, then calibrated sampling.

Documents fall into cells of (source, language, topic). Token sums of the cells are
raked in rounds (Deming and Stephan, 1940): scale every source to its target share,
then every language, then every topic. The raked mass of a cell over its own tokens is
the weight of its documents. Documents are kept with probability
``min(1, scale * weight)``; ``scale`` makes the expected tokens meet the budget, by
rounds of giving the part that full cells can't take to the others.

Only the cell table is iterated; texts are read once and never shuffled. All of it is
DataFrame code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.llm import common as C
from presswork.session import ensure_checkpoint_dir

# Targets by name; what isn't named takes the last entry. Shares of those present are
# normalised. Sources get the square root of their own token share, which flattens a
# source that holds much of the corpus.
LANGUAGES = {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15, None: 0.02}
TOPICS = {"table": 0.05, "contact": 0.05, "legal": 0.05, "note": 0.1, "article": 0.5, "book": 0.25, None: 0.05}
SOURCE_POWER = 0.5
# Topics by what a text holds, the first rule that fits; then by its number of words.
TOPIC_MARKS = [("table", " | "), ("legal", "icensed under"), ("legal", "opyright"), ("contact", "@")]
TOPIC_WORDS = [("note", 100), ("article", 1000)]
LONGEST = "book"
ROUNDS = 8
BUDGET = 0.6        # share of all tokens that is kept
SEED = "mix"
WORD = "[^ \\t-\\r]+"
# A cell table of at most so many rows is raked in one place and broadcast; a larger one
# takes shuffles. The results are the same.
BROADCAST_CELLS = 100_000

DIMENSIONS = ("source", "lang", "topic")


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    rules = [(text.contains(mark), name) for name, mark in TOPIC_MARKS]
    rules += [(tokens < below, name) for name, below in TOPIC_WORDS]
    return reduce(lambda rest, rule: F.when(rule[0], F.lit(rule[1])).otherwise(rest), reversed(rules), F.lit(LONGEST))


def _target(column: str, shares: dict) -> Column:
    rest = F.lit(float(shares[None]))
    return reduce(lambda out, kv: F.when(F.col(column) == kv[0], F.lit(float(kv[1]))).otherwise(out),
                  [kv for kv in shares.items() if kv[0] is not None], rest)


def _with_targets(cells: DataFrame, languages: dict, topics: dict) -> DataFrame:
    """``cells`` with the target share of its value in each dimension; 0 where the value has no tokens."""
    out = cells
    for name in DIMENSIONS:
        held = cells.groupBy(name).agg(F.sum("tokens").alias("held")).filter("held > 0")
        raw = {"source": F.pow(F.col("held").cast("double"), F.lit(SOURCE_POWER)),
               "lang": _target("lang", languages), "topic": _target("topic", topics)}[name]
        held = held.select(name, raw.alias("raw"))
        total = held.agg(F.sum("raw")).scalar()
        out = out.join(held.select(name, (F.col("raw") / total).alias(f"to_{name}")), name, "left")
    return out.select(*DIMENSIONS, "tokens", *(F.coalesce(f"to_{d}", F.lit(0.0)).alias(f"to_{d}") for d in DIMENSIONS))


def _scaled(state: DataFrame, name: str, held: Column) -> DataFrame:
    factor = F.when(held > 0, F.col(f"to_{name}") / held).otherwise(0.0)
    return state.withColumn("mass", F.col("mass") * factor)


def rake(cells: DataFrame, languages: dict = LANGUAGES, topics: dict = TOPICS, rounds: int = ROUNDS,
         in_place: int = BROADCAST_CELLS) -> DataFrame:
    """``cells(source, lang, topic, tokens)`` with the raked ``mass`` of each; masses sum to 1.

    A cell without tokens has no mass. If no table meets all targets, the last dimension,
    topic, is met and the others as nearly as the rounds come.

    A table of at most ``in_place`` cells is raked by windows where it lies, in one job;
    a larger one by partial sums that are joined back, a checkpoint each round.
    """
    small = cells.count() <= in_place
    total = cells.agg(F.sum("tokens")).scalar()
    state = _with_targets(cells, languages, topics).withColumn(
        "mass", F.when(F.col("tokens") > 0, F.col("tokens") / total).otherwise(0.0))
    state = (state.coalesce(1) if small else state).checkpoint()
    for i in range(rounds):
        for name in DIMENSIONS:
            if small:
                state = _scaled(state, name, F.sum("mass").over(Window.partitionBy(name)))
            else:
                held = state.groupBy(name).agg(F.sum("mass").alias("held"))
                state = _scaled(state.join(held, name), name, F.col("held")).drop("held")
        if not small or i % 4 == 3:
            state = state.checkpoint()
    return state.select(*DIMENSIONS, "tokens", "mass").checkpoint()


def keep_probabilities(raked: DataFrame, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """Cells with ``weight`` (raked over own share) and ``keep`` (probability for its documents)."""
    totals = raked.agg(F.sum("tokens").alias("t"), F.sum("mass").alias("m")).first()
    tokens = float(totals.t or 0)
    scale = budget * tokens / totals.m if totals.m else 0.0
    for _ in range(rounds):
        full = F.col("tokens") <= F.lit(scale) * F.col("mass")
        part = raked.agg(
            F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("taken"),
            F.sum(F.when(full, 0.0).otherwise(F.col("mass"))).alias("open")).first()
        if not part.open:
            break
        last, scale = scale, (budget * tokens - part.taken) / part.open
        if scale == last:
            break
    has = F.col("tokens") > 0
    return raked.select(
        *DIMENSIONS,
        F.when(has, F.col("mass") * F.lit(tokens) / F.col("tokens")).otherwise(1.0).alias("weight"),
        F.when(has, F.least(F.lit(1.0), F.lit(scale) * F.col("mass") / F.col("tokens"))).otherwise(1.0).alias("keep"))


def _classified(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with cell columns and token count under free names."""
    names = {name: C.free_name(docs, f"_mix_{name}") for name in (*DIMENSIONS, "tokens")}
    rows = docs.withColumns({
        names["source"]: F.coalesce("source", F.lit("")), names["lang"]: F.coalesce("lang", F.lit("")),
        names["tokens"]: n_tokens(F.col("text"))})
    return rows.withColumn(names["topic"], topic_of(F.col("text"), F.col(names["tokens"]))), names


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from the id, or from the text where there is none."""
    key = F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(16 ** 13)


def with_probabilities(docs: DataFrame, budget: float = BUDGET, languages: dict = LANGUAGES, topics: dict = TOPICS,
                       rounds: int = ROUNDS) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with topic, tokens, weight, keep and draw; and the names these columns got."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows, names = _classified(docs)
    cells = rows.groupBy(*(F.col(names[d]).alias(d) for d in DIMENSIONS)).agg(
        F.sum(names["tokens"]).alias("tokens")).checkpoint()
    chances = keep_probabilities(rake(cells, languages, topics, rounds), budget, rounds).checkpoint()
    count = chances.count()
    chances = chances.select(
        *(F.col(d).alias(names[d]) for d in DIMENSIONS), F.col("weight").alias(C.free_name(docs, "_mix_weight")),
        F.col("keep").alias(C.free_name(docs, "_mix_keep")))
    names |= {"weight": chances.columns[3], "keep": chances.columns[4], "draw": C.free_name(docs, "_mix_draw")}
    side = F.broadcast(chances) if count <= BROADCAST_CELLS else chances
    joined = rows.join(side, [names[d] for d in DIMENSIONS], "left")
    return joined.withColumn(names["draw"], uniform(F.col("doc_id"), F.col("text"))), names


def mix(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, topic, n_tokens, weight, keep_prob, kept`` for each row of ``docs``.

    Reads ``doc_id, text, lang, source``. A null source or language is the empty one; a
    null text is empty and counts no tokens. Rows that share an id share their draw; a
    row without one draws by its text. Cells without tokens are kept whole. Weights are
    relative to the corpus: 1 leaves a document's share as it is. An empty table gives an
    empty table.
    """
    rows, n = with_probabilities(docs.select("doc_id", "text", "lang", "source"), **options)
    return rows.select(
        "doc_id", F.col(n["topic"]).alias("topic"), F.col(n["tokens"]).alias("n_tokens"),
        F.round(n["weight"], 6).alias("weight"), F.round(n["keep"], 6).alias("keep_prob"),
        (F.col(n["draw"]) < F.col(n["keep"])).alias("kept"))


def sample_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents that ``mix`` keeps, all columns as they are."""
    rows, n = with_probabilities(docs, **options)
    return rows.filter(F.col(n["draw"]) < F.col(n["keep"])).select(*(F.col(f"`{c}`") for c in docs.columns))


# -- the same as SQL -------------------------------------------------------------------

def _case(column: str, shares: dict) -> str:
    whens = " ".join(f"when '{k}' then {float(v)}" for k, v in shares.items() if k is not None)
    return f"case {column} {whens} else {float(shares[None])} end"


def sql(budget: float = BUDGET, rounds: int = ROUNDS, table: str = "documents") -> str:
    """DuckDB SQL for ``mix``, round by round."""
    marks = " ".join(f"when contains(coalesce(text, ''), '{mark}') then '{name}'" for name, mark in TOPIC_MARKS)
    words = " ".join(f"when n_tokens < {below} then '{name}'" for name, below in TOPIC_WORDS)
    parts = [f"""
    counted as materialized (
        select doc_id, text, coalesce(source, '') as source, coalesce(lang, '') as lang,
               coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0)::bigint as n_tokens from {table}),
    rows_ as materialized (select *, case {marks} {words} else '{LONGEST}' end as topic from counted),
    cells as materialized (select source, lang, topic, sum(n_tokens)::double as tokens from rows_ group by all)"""]
    raw = {"source": f"pow(held, {SOURCE_POWER})", "lang": _case("lang", LANGUAGES), "topic": _case("topic", TOPICS)}
    for d in DIMENSIONS:
        parts.append(f"""
    target_{d} as materialized (
        select {d}, raw / sum(raw) over () as target from (
            select {d}, {raw[d]} as raw from (select {d}, sum(tokens) as held from cells group by {d}) where held > 0))""")
    parts.append("s0 as materialized (select *, case when tokens > 0 then tokens / (select sum(tokens) from cells) else 0.0 end as mass from cells)")
    step = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            parts.append(f"""
    s{step + 1} as materialized (
        select s.source, s.lang, s.topic, s.tokens,
               s.mass * case when h.held > 0 then coalesce(t.target, 0.0) / h.held else 0.0 end as mass
        from s{step} s left join (select {d}, sum(mass) as held from s{step} group by {d}) h using ({d})
        left join target_{d} t using ({d}))""")
            step += 1
    total = "(select sum(tokens) from cells)"
    parts.append(f"c0 as materialized (select {budget} * {total} / (select sum(mass) from s{step}) as scale)")
    for i in range(rounds):
        parts.append(f"""
    c{i + 1} as materialized (
        select coalesce((select ({budget} * {total} - sum(case when full_ then tokens else 0 end))
                         / nullif(sum(case when full_ then 0.0 else mass end), 0)
                from (select tokens, mass, tokens <= (select scale from c{i}) * mass as full_ from s{step})),
               (select scale from c{i})) as scale)""")
    parts.append(f"""
    chances as materialized (
        select source, lang, topic, case when tokens > 0 then mass * {total} / tokens else 1.0 end as weight,
               case when tokens > 0 then least(1.0, (select scale from c{rounds}) * mass / tokens) else 1.0 end as keep
        from s{step})""")
    return f"""with {','.join(parts)}
    select doc_id, topic, n_tokens, round(weight, 6) as weight, round(keep, 6) as keep_prob,
           ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, text, '')), 1, 13))::bigint / pow(16.0, 13) < keep as kept
    from rows_ join chances using (source, lang, topic)"""

"""Mixing sources to target weights by iterative proportional fitting.

Documents fall in cells of source, language and topic. Token counts of the
cells are raked to the target shares of all three: each pass divides the target
of every category by the tokens it now weighs, dimension after dimension, until
the marginals are within TOLERANCE of the targets. The weight of a cell is the
product of its three factors. A document is kept with probability
min(1, rate * weight), decided by a hash of its id so that reruns choose alike;
the rate is set so that BUDGET of all tokens is expected to stay. Cells at
probability 1 can't give more, and the rest make up for them.

A source's target is its share of the tokens to the power TEMPER, unless targets
are given; the MAX_SOURCES largest sources are categories of their own. A
document's topic is the one with most cues in it, where that is a cue in every
CUE_WORDS words at least, else prose. Categories that a target does not name
fall in OTHER, so there are at most as many cells as the product of the targets'
sizes plus one each. The cell table is one row of that bounded size; the rounds
run inside one SQL expression.

Defined results: null text has no tokens and is prose; a null source or
language is OTHER; targets of absent categories are left out and the rest
scaled to 1; cells without tokens keep weight 0 and lose their documents,
unless no cell has tokens, when all are kept; rows of one id are kept or
dropped together; a null id hashes as the empty string; an empty table gives an
empty result; other columns pass through, but for those named as the added ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.llm.common import WORD_RE, Scratch, table

OTHER = "other"
ROUNDS, PASSES, TOLERANCE, RATE_ROUNDS, BUDGET, SEED = 30, 10, 1e-6, 12, 0.6, "mix-1"
MAX_SOURCES, TEMPER, CUE_WORDS = 256, 0.7, 50
#: Cues of each topic; of equal counts the first topic wins.
CUES = {
    "tabular": "[|\\t]",
    "legal": "[LCWHPlcwhp](?:icen[cs]e|opyright|arrant|iabilit|ereby|ursuant)",
    "contact": "@|://|www[.]|[0-9]{3}[ -][0-9]{3}",
    "code": "[{};]|==|[(][)]",
    "noise": "[#$%&*~^]{2,}",
}


@dataclass(frozen=True)
class Targets:
    """Target shares of tokens by category; each dimension is scaled to sum to 1 over the categories present. source None: tempered shares."""

    source: dict[str, float] | None = None
    lang: dict[str, float] = field(default_factory=lambda: {"en": 0.50, "de": 0.18, "fr": 0.18, "es": 0.14, OTHER: 0.01})
    topic: dict[str, float] = field(default_factory=lambda: {"prose": 0.90, "legal": 0.03, "contact": 0.02, "tabular": 0.03, "code": 0.01, "noise": 0.01})


def category(column: str, known: dict[str, float]) -> Column:
    """The column's value where the target names it, else OTHER."""
    return F.when(F.col(column).isin(*[k for k in known if k != OTHER]), F.col(column)).otherwise(F.lit(OTHER))


def topic(text_col: str, n_tokens: Column) -> Column:
    """The topic with most cues in the text, if they are frequent enough among its tokens; else prose."""
    counts = [F.coalesce(F.regexp_count(F.col(text_col), F.lit(p)), F.lit(0)) for p in CUES.values()]
    # One array, so that each pattern is counted once.
    found = F.array(*counts)
    most = F.transform(F.array(found), lambda c: F.when(F.array_max(c) * CUE_WORDS >= F.greatest(n_tokens, F.lit(1)), F.get(F.array(*[F.lit(k) for k in CUES]), (F.array_position(c, F.array_max(c)) - 1).cast("int"))))
    return F.coalesce(F.get(most, F.lit(0)), F.lit("prose"))


def tokens(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_RE)), F.lit(0)).cast("long")


def chance(id_col: str, seed: str = SEED) -> Column:
    """A uniform number of [0, 1) from the id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def factors(cells: DataFrame, targets: Targets, scratch: Scratch, rounds: int = ROUNDS, budget: float = BUDGET) -> tuple[dict[str, dict[str, float]], float, float]:
    """Factor of each category of each dimension, the sampling rate (0 without tokens), and how far a marginal is from its target at most.

    cells: source, lang, topic, n (tokens). Rounds are repeated until the marginals are within TOLERANCE, PASSES times at most."""
    names = {"s": sorted(targets.source | {OTHER: 0.0}), "l": sorted(targets.lang | {OTHER: 0.0}), "t": sorted(targets.topic | {OTHER: 0.0})}
    goals = {"s": targets.source, "l": targets.lang, "t": targets.topic}
    listed = cells.agg(F.collect_list(F.struct(*[F.array_position(F.array(*[F.lit(x) for x in names[k]]), F.col(c)).cast("int").alias(k) for k, c in (("s", "source"), ("l", "lang"), ("t", "topic"))], F.col("n").cast("double").alias("n"))).alias("cells"))
    for k in names:
        goal = ", ".join(f"{float(goals[k].get(x, 0.0))!r}D" for x in names[k])
        listed = listed.withColumn(f"goal_{k}", F.expr(f"transform(array({goal}), (g, j) -> if(exists(cells, c -> c.{k} = j + 1 AND c.n > 0), g, 0D))"))
        listed = listed.withColumn(f"goal_{k}", F.expr(f"transform(goal_{k}, g -> try_divide(g, aggregate(goal_{k}, 0D, (z, x) -> z + x)))"))
    size = {k: len(names[k]) for k in names}

    def rake(k: str, state: str) -> str:
        """New factors of one dimension, given the others'."""
        others = " * ".join(f"{state}.{o}[c.{o} - 1]" for o in names if o != k)
        weighed = f"aggregate(filter(cells, c -> c.{k} = j + 1), 0D, (z, c) -> z + c.n * {others})"
        return f"transform(goal_{k}, (g, j) -> coalesce(try_divide(g, {weighed}), 0D))"

    body = f"named_struct('s', {rake('s', 'x0')}, 'l', x0.l, 't', x0.t)"
    for i, k in enumerate(("l", "t"), 1):
        step = f"x{i}"
        fields = ", ".join(f"'{o}', " + (rake(k, step) if o == k else f"{step}.{o}") for o in names)
        body = f"transform(array({body}), {step} -> named_struct({fields}))[0]"
    start = "named_struct(" + ", ".join(f"'{k}', array_repeat(1D, {size[k]})" for k in names) + ")"
    raked = listed.withColumn("x", F.expr(start))
    keep = ["cells", *[f"goal_{k}" for k in names]]
    off = ", ".join(f"array_max(transform(goal_{k}, (g, j) -> abs(g - aggregate(filter(cells, c -> c.{k} = j + 1), 0D, (z, c) -> z + c.n * x.s[c.s - 1] * x.l[c.l - 1] * x.t[c.t - 1]))))" for k in names)
    for i in range(PASSES):
        raked = raked.select(*keep, F.expr(f"aggregate(sequence(1, {int(rounds)}), x, (x0, i) -> {body})").alias("x"))
        raked = scratch.write(raked, f"raked-{i}").withColumn("gap", F.expr(f"coalesce(greatest({off}), 0D)"))
        gap = raked.select("gap").first()["gap"]
        if gap <= TOLERANCE:
            break
    raked = raked.withColumn("w", F.expr("transform(cells, c -> x.s[c.s - 1] * x.l[c.l - 1] * x.t[c.t - 1])")).withColumn("m", F.expr("arrays_zip(cells, w)"))
    goal = f"{budget!r}D * aggregate(cells, 0D, (z, c) -> z + c.n)"
    capped = "aggregate(filter(m, c -> r * c.w >= 1), 0D, (z, c) -> z + c.cells.n)"
    free = "aggregate(filter(m, c -> r * c.w < 1), 0D, (z, c) -> z + c.cells.n * c.w)"
    rate = f"aggregate(sequence(1, {RATE_ROUNDS}), 0D, (r, i) -> coalesce(try_divide({goal} - {capped}, {free}), r))"
    row = raked.select("x", F.expr(rate).alias("rate")).first()
    return {k: dict(zip(names[k], row["x"][k])) for k in names}, row["rate"], gap


def probability(found: dict[str, dict[str, float]], rate: float) -> Column:
    """Probability of keeping a document, from its category columns _source, _lang and _topic."""
    if not rate:
        return F.lit(1.0)
    of = {k: F.create_map(*[F.lit(y) for x in found[k].items() for y in x]) for k in found}
    return F.least(F.lit(1.0), of["s"][F.col("_source")] * of["l"][F.col("_lang")] * of["t"][F.col("_topic")] * F.lit(rate))


def tempered(cells: DataFrame, temper: float = TEMPER, most: int = MAX_SOURCES) -> dict[str, float]:
    """Target of each of the largest sources, and of the others together: their tokens to some power. cells: source, n."""
    sizes = cells.where("source is not null").groupBy("source").agg(F.sum("n").alias("n")).where("n > 0").orderBy(F.desc("n"), "source")
    rows = sizes.limit(most).collect()
    total = cells.agg(F.sum("n").alias("n")).first()["n"] or 0
    rest = total - sum(r["n"] for r in rows if r["source"] != OTHER)
    return {r["source"]: float(r["n"]) ** temper for r in rows if r["source"] != OTHER} | {OTHER: float(rest) ** temper}


def weighed(docs: DataFrame, targets: Targets = Targets(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", rounds: int = ROUNDS, budget: float = BUDGET) -> DataFrame:
    """The documents, all columns, and _tokens, _source, _lang, _topic, _prob (of being kept) and _kept."""
    scratch = Scratch(docs.sparkSession, "mixing")
    docs = docs.drop("_source", "_lang", "_topic", "_prob", "_kept", "_tokens")
    # Texts are counted once; what follows reads a few columns of this table.
    marked = docs.withColumn("_tokens", tokens(text_col)).withColumn("_lang", category(lang_col, targets.lang)).withColumn("_topic", topic(text_col, F.col("_tokens")))
    marked = scratch.write(marked, "marked")
    cells = marked.groupBy(F.col(source_col).alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic")).agg(F.sum("_tokens").alias("n"))
    cells = scratch.write(cells, "cells")
    if targets.source is None:
        targets = replace(targets, source=tempered(cells))
    cells = cells.groupBy(category("source", targets.source).alias("source"), "lang", "topic").agg(F.sum("n").alias("n"))
    found, rate, _ = factors(cells, targets, scratch, rounds, budget)
    marked = marked.withColumn("_source", category(source_col, targets.source))
    return marked.withColumn("_prob", probability(found, rate)).withColumn("_kept", chance(id_col) < F.col("_prob"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang and topic category, tokens, probability and whether it is kept, per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return weighed(docs).select("doc_id", F.col("_source").alias("source_cat"), F.col("_lang").alias("lang_cat"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("_prob", 6).alias("prob"), F.col("_kept").alias("kept"))


def _sql(targets: Targets = Targets(), rounds: int = ROUNDS) -> str:
    """The same in SQL, one step per raked dimension."""
    def goals(known):
        return ", ".join(f"('{k}', {v!r})" for k, v in known.items())

    steps, last = [], "w0"
    for i in range(rounds):
        for d in ("s", "l", "t"):
            steps.append(f"w{len(steps) + 1} AS MATERIALIZED (SELECT s, l, t, n, w * g_{d} / sum(w) OVER (PARTITION BY {d}) AS w, g_s, g_l, g_t FROM {last})")
            last = f"w{len(steps)}"
    total = "(SELECT sum(n) FROM m)"
    rates = [f"r{i + 1} AS MATERIALIZED (SELECT coalesce(({BUDGET!r}::DOUBLE * {total} - coalesce((SELECT sum(n) FROM m WHERE r * w >= 1), 0)) / nullif((SELECT sum(n * w) FROM m WHERE r * w < 1), 0), r) AS r FROM r{i})" for i in range(RATE_ROUNDS)]
    langs = ", ".join(repr(k) for k in targets.lang if k != OTHER)
    counts = ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '{p}'))" for p in CUES.values())
    return f"""
WITH raw AS MATERIALIZED (
  SELECT doc_id, source, CASE WHEN lang IN ({langs}) THEN lang ELSE '{OTHER}' END AS l, [{counts}] AS c,
    CAST(coalesce(len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')), 0) AS BIGINT) AS n FROM documents
), sizes AS (SELECT source, sum(n) AS n FROM raw WHERE source IS NOT NULL GROUP BY source HAVING sum(n) > 0 ORDER BY sum(n) DESC, source LIMIT {MAX_SOURCES}
), known AS (SELECT source, n FROM sizes WHERE source <> '{OTHER}'
), d AS MATERIALIZED (
  SELECT doc_id, coalesce(known.source, '{OTHER}') AS s, l, n_words AS n, coalesce(CASE WHEN list_max(c) * {CUE_WORDS} >= greatest(n_words, 1) THEN {list(CUES)!r}[list_position(c, list_max(c))] END, 'prose') AS t
  FROM (SELECT doc_id, source, l, c, n AS n_words FROM raw) r LEFT JOIN known ON known.source = r.source
), cells AS (SELECT s, l, t, CAST(sum(n) AS DOUBLE) AS n FROM d GROUP BY ALL HAVING sum(n) > 0
), gs AS (SELECT k, v / sum(v) OVER () AS g FROM (SELECT s AS k, CAST(sum(n) AS DOUBLE) ** {TEMPER!r} AS v FROM cells GROUP BY s)
), gl AS (SELECT k, v / sum(v) OVER () AS g FROM (VALUES {goals(targets.lang)}) x(k, v) WHERE k IN (SELECT l FROM cells)
), gt AS (SELECT k, v / sum(v) OVER () AS g FROM (VALUES {goals(targets.topic)}) x(k, v) WHERE k IN (SELECT t FROM cells)
), w0 AS MATERIALIZED (SELECT s, l, t, n, n AS w, gs.g AS g_s, gl.g AS g_l, gt.g AS g_t FROM cells JOIN gs ON gs.k = s JOIN gl ON gl.k = l JOIN gt ON gt.k = t
), {', '.join(steps)}, m AS MATERIALIZED (SELECT s, l, t, n, w / n AS w FROM {last}), r0 AS (SELECT 0.0::DOUBLE AS r), {', '.join(rates)},
p AS (SELECT s, l, t, least(1.0, r * w) AS p FROM m, r{RATE_ROUNDS})
SELECT doc_id, s AS source_cat, l AS lang_cat, t AS topic, n AS n_tokens, round(coalesce(p, 0.0), 6) AS prob,
  CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0 < coalesce(p, 0.0) AS kept
FROM d LEFT JOIN p USING (s, l, t)
"""


SQL = _sql()

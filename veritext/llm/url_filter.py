"""URL filter: host and path rules, else a logistic regression on hashed character n-grams.

Rules name a host and the start of a path and fit the host with all its
subdomains; the longest fitting rule decides. Every other url is judged by a
logistic regression on hashed n-grams of host and path, trained on a small
labelled table of urls (labelled_urls.tsv, or any table of url and label). Training is
full-batch gradient descent inside one SQL expression over one row that holds
the table, so it needs no user code; the weights, DIMENSIONS numbers, go into
the scoring expression as a constant.

Defined results: a null url, or one without ://, has empty host and path, fits
no rule and gets the model's verdict of the empty strings; repeated rows get
equal rows; ties between rules of one length go to the rule listed first; an
empty training table allows every url; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.llm.common import Scratch, table

#: Rules of the contract: verdict, host and path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DIMENSIONS, STEPS, RATE, DECAY = 4096, 150, 8.0, 2e-4
#: The labelled table: a url and 1 for blocked, in this folder.
LABELLED = Path(__file__).with_name("labelled_urls.tsv")


def seed_urls() -> list[tuple[str, int]]:
    """The labelled urls, 1 for blocked."""
    return [(url, int(label)) for url, label in (line.split("\t") for line in LABELLED.read_text().splitlines())]


def seed_table(spark: SparkSession) -> DataFrame:
    """The labelled urls as a table of constants."""
    rows = json.dumps([{"url": u, "label": y} for u, y in seed_urls()])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<url:string,label:int>>")))


def host_and_path(url_col: str) -> tuple[Column, Column]:
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for how, text in sorted(reversed(rules), key=lambda r: len(r[1])):  # the last condition wraps the others and is asked first
        where, slash, rest = text.partition("/")
        fits = ((host == where) | F.endswith(host, F.lit("." + where))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(how)).otherwise(verdict)
    return rule, verdict


def ngrams(host: str, path: str) -> str:
    """SQL of the distinct hash buckets of a url's 3- to 5-grams of the host and 3-grams of the path."""
    def grams(mark: str, column: str, n: int) -> str:
        # Characters first, so that a long url costs its length and not the square of it.
        starts = f"sequence(1, greatest(1, size(c) + 1 - {n}))"
        return f"transform(array(split(concat('^', {column}, '$'), '')), c -> transform({starts}, p -> cast(pmod(xxhash64('{mark}', array_join(slice(c, p, {n}), '')), {DIMENSIONS}) as int)))[0]"

    return f"array_distinct(concat({grams('h', host, 3)}, {grams('h', host, 4)}, {grams('h', host, 5)}, {grams('p', path, 3)}))"


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label") -> list[float]:
    """Weights of the buckets, and the constant as the last number. labelled: a small table, gathered in one row."""
    host, path = host_and_path(url_col)
    rows = labelled.where(F.col(label_col).isNotNull()).select(host.alias("h"), path.alias("p"), F.col(label_col).cast("double").alias("y"))
    rows = rows.select("y", F.expr(ngrams("h", "p")).alias("grams"))
    scratch = Scratch(labelled.sparkSession, "url-filter")
    row = scratch.write(rows.agg(F.sort_array(F.collect_list(F.struct("grams", "y"))).alias("all")), "examples")
    # For each bucket the examples that have it, all buckets in one array.
    having = row.select(F.posexplode("all").alias("i", "e")).select("i", F.explode("e.grams").alias("bucket")).groupBy("bucket").agg(F.sort_array(F.collect_list("i")).alias("has"))
    having = labelled.sparkSession.range(DIMENSIONS).select(F.col("id").cast("int").alias("bucket")).join(having, "bucket", "left").select("bucket", F.coalesce("has", F.array().cast("array<int>")).alias("has"))
    post = having.agg(F.sort_array(F.collect_list(F.struct("bucket", "has"))).alias("post")).select(F.expr("transform(post, x -> x.has)").alias("post"), F.lit(1).alias("k"))
    both = row.select(F.size("all").alias("n"), F.expr("transform(all, e -> e.grams)").alias("feats"), F.expr("transform(all, e -> e.y)").alias("ys"), F.lit(1).alias("k")).join(post, "k")
    both = scratch.write(both.where("n > 0"), "table")  # written, so that no step below is worked out again for each element
    scale = "(1D / sqrt(size(feats[i])))"
    gap = f"transform(feats, (f, i) -> ys[i] - 1D / (1D + exp(-(s.b + {scale} * aggregate(f, 0D, (z, j) -> z + s.w[j])))))"
    step = (
        f"transform(array({gap}), e -> named_struct('w', transform(s.w, (x, j) -> x * {1 - RATE * DECAY!r}D + {RATE!r}D / n * aggregate(post[j], 0D, (z, i) -> z + e[i] * {scale})), "
        f"'b', s.b + {RATE!r}D / n * aggregate(e, 0D, (z, x) -> z + x)))[0]"
    )
    fitted = both.select(F.expr(f"aggregate(sequence(1, {STEPS}), named_struct('w', array_repeat(0D, {DIMENSIONS}), 'b', 0D), (s, t) -> {step})").alias("m")).first()
    return [*fitted["m"]["w"], fitted["m"]["b"]] if fitted else [0.0] * DIMENSIONS + [-1.0]


def judge(pages: DataFrame, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """id, host, path, rule, verdict, score (the model's probability of block; null where a rule decides)."""
    spark = pages.sparkSession
    labelled = seed_table(spark) if labelled is None else labelled
    weights = train(labelled)
    host, path = host_and_path(url_col)
    named = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    constant = F.split(F.lit(",".join(f"{w:.9g}" for w in weights[:-1])), ",").cast("array<double>")
    ruled = named.withColumn("rule", rule).withColumn("_verdict", verdict)
    buckets = F.expr(ngrams("host", "path"))
    total = F.aggregate(buckets, F.lit(0.0), lambda z, b: z + F.get(constant, b)) / F.sqrt(F.size(buckets).cast("double")) + F.lit(weights[-1])
    score = F.when(F.col("rule").isNull(), F.round(1 / (1 + F.exp(-total)), 6))
    scored = ruled.withColumn("score", score)
    return scored.select(id_col, "host", "path", "rule", F.coalesce("_verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))

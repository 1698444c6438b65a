"""Queries of retrieval and quotation over the documents, benchmark and embeddings tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritext.functions.lexicon import COMMONPLACE, MAX_IDF
from veritext.functions.text import SQL_FOLDED, SQL_RAW, SQL_TOKENS, folded, tokens
from veritext.operators import contrary, corpus, retrieval
from veritext.sources.readers import table

#: The proposition that the search queries look for.
PROPOSITION = "thation onthe ereat shand tionhe inent"
NEAR = ("the", "to", "is")
QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _bm25_sql(tokens_sql: str, idf: str, k1: float, b: float, top: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, {tokens_sql.format('text')} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
q AS (SELECT DISTINCT unnest({tokens_sql.format("'" + PROPOSITION + "'")}) AS term), p AS (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM d),
t AS (SELECT doc_id, l, term, count(*) AS tf FROM p JOIN q USING (term) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
x AS (SELECT doc_id, sum({idf} * tf * {k1 + 1} / (tf + {k1} * (1 - {b} + {b} * l / a))) AS score FROM t JOIN f USING (term), s GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score, rank FROM (SELECT doc_id, score, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM x WHERE score > 0) WHERE rank <= {top}
"""


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, PROPOSITION)], "query_id int, query string")


@query("lexical_search", _bm25_sql(SQL_TOKENS, "greatest(0, ln(1 + (n - df + 0.5) / (df + 0.5)))", 1.5, 0.75, 20))
def lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.bm25(table(spark, sf, "documents"), _asked(spark), 20).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query("bm25_fts_variant", _bm25_sql(SQL_RAW, "greatest(1e-6, ln((n - df + 0.5) / (df + 0.5)))", 1.2, 0.75, 20))
def bm25_fts_variant(spark, sf):
    return retrieval.bm25_fts(table(spark, sf, "documents"), _asked(spark), 20).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


_NEAR_SQL = f"""
SELECT doc_id, count(*) AS n_hits FROM (
  SELECT doc_id, {', '.join(f"max(CASE WHEN term = '{t}' THEN 1 ELSE 0 END) OVER w AS t{i}" for i, t in enumerate(NEAR))}
  FROM (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT doc_id, {SQL_RAW.format('text')} AS w FROM documents)) WHERE term IN {NEAR}
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos RANGE BETWEEN CURRENT ROW AND 13 FOLLOWING)
) WHERE {' AND '.join(f't{i} = 1' for i in range(len(NEAR)))} GROUP BY doc_id
"""


@query("proximity_near", _NEAR_SQL)
def proximity_near(spark, sf):
    return retrieval.near(table(spark, sf, "documents"), list(NEAR)).select(F.col("id").alias("doc_id"), "n_hits")


def _vector(spark, sf, key: int) -> DataFrame:
    return table(spark, sf, "embeddings").where(F.col("vec_id") == key).select(F.col("vec_id").cast("int").alias("query_id"), F.col("embedding").alias("vector"))


@query("dense_topk", """
SELECT v.vec_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id = 0 ORDER BY 2 DESC, 1 LIMIT 10
""")
def dense_topk(spark, sf):
    return retrieval.dense(table(spark, sf, "embeddings"), _vector(spark, sf, 0), 10).select(F.col("id").alias("vec_id"), "score")


@query("dense_topk_per_label", """
SELECT label, vec_id, score FROM (SELECT v.label, v.vec_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id = 0)
QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) <= 3
""")
def dense_topk_per_label(spark, sf):
    v, q = table(spark, sf, "embeddings"), _vector(spark, sf, 0)
    scored = v.join(F.broadcast(q), F.lit(True)).select("label", "vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("vector")), 6).alias("score"))
    return scored.withColumn("_n", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "vec_id"))).where("_n <= 3").drop("_n")


_LEX, _NEARBY = ORACLE_SQL["lexical_search"].replace("rank <= 20", "rank <= 120"), _NEAR_SQL


@query("rrf_fusion", f"""
WITH a AS ({_LEX}), n AS ({_NEARBY}), b AS (SELECT doc_id, row_number() OVER (ORDER BY n_hits DESC, doc_id) AS rank FROM n QUALIFY rank <= 40),
c AS (SELECT v.vec_id AS doc_id, row_number() OVER (ORDER BY round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) DESC, v.vec_id) AS rank FROM embeddings v, embeddings q WHERE q.vec_id = 0 QUALIFY rank <= 120),
r AS (SELECT 0 AS k, doc_id, rank FROM a UNION ALL SELECT 1, doc_id, rank FROM b UNION ALL SELECT 2, doc_id, rank FROM c)
SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, round(1000 * sum(1.0::DOUBLE / (60 + rank)) / (SELECT count(DISTINCT k) FROM r), 6) AS relevance FROM r GROUP BY doc_id
""")
def rrf_fusion(spark, sf):
    docs = table(spark, sf, "documents")
    lexical = retrieval.bm25(docs, _asked(spark), 120).select(F.lit(0).alias("ranker"), F.col("id").alias("item"), "rank")
    best = retrieval.near(docs, list(NEAR)).orderBy(F.desc("n_hits"), "id").limit(40)
    near = best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n_hits"), "id"))).select(F.lit(1).alias("ranker"), F.col("id").alias("item"), "rank")
    dense = retrieval.dense(table(spark, sf, "embeddings"), _vector(spark, sf, 0), 120).select(F.lit(2).alias("ranker"), F.col("id").alias("item"), "rank")
    fused = retrieval.fuse(lexical.unionByName(near).unionByName(dense))
    return fused.select(F.col("item").alias("doc_id"), F.round("score", 9).alias("score"), F.round("relevance", 6).alias("relevance"))


_WEIGHTS = f"""
SELECT term, df, least({MAX_IDF}, ln((SELECT count(*) FROM documents) / (1 + df)::DOUBLE)) AS weight FROM (
  SELECT q.term, count(h.term) AS df FROM (SELECT DISTINCT unnest({SQL_TOKENS.format("'" + PROPOSITION + " nosuchword'")}) AS term) q
  LEFT JOIN (SELECT unnest(list_distinct({SQL_TOKENS.format('text')})) AS term FROM documents) h ON h.term = q.term GROUP BY q.term)
"""


def _terms(spark) -> DataFrame:
    return spark.range(1).select(F.explode(F.array_distinct(tokens(F.lit(PROPOSITION + " nosuchword")))).alias("term"))


@query("term_weights_idf", f"SELECT term, df, round(weight, 6) AS weight FROM ({_WEIGHTS})")
def term_weights_idf(spark, sf):
    return retrieval.idf_weights(table(spark, sf, "documents"), _terms(spark)).select("term", "df", F.round("weight", 6).alias("weight"))


@query("weighted_overlap", f"""
WITH w AS ({_WEIGHTS}), t AS (SELECT sum(weight) AS total FROM w), h AS (SELECT doc_id, unnest(list_distinct({SQL_TOKENS.format('text')})) AS term FROM documents)
SELECT doc_id, round(sum(weight) / max(total), 6) AS share FROM h JOIN w USING (term), t GROUP BY doc_id HAVING sum(weight) / max(total) >= 0.02
""")
def weighted_overlap(spark, sf):
    docs = table(spark, sf, "documents")
    w = retrieval.idf_weights(docs, _terms(spark))
    total = w.agg(F.sum("weight").alias("total"))
    held = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).join(w, "term")
    share = held.groupBy("doc_id").agg(F.sum("weight").alias("s")).join(F.broadcast(total), F.lit(True)).select("doc_id", (F.col("s") / F.col("total")).alias("share"))
    return share.where("share >= 0.02").select("doc_id", F.round("share", 6).alias("share"))


@query("quote_containment", f"""
SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains({SQL_FOLDED.format('d.text')}, {SQL_FOLDED.format('b.text')})
""")
def quote_containment(spark, sf):
    """Exact quotations of any length, also those that start or end inside a word."""
    quotes = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote"))
    return contrary.contained(quotes, table(spark, sf, "documents").select("doc_id", "text"))


@query("best_line", f"""
WITH q AS (SELECT list_distinct({SQL_TOKENS.format("'" + PROPOSITION + " the and with that'")}) AS w), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
s AS (SELECT doc_id, line_no, len(list_intersect({SQL_TOKENS.format('line')}, q.w)) AS overlap, len({SQL_TOKENS.format('line')}) AS n FROM l, q)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(overlap AS INTEGER) AS overlap FROM s WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY overlap + round(overlap / n::DOUBLE, 9) DESC, line_no) = 1
""")
def best_line(spark, sf):
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return retrieval.best_line(lines, PROPOSITION + " the and with that").select(F.col("id").alias("doc_id"), "line_no", "overlap")


@query("one_per_group_search", f"""
WITH a AS ({ORACLE_SQL['lexical_search'].replace('rank <= 20', 'rank <= 120')}) SELECT source, doc_id, score FROM a JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY source ORDER BY rank) = 1
""")
def one_per_group_search(spark, sf):
    docs = table(spark, sf, "documents")
    found = retrieval.bm25(docs, _asked(spark), 120).join(docs.select(F.col("doc_id").alias("id"), "source"), "id")
    return retrieval.first_of_group(found, "source", F.col("rank")).select("source", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("authority_score", """
SELECT o_orderkey, round(o_totalprice / 1000 + 0.06 * least(CAST(substr(o_orderpriority, 1, 1) AS INTEGER), 13) + 0.02 * (year(o_orderdate) - 1950) / 76.0, 3) AS score FROM orders ORDER BY score DESC, o_orderkey LIMIT 50
""")
def authority_score(spark, sf):
    o = table(spark, sf, "orders")
    bonus = retrieval.authority_bonus(F.substring("o_orderpriority", 1, 1).cast("int"), F.year("o_orderdate"))
    return o.select("o_orderkey", F.round(F.col("o_totalprice") / 1000 + bonus, 3).alias("score")).orderBy(F.desc("score"), "o_orderkey").limit(50)


@query("fts_query_terms", f"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter({SQL_TOKENS.format('text')}, lambda t: len(t) > 2))), ' OR ') AS query FROM benchmark")
def fts_query_terms(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.array_sort(retrieval.fts_terms(F.col("text"))), " OR ").alias("query"))


_BEST_SQL = ORACLE_SQL["best_line"].replace(" the and with that'", " the and that'")


@query("find_authorities", f"""
WITH fused AS ({ORACLE_SQL["rrf_fusion"]}), voiced AS (SELECT f.doc_id, f.relevance, d.source, d.text FROM fused f JOIN documents d USING (doc_id) WHERE NOT regexp_matches(d.text, 'Learned counsel')),
prior AS (SELECT doc_id, source, relevance + CASE WHEN text LIKE '%held%' THEN 1.0 ELSE 0.0 END AS relevance FROM voiced),
one AS (SELECT * FROM prior QUALIFY row_number() OVER (PARTITION BY source ORDER BY relevance DESC, doc_id) = 1),
b AS ({_BEST_SQL})
SELECT one.doc_id, source, round(relevance, 3) AS score, line_no, coalesce(quality = 0, false) AS doubtful FROM one LEFT JOIN b USING (doc_id) LEFT JOIN labels USING (doc_id) ORDER BY doubtful, score DESC, doc_id LIMIT 5
""")
def find_authorities(spark, sf):
    """Fused search over the words, NEAR and vectors, counsel's words left out, a prior for holdings, one result per source with its best line, doubtful ones last."""
    docs = table(spark, sf, "documents")
    met = rrf_fusion(spark, sf).join(docs, "doc_id").where(~F.col("text").rlike("Learned counsel"))
    met = met.withColumn("relevance", F.col("relevance") + F.when(F.contains("text", F.lit("held")), 1.0).otherwise(0.0))
    labels = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 0).alias("doubtful"))
    # One of a source and five of all first: only their lines are read.
    one = retrieval.first_of_group(met, "source", F.desc("relevance"), F.col("doc_id")).join(labels, "doc_id", "left").withColumn("doubtful", F.coalesce("doubtful", F.lit(False)))
    top = one.withColumn("score", F.round("relevance", 3)).orderBy("doubtful", F.desc("score"), "doc_id").limit(5)
    lines = top.select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    best = retrieval.best_line(lines, PROPOSITION + " the and that").select(F.col("id").alias("doc_id"), "line_no")
    return top.join(best, "doc_id", "left").select("doc_id", "source", "score", "line_no", "doubtful")


@query("longest_shared_run")
def longest_shared_run(spark, sf):
    claims = table(spark, sf, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim"))
    return contrary.shared_runs(claims, table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")).select("claim_id", "id", "words")


#: Passages beside the documents: one opposes the proposition, the others must be passed over.
_OPPOSED = "A notice served on the tenant is mandatory in a suit of eviction"
_VOICES = [
    (-1, "The matter is old. A notice served on the tenant is not mandatory in a suit of eviction."), (-2, "Whether a notice served on the tenant is not mandatory in a suit of eviction?"),
    (-3, "A notice served on the appellant tenant is not mandatory in a suit of eviction."), (-4, "It was said that \u201ca rule. A notice served on the tenant is not mandatory in a suit of eviction. So it is\u201d once."), (-5, "A notice served on the tenant is mandatory in a suit of eviction."),
]


@query("contrary_search")
def contrary_search(spark, sf):
    """Of the documents and a few passages on one point, the sentence that opposes it."""
    own = spark.createDataFrame(_VOICES, "doc_id long, text string")
    return contrary.find_contrary(table(spark, sf, "documents").select("doc_id", "text").unionByName(own), _OPPOSED)


@query("candidate_pool_union", f"""
WITH a AS ({ORACLE_SQL['lexical_search'].replace('rank <= 20', 'rank <= 120')}), n AS ({_NEAR_SQL}) SELECT doc_id, min(k) AS found_by FROM (SELECT doc_id, 0 AS k FROM a UNION ALL SELECT doc_id, 1 FROM n) GROUP BY doc_id
""")
def candidate_pool_union(spark, sf):
    docs = table(spark, sf, "documents")
    pool = retrieval.bm25(docs, _asked(spark), 120).select("id", F.lit(0).alias("k")).unionByName(retrieval.near(docs, list(NEAR)).select("id", F.lit(1).alias("k")))
    return pool.groupBy(F.col("id").alias("doc_id")).agg(F.min("k").alias("found_by"))


@query("shared_terms", f"""
SELECT a.item_id, array_to_string(list_sort(list_intersect(list_distinct({SQL_TOKENS.format('a.text')}), list_distinct({SQL_TOKENS.format('b.text')}))), ' ') AS shared, CAST(len(list_filter(list_distinct({SQL_TOKENS.format('a.text')}), lambda t: NOT list_contains({SQL_TOKENS.format('b.text')}, t))) AS INTEGER) AS n_only
FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1
""")
def shared_terms(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.array_distinct(tokens(F.col("text"))).alias("w"))
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("o"))
    return b.join(other, "item_id").select("item_id", F.array_join(F.array_sort(F.array_intersect("w", "o")), " ").alias("shared"), F.size(F.array_except("w", "o")).alias("n_only"))


@query("document_frequency", f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({SQL_TOKENS.format('text')})) AS term FROM documents) GROUP BY term")
def document_frequency(spark, sf):
    return table(spark, sf, "documents").select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query("word_counts", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS INTEGER) AS n_words, sha256(text) AS sha256 FROM documents")
def word_counts(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("version"), "text")
    return corpus.text_versions(d).select(F.col("version").alias("doc_id"), "n_words", "sha256")


@query("distinctive_terms", f"SELECT item_id, array_to_string(list_sort(list_filter(list_distinct({SQL_TOKENS.format('text')}), lambda t: len(t) > 2 AND t NOT IN ({', '.join(repr(w) for w in COMMONPLACE)}))), ' ') AS terms FROM benchmark")
def distinctive_terms(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.array_sort(F.filter(F.array_distinct(tokens(F.col("text"))), lambda t: (F.length(t) > 2) & ~t.isin(*COMMONPLACE))), " ").alias("terms"))

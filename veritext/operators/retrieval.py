"""Retrieval: inverted index, BM25, proximity, dense vectors, rank fusion and what is built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritext.functions.lexicon import B, BENCH_WEIGHT, CANDIDATES, FIRST_YEAR, FTS_B, FTS_FLOOR, FTS_K1, FUSION_SCALE, K1, MAX_IDF, NEAR_WINDOW, RECENCY_WEIGHT, RRF_K
from veritext.functions.text import raw_tokens, tokens


#: Results that each ranker gives to fusion.
POOL = CANDIDATES


def inverted_index(docs: DataFrame, id_col: str, terms: Column, only: DataFrame | None = None) -> DataFrame:
    """Postings id, term, tf, len. only: a table of terms; others are dropped before the shuffle, their length counted."""
    base = docs.select(F.col(id_col).alias("id"), terms.alias("terms")).withColumn("len", F.size("terms"))
    rows = base.select("id", "len", F.explode("terms").alias("term"))
    if only is not None:
        rows = rows.join(only.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("id", "term", "len").agg(F.count(F.lit(1)).alias("tf"))


def matched_terms(docs: DataFrame, id_col: str, terms: Column, wanted: DataFrame) -> DataFrame:
    """id, len (all terms), hits (term, tf of wanted terms): what scoring needs of a text, dealt by id so that several steps share one pass.

    wanted: one row with an array of terms."""
    base = docs.select(F.col(id_col).alias("id"), terms.alias("terms")).join(F.broadcast(wanted), F.lit(True))
    found = base.select("id", F.size("terms").alias("len"), F.filter("terms", lambda t: F.array_contains("wanted", t)).alias("found"))
    hits = F.transform(F.array_distinct("found"), lambda t: F.struct(t.alias("term"), F.size(F.filter("found", lambda x: x == t)).alias("tf")))
    return found.select("id", F.greatest("len", F.lit(0)).alias("len"), F.coalesce(hits, F.array().cast("array<struct<term:string,tf:int>>")).alias("hits")).repartition("id")


def bm25(docs: DataFrame, queries: DataFrame, top: int | None = 20, id_col: str = "doc_id", text_col: str = "text", k1: float = K1, b: float = B, variant: str = "plain") -> DataFrame:
    """query_id, id, score, rank: documents by BM25. queries: query_id, query.

    plain: stop words dropped, inverse frequency floored at 0. fts: all tokens, inverse frequency ln((N-n+.5)/(n+.5)) floored at a small positive value."""
    of = tokens if variant == "plain" else raw_tokens
    wanted = queries.select("query_id", F.explode(F.array_distinct(of(F.col("query")))).alias("term"))
    held = matched_terms(docs, id_col, of(F.col(text_col)), wanted.agg(F.collect_set("term").alias("wanted")))
    # One aggregate gives every term's document frequency, and under the null term the number and length of documents.
    stats = held.select("id", "len", F.explode_outer(F.concat(F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).alias("tf"))), "hits")).alias("h"))
    stats = stats.groupBy(F.col("h.term").alias("term")).agg(F.count("id").alias("df"), F.sum("len").alias("total"))
    whole = Window.partitionBy(F.lit(0))  # over a row a term
    stats = stats.withColumn("n", F.max(F.when(F.col("term").isNull(), F.col("df"))).over(whole)).withColumn("avg_len", F.max(F.when(F.col("term").isNull(), F.col("total") / F.col("df"))).over(whole))
    odds = (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    idf = F.greatest(F.lit(0.0), F.log(1 + odds)) if variant == "plain" else F.greatest(F.lit(FTS_FLOOR), F.log(odds))
    terms = wanted.join(stats, "term").withColumn("idf", idf)
    post = held.select("id", "len", F.explode_outer("hits").alias("h")).select("id", "len", "h.term", "h.tf")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = post.join(terms, "term").groupBy("query_id", "id").agg(F.sum(part).alias("score")).where("score > 0")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


#: Folders that the postings of a batch are dealt over by term.
BUCKETS = 64


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> None:
    """An inverted index on disk, from nothing: see add_to_index."""
    for part in ("postings", "figures"):  # an index that stood there goes
        target = docs.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
        target.getFileSystem(docs.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
    add_to_index(docs, path, 0, id_col, text_col, buckets)


def add_to_index(docs: DataFrame, path: str, batch: int, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> None:
    """Adds documents to an index as one batch: postings in folders by a hash of the term, sorted by term, and the batch's figures.

    A batch that is written again replaces itself. A bucket is cut into slices by document, as many as the shuffle has
    partitions to spare, so frequent terms and large corpora are more tasks and not larger ones. A search reads the
    folders of its terms only, and of those the row groups that hold them."""
    spark = docs.sparkSession
    slices = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
    post = inverted_index(docs, id_col, tokens(F.col(text_col))).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)))
    dealt = post.repartition(slices * buckets, "bucket", "slice").drop("slice") if slices > 1 else post.drop("slice").repartition("bucket")
    dealt.sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")
    figures = docs.select(F.greatest(F.size(tokens(F.col(text_col))), F.lit(0)).alias("len")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"), F.lit(buckets).alias("buckets"))
    figures.write.mode("overwrite").parquet(f"{path}/figures/batch={batch}")


def search_index(spark: SparkSession, path: str, queries: DataFrame, top: int = 20, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, id, score, rank: the same as bm25, from an index. The terms of the queries, a stated set, prune the read."""
    wanted = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    figures = spark.read.parquet(f"{path}/figures").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("buckets").alias("buckets")).first()
    asked = wanted.select("term", F.pmod(F.xxhash64("term"), F.lit(figures["buckets"])).cast("int").alias("bucket")).distinct().collect()
    post = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin([r["bucket"] for r in asked]) & F.col("term").isin([r["term"] for r in asked]))
    freq = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.lit(0.0), F.log(1 + (figures["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = figures["total"] / figures["n"] if figures["n"] and figures["total"] else 1.0
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / mean))
    scored = post.join(freq.join(wanted, "term"), "term").groupBy("query_id", "id").agg(F.sum(part).alias("score")).where("score > 0")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))).where(F.col("rank") <= top)


def bm25_fts(docs: DataFrame, queries: DataFrame, top: int | None = 20, **cols: str) -> DataFrame:
    return bm25(docs, queries, top, k1=FTS_K1, b=FTS_B, variant="fts", **cols)


def near(docs: DataFrame, terms: list[str], window: int = NEAR_WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_hits: documents in which all terms stand within so many tokens of each other, counting all tokens."""
    # Only documents that hold all terms, and of these only the places of the terms, leave the scan.
    held = docs.select(F.col(id_col).alias("id"), raw_tokens(F.col(text_col)).alias("all"))
    for t in dict.fromkeys(terms):
        held = held.where(F.array_contains("all", t))
    spots = F.filter(F.transform("all", lambda t, i: F.struct(i.alias("pos"), t.alias("term"))), lambda x: x["term"].isin(*terms))
    placed = held.select("id", F.inline(spots))
    ahead = Window.partitionBy("id").orderBy("pos").rangeBetween(0, window + 1)
    for i, t in enumerate(terms):
        placed = placed.withColumn(f"t{i}", F.max((F.col("term") == t).cast("int")).over(ahead))
    every = " and ".join(f"t{i} = 1" for i in range(len(terms)))
    return placed.where(every).groupBy("id").agg(F.count(F.lit(1)).alias("n_hits"))


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two vectors in double precision; 0 if one has no length."""
    a, b = left.cast("array<double>"), right.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda z, v: z + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


#: Query vectors that are broadcast together.
QUERY_BLOCK = 4096


def dense(vectors: DataFrame, queries: DataFrame, top: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, id, score, rank by exact cosine. queries: query_id, vector; a stated set, of which at most QUERY_BLOCK ship to all vectors at once."""
    held = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    n = queries.count()
    if n > QUERY_BLOCK:
        parts = -(-n // QUERY_BLOCK) * 2  # twice as many as needed: blocks by a hash differ in size
        blocks = [dense(vectors, queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k), top, id_col, vector_col) for k in range(parts)]
        out = blocks[0]
        for more in blocks[1:]:
            out = out.unionByName(more)
        return out
    scored = held.join(F.broadcast(queries), F.lit(True)).select("query_id", "id", F.round(cosine(F.col("v"), F.col("vector")), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= top)


def fuse(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """item, score, relevance: reciprocal rank fusion of (ranker, item, rank). Ties go to the item seen first, ranker by ranker."""
    n = rankings.select("ranker").distinct().agg(F.count(F.lit(1)).alias("n"))
    fused = rankings.groupBy("item").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("ranker", "rank")).alias("first"))
    fused = fused.join(F.broadcast(n), F.lit(True)).withColumn("relevance", FUSION_SCALE * F.col("score") / F.col("n"))
    return fused.select("item", "score", "relevance", "first")


def idf_weights(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, df, weight: at most MAX_IDF, and as ln(N / (1 + df)) below; negative for terms that almost all hold."""
    held = docs.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    freq = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    out = terms.select("term").distinct().join(freq, "term", "left").join(F.broadcast(n), F.lit(True)).withColumn("df", F.coalesce("df", F.lit(0).cast("long")))
    return out.select("term", "df", F.least(F.lit(MAX_IDF), F.log(F.col("n") / (1 + F.col("df")))).alias("weight"))


def best_line(lines: DataFrame, query: str) -> DataFrame:
    """id, line_no, line, overlap: the line of each document that shares most terms with the query, the first of equals."""
    wanted = F.array_distinct(tokens(F.lit(query)))
    overlap = F.size(F.array_intersect(tokens(F.col("line")), wanted))
    scored = lines.withColumn("overlap", overlap).withColumn("density", F.try_divide(F.col("overlap").cast("double"), F.size(tokens(F.col("line"))))).where("overlap > 0")
    best = scored.groupBy("id").agg(F.max_by(F.struct("line_no", "line", "overlap"), F.struct(F.col("overlap") + F.round("density", 9), -F.col("line_no"))).alias("b"))
    return best.select("id", "b.line_no", "b.line", "b.overlap")


def authority_bonus(bench: Column, year: Column, now: int = 2026) -> Column:
    """What a larger bench and a later year add to relevance."""
    return BENCH_WEIGHT * F.least(F.coalesce(bench, F.lit(0)), F.lit(13)) + F.when(year.isNotNull(), RECENCY_WEIGHT * (year - FIRST_YEAR) / (now - FIRST_YEAR)).otherwise(0.0)


def first_of_group(df: DataFrame, group: str, *order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_n = 1").drop("_n")


def fts_terms(query: Column) -> Column:
    """Terms of an OR query: longer than two characters, each once."""
    return F.array_distinct(F.filter(tokens(query), lambda t: F.length(t) > 2))


def near_starts(n_terms: int, run: int, most: int) -> list[int]:
    """Evenly spaced starts of runs of terms for proximity queries."""
    last = n_terms - run
    if last < 0:
        return []
    count = min(most, last + 1)
    return sorted({int(i * last / max(1, count - 1)) for i in range(count)})

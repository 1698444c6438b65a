"""The eight questions of the query API, as functions from tables to DataFrames.

A corpus is a dict of DataFrames: judgments (case, title, court, bench,
decided_on), aliases (case, reporter, citation, normalized), paragraphs (case,
version, seq, label, body), edges (edge_id, citing, cited, treatment,
citing_date), and maybe opinions (version, kind, seq_start, seq_end) and
vectors (case, version, seq, embedding). Every result is a plan; on the way to
one, only figures of the question's own terms are collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritext.functions.citations import extract
from veritext.functions.kernels import flat_map
from veritext.functions.reading import distinctive, voice
from veritext.operators import citator, contrary, corpus, resolve, retrieval, verdict

Corpus = dict[str, DataFrame]


def corpus_status(c: Corpus) -> DataFrame:
    """court, judgments, first and last decision; a court of null is unrecorded."""
    return c["judgments"].groupBy(F.coalesce("court", F.lit("unrecorded")).alias("court")).agg(F.count(F.lit(1)).alias("judgments"), F.min("decided_on").alias("first_decision"), F.max("decided_on").alias("last_decision"))


def resolve_citation(c: Corpus, citation: str) -> DataFrame:
    """normalized, parties, status, case, title, mismatch of the citations in a text; by alias, else by party names."""
    spark = c["aliases"].sparkSession
    rows = [(k, x["normalized"], x["parties"], x["year"]) for k, x in enumerate(extract(citation))]
    asked = spark.createDataFrame(rows, "citation_id int, normalized string, parties string, year int")
    found = resolve.exact(asked, c["aliases"]).drop("status")
    titles = c["judgments"].select("case", "title", F.year("decided_on").alias("title_year"))
    named = found.where("case is null and parties is not null").select(F.col("citation_id").alias("name_id"), F.col("parties").alias("name"), "year")
    by_name = resolve.by_parties(named, titles).where("status <> 'not_found'").select(F.col("name_id").alias("citation_id"), F.col("case").alias("named_case"), F.col("status").alias("name_status"))
    met = found.join(by_name, "citation_id", "left")
    method = F.when(F.col("case").isNotNull(), "exact").when(F.col("named_case").isNotNull(), "party_name")
    status = F.when(F.col("case").isNotNull(), "found").otherwise(F.coalesce("name_status", F.lit("not_found")))
    out = met.withColumn("method", method).withColumn("status", status).withColumn("case", F.coalesce("case", F.when(F.col("name_status") == "found", F.col("named_case")))).join(titles.select("case", "title"), "case", "left")
    return resolve.name_mismatch(out).select("citation_id", "normalized", "parties", "status", "method", "case", "title", "mismatch")


def check_treatment(c: Corpus, case: str) -> DataFrame:
    """case, status, citing_count, is_unchecked, is_doubtful."""
    return citator.standing(c["judgments"].where(F.col("case") == case).select("case"), c["edges"])


def _keyed(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with a key of case, version and number."""
    return paragraphs.withColumn("pid", F.struct("case", "version", "seq"))


def locate_paragraph(c: Corpus, case: str, claim: str, pinpoint: str | None = None, top: int = 8) -> DataFrame:
    """version, seq, label, score, claimed: the paragraphs of a case's preferred version closest to a claim, and the claimed one; the first of each label.

    The preferred version is the one marked so (column preferred, if there is one), else the smallest."""
    rows = c["paragraphs"].where(F.col("case") == case)
    preferred = F.col("preferred") if "preferred" in rows.columns else F.lit(False)
    version = rows.groupBy("version").agg(F.max(F.coalesce(preferred, F.lit(False))).alias("preferred")).orderBy(F.desc("preferred"), "version").limit(1).select("version")
    rows = rows.join(version, "version", "left_semi")
    own = _keyed(rows.withColumn("_n", F.row_number().over(Window.partitionBy("version", F.coalesce("label", F.concat(F.lit("#"), F.col("seq").cast("string")))).orderBy("seq"))).where("_n = 1").drop("_n"))
    asked = rows.sparkSession.createDataFrame([(0, claim)], "query_id int, query string")
    ranked = retrieval.bm25(own, asked, top, "pid", "body").select(F.col("id").alias("pid"), "score")
    claimed = F.coalesce(verdict.covers(F.lit(pinpoint), F.col("label")), F.lit(False))
    out = own.join(ranked, "pid", "left").withColumn("claimed", claimed).where("score is not null or claimed")
    return out.select("version", "seq", "label", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"), "claimed").orderBy(F.desc("score"), "seq")


def with_voice(c: Corpus, paragraphs: DataFrame) -> DataFrame:
    """Paragraphs (case, version, seq, body) with voice: whose words each carries, given its opinion (table opinions, if the corpus has one; the majority otherwise)."""
    kind = F.lit("majority")
    rows = paragraphs.select("case", "version", "seq", "body")
    if "opinions" in c:
        rows = rows.join(corpus.in_opinions(rows.select("version", "seq"), c["opinions"]), ["version", "seq"], "left")
        kind = F.coalesce("kind", F.lit("majority"))

    def said(r):
        yield {"case": r["case"], "version": r["version"], "seq": r["seq"], "voice": voice(r["body"] or "", r["kind"])["voice"]}

    found = flat_map(rows.select("case", "version", "seq", "body", kind.alias("kind")), said, "case string, version string, seq int, voice string")
    return paragraphs.join(found, ["case", "version", "seq"])


#: Voices that are the court's own.
OWN_VOICES = ("court_majority", "court_concurring", "unclear")


def verify_brief(c: Corpus, text: str) -> DataFrame:
    """raw, grade, modes, needs_review, support of every citation of a brief."""
    brief = c["aliases"].sparkSession.createDataFrame([(1, text)], "brief_id int, text string")
    return contrary.verify_brief(brief, c["aliases"], c["judgments"].select("case", "title", "court", "bench"), citator.standing(c["judgments"].select("case"), c["edges"]))


def find_authority(c: Corpus, proposition: str, top: int = 5, vector: list[float] | None = None) -> DataFrame:
    """case, version, seq, label, line, score, status, voice: one paragraph a case by relevance and authority, doubtful cases last.

    Fuses BM25, proximity runs of the proposition's terms and, where the corpus has a table vectors (case, version, seq,
    embedding) and a query vector is given, cosine. Paragraphs in counsel's, another court's or a dissent's words are left out."""
    p = _keyed(c["paragraphs"])
    spark = p.sparkSession
    asked = spark.createDataFrame([(0, proposition)], "query_id int, query string")
    rankings = retrieval.bm25(p, asked, retrieval.POOL, "pid", "body").select(F.lit(0).alias("ranker"), F.col("id").alias("item"), "rank")
    terms = sorted(distinctive(proposition), key=lambda t: proposition.lower().find(t))
    for start in retrieval.near_starts(len(terms), NEAR_RUN, NEAR_QUERIES):
        hits = retrieval.near(p, terms[start : start + NEAR_RUN], id_col="pid", text_col="body").orderBy(F.desc("n_hits"), "id").limit(retrieval.POOL)
        placed = hits.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n_hits"), "id")))
        rankings = rankings.unionByName(placed.select(F.lit(1 + start).alias("ranker"), F.col("id").alias("item"), "rank"))
    if vector is not None and "vectors" in c:
        of = spark.createDataFrame([(0, vector)], "query_id int, vector array<double>")
        near = retrieval.dense(_keyed(c["vectors"]), of, retrieval.POOL, "pid", "embedding")
        rankings = rankings.unionByName(near.select(F.lit(1000).alias("ranker"), F.col("id").alias("item"), "rank"))
    fused = retrieval.fuse(rankings).select(F.col("item").alias("pid"), "relevance")
    prior = F.when(corpus.role(F.col("body"), F.lit(False)) == "ratio", 1.0).when(corpus.role(F.col("body"), F.lit(False)).isin("precedent_relied", "analysis"), 0.5).otherwise(0.0)
    met = with_voice(c, p.join(fused, "pid")).where(F.col("voice").isin(*OWN_VOICES))
    met = met.join(c["judgments"].select("case", "bench", F.year("decided_on").alias("year")), "case")
    met = met.withColumn("score", F.round(F.col("relevance") + prior + retrieval.authority_bonus(F.col("bench"), F.col("year")), 3))
    best = retrieval.first_of_group(met, "case", F.desc("relevance"), F.col("version"), F.col("seq")).orderBy(F.desc("score"), "case").limit(top)
    lines = best.select(F.col("pid").alias("id"), F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    line = retrieval.best_line(lines, proposition).select(F.col("id").alias("pid"), "line")
    standing = citator.standing(best.select("case"), c["edges"]).select("case", "status", "is_doubtful")
    return best.join(line, "pid", "left").join(standing, "case").select("case", "version", "seq", "label", "line", "score", "status", "is_doubtful", "voice").orderBy("is_doubtful", F.desc("score"), "case")


#: Terms of a proximity query, and such queries for a proposition.
NEAR_RUN, NEAR_QUERIES = 3, 4


def find_contrary_authority(c: Corpus, proposition: str, top: int = 5, exclude: DataFrame | None = None) -> DataFrame:
    """case, version, seq, sentence, kind, cue, score of passages that oppose a proposition. exclude: cases (column case) that are not asked."""
    p = c["paragraphs"] if exclude is None else c["paragraphs"].join(exclude.select("case").distinct(), "case", "left_anti")
    found = contrary.find_contrary(_keyed(p), proposition, top, "pid", "body")
    return found.select("id.case", "id.version", "id.seq", "sentence", "kind", "cue", "score", "place")


def bind_proposition(c: Corpus, proposition: str, answers: DataFrame | None = None, checked: int = 4) -> DataFrame:
    """case, status of the first authority that passes the gate, else the first unchecked one, else refused.

    answers: case, support, narrowed from whoever read the passages; without them every authority is unchecked."""
    best = find_authority(c, proposition, checked).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("is_doubtful", F.desc("score"), "case")))
    if answers is None:
        answers = best.sparkSession.createDataFrame([], "case string, support string, narrowed string")
    asked = best.join(answers, "case", "left").select(F.col("case").alias("id"), F.lit("found").alias("status"), F.col("voice").isin(*OWN_VOICES).alias("voice_ok"), (~F.col("is_doubtful")).alias("treatment_ok"), "support", "narrowed")
    gated = verdict.gate(asked).withColumnRenamed("id", "case").join(best.select("case", "place"), "case")
    order = F.when(F.col("status").isin("bound", "narrowed"), 0).when(F.col("status") == "unchecked", 1).otherwise(2)
    return gated.orderBy(order, "place").limit(1).select("case", "status")

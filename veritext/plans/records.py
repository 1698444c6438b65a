"""Queries of corpus upkeep, verdicts, evaluation and reading, over the tables and literal fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.functions.citations import SCHEMA as CITATION
from veritext.functions.citations import extract
from veritext.functions.kernels import flat_map
from veritext.functions.lexicon import PREAMBLE, ROLES, cue
from veritext.functions.reading import hierarchy, opposes, treatment, voice, weight
from veritext.functions.structure import clean_pages
from veritext.functions.text import label_value
from veritext.operators import contrary, corpus, resolve, verdict
from veritext.operators.contrary import negate
from veritext.plans.graph import _values
from veritext.sources import readers, writers
from veritext.sources.readers import table
from veritext.streaming import limits

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


# ---- corpus statistics and upkeep


@query("corpus_stats", "SELECT count(*) AS n, count(DISTINCT source) AS sources, (SELECT CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) FROM orders) AS first_day, (SELECT CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) FROM orders) AS last_day FROM documents")
def corpus_stats(spark, sf):
    return corpus.figures(table(spark, sf, "documents"), "source", table(spark, sf, "orders"), "o_orderdate")


@query("by_court", "SELECT coalesce(lang, 'unrecorded') AS court, count(*) AS n FROM documents GROUP BY 1")
def by_court(spark, sf):
    return corpus.by_court(table(spark, sf, "documents").select(F.col("lang").alias("court")))


@query("index_reconcile", """
SELECT doc_id, 'delete' AS action FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE length(text) >= 400) UNION ALL
SELECT doc_id, 'insert' FROM documents WHERE length(text) >= 400 AND doc_id NOT IN (SELECT doc_id FROM labels)
""")
def index_reconcile(spark, sf):
    return corpus.reconcile(table(spark, sf, "labels"), table(spark, sf, "documents").where("length(text) >= 400"), "doc_id")


@query("resume_list", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY n_chars DESC, doc_id LIMIT 100")
def resume_list(spark, sf):
    return corpus.needing_text(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", "n_chars", 100).select("doc_id")


@query("resume_years", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) IN (1995, 1997) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2) ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def resume_years(spark, sf):
    """A page of the work list of some years."""
    have = table(spark, sf, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("o_orderkey"))
    return corpus.needing_text(table(spark, sf, "orders"), have, "o_orderkey", "o_orderdate", 200, [1995, 1997]).select("o_orderkey")


@query("missing_vectors", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def missing_vectors(spark, sf):
    held = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "m1").otherwise("m0").alias("model"))
    return writers.missing_vectors(table(spark, sf, "documents").select("doc_id"), held, "doc_id", "m1")


_CITED_META = [("K1", "(2005) 6 SCC 733; AIR 2005 SC 100"), ("K2", "AIR 1973 SC 1461"), ("K3", None)]


@query("metadata_aliases", f"""
WITH m(canonical_key, citation) AS ({_values(_CITED_META)}), c AS (SELECT canonical_key, trim(unnest(string_split(citation, ';'))) AS raw FROM m)
SELECT canonical_key, CASE WHEN raw LIKE 'AIR%' THEN 'AIR:SC:' || split_part(raw, ' ', 2) || ':' || split_part(raw, ' ', 4) ELSE 'SCC:' || raw[2:5] || ':' || split_part(raw, ' ', 2) || ':' || split_part(raw, ' ', 4) END AS normalized, raw FROM c
""")
def metadata_aliases(spark, sf):
    return corpus.aliases_of(spark.createDataFrame(_CITED_META, "canonical_key string, citation string"))


@query("embeddable", "SELECT doc_id FROM documents WHERE length(text) >= 60 AND source <> 'src1'")
def embeddable(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.lit(True).alias("preferred"), F.when(F.col("source") == "src1", "headnote").alias("kind"), F.col("text").alias("body"))
    return corpus.embeddable(d).select("doc_id")


@query("version_pick", """SELECT o_custkey AS judgment, o_orderkey AS version_key FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderkey) = 1""")
def version_pick(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("judgment"), F.col("o_orderkey").alias("version_key"), (F.col("o_orderstatus") == "F").alias("preferred"))
    return corpus.pick_version(o).select("judgment", "version_key")


@query("repeated_lines", """
WITH p AS (SELECT source, doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents), n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY source)
SELECT source AS doc, line, count(DISTINCT doc_id) AS n FROM p JOIN n USING (source) WHERE line <> '' AND length(line) < 120 AND pages >= 3 GROUP BY source, line, pages HAVING count(DISTINCT doc_id) >= greatest(2, floor(pages * 0.05))
""")
def repeated_lines(spark, sf):
    return corpus.repeated_lines(table(spark, sf, "documents"), "source", "doc_id", "text", share=0.05)


_META = [
    ("A versus", "A", "B", "Hon'ble Mr. Justice Xavier AND Y Rao", "2019 INSC 770", "01-02-2019", "Supreme Court of India", "p1", "2019"), ("P vs Q", "P", "Q", "Justice Zed", "", "2020-03-04", "", "p2", "2020"),
    ("", "M", "N", None, None, "05/06/2021", "Delhi High Court", "p3", "2021"), ("Dup", "", "", "", "2019 INSC 0770", "bad", "Supreme Court of India", "p4", "2019"), ("No key", "", "", "", "", "", "", "", "2018"),
]


@query("metadata_projection")
def metadata_projection(spark, sf):
    meta = spark.createDataFrame(_META, "title string, petitioner string, respondent string, judge string, case_id string, decision_date string, court string, path string, year string")
    return corpus.judgments(meta).select("canonical_key", "title", F.array_join("judges", "|").alias("judges"), "bench_strength", F.col("decided_on").cast("string").alias("decided_on"), "court")


@query("import_new_rows", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")
def import_new_rows(spark, sf):
    held = table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return corpus.new_rows(table(spark, sf, "orders"), held, "o_orderkey").select("o_orderkey")


_OPINIONS = [("v1", "headnote", 0, 0), ("v1", "majority", 1, 4), ("v1", "dissenting", 5, 9), ("v2", "concurring", 3, 6)]


@query("opinion_range_join", f"""
WITH o(version, kind, a, b) AS ({_values(_OPINIONS)}), p AS (SELECT v.version, CAST(s.seq AS INTEGER) AS seq FROM (VALUES ('v1'), ('v2')) v(version), range(0, 11) s(seq))
SELECT p.version, p.seq, coalesce(arg_max(kind, a), 'majority') AS kind FROM p LEFT JOIN o ON o.version = p.version AND seq BETWEEN a AND b AND kind <> 'headnote' GROUP BY ALL
""")
def opinion_range_join(spark, sf):
    p = spark.range(0, 11).select(F.explode(F.array(F.lit("v1"), F.lit("v2"))).alias("version"), F.col("id").cast("int").alias("seq"))
    return corpus.in_opinions(p, spark.createDataFrame(_OPINIONS, "version string, kind string, seq_start int, seq_end int"))


_LABELS = [("v1", 1, "1"), ("v1", 2, "2"), ("v1", 3, "1"), ("v1", 4, "2"), ("v1", 5, "3"), ("v1", 6, "3"), ("v1", 7, "4"), ("v1", 8, "5.1"), ("v1", 9, None)]


@query("first_label", f"WITH p(version, seq, label) AS ({_values(_LABELS)}) SELECT version, label, min(seq) AS seq FROM p WHERE label IS NOT NULL GROUP BY ALL")
def first_label(spark, sf):
    return corpus.first_labels(_labels(spark)).select("version", "label", "seq")


def _labels(spark) -> DataFrame:
    return spark.createDataFrame(_LABELS, "version string, seq int, label string")


@query("out_of_sequence")
def out_of_sequence(spark, sf):
    return corpus.out_of_sequence(_labels(spark))


def _value_sql(label: str) -> str:
    """A label's number, hundredths for the part after the point."""
    return f"(try_cast(split_part({label}, '.', 1) AS INTEGER) + coalesce(try_cast(nullif(split_part({label}, '.', 2), '') AS INTEGER), 0) / 100.0::DOUBLE)"


_CLAIMS = [(1, "v1", None), (2, "v1", "3"), (3, "v1", "2-4"), (4, "v1", "9"), (5, "v1", "5.1"), (6, "v1", "x"), (7, "v9", "3")]


@query("pinpoint_check", f"""
WITH c(claim_id, version, pinpoint) AS ({_values(_CLAIMS)}), p(version, seq, label) AS ({_values(_LABELS)}), n AS (SELECT DISTINCT version, label, {_value_sql("label")} AS v FROM p WHERE label IS NOT NULL),
r AS (SELECT *, {_value_sql("split_part(pinpoint, '-', 1)")} AS low, coalesce({_value_sql("nullif(split_part(pinpoint, '-', 2), '')")}, {_value_sql("split_part(pinpoint, '-', 1)")}) AS high FROM c)
SELECT claim_id, CASE WHEN pinpoint IS NULL THEN 'none_claimed' WHEN bool_or(coalesce(v BETWEEN low AND high OR label = pinpoint, false)) THEN 'ok' WHEN count(v) > 0 AND low > max(v) THEN 'out_of_range' ELSE 'not_in_judgment' END AS result
FROM r LEFT JOIN n USING (version) GROUP BY claim_id, pinpoint, low, high
""")
def pinpoint_check(spark, sf):
    return corpus.check_pinpoint(spark.createDataFrame(_CLAIMS, "claim_id int, version string, pinpoint string"), _labels(spark))


@query("label_values", "SELECT l_linenumber || '.' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS label, CAST(count(*) AS BIGINT) AS n, l_linenumber + max(CAST(l_quantity AS INTEGER)) / 100.0::DOUBLE AS value FROM lineitem GROUP BY l_linenumber, CAST(l_quantity AS INTEGER)")
def label_values(spark, sf):
    li = table(spark, sf, "lineitem").select(F.concat(F.col("l_linenumber").cast("string"), F.lit("."), F.col("l_quantity").cast("int").cast("string")).alias("label"))
    return li.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("value", label_value(F.col("label")))


_SAID = [(1, "Leave granted. The appeal is allowed."), (2, "Learned counsel for the appellant submits that notice is bad."), (3, "The High Court has in the order held that it was void."), (4, "We are of the considered view that the rule applies."), (5, "Reliance was placed; he relied on the decision."), (6, "The appeals are accordingly dismissed."), (7, "The weather was fine.")]
_ROLE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(body, '{cue(p).replace(chr(39), chr(39) * 2)}') THEN '{r}'" for r, p in ROLES.items()) + " ELSE 'none' END"


@query("role_labels", f"WITH s(seq, body) AS ({_values(_SAID)}) SELECT seq, CASE WHEN seq = 1 AND regexp_matches(body, '{cue(PREAMBLE)}') THEN 'preamble' ELSE {_ROLE_SQL} END AS role FROM s")
def role_labels(spark, sf):
    s = spark.createDataFrame(_SAID, "seq int, body string")
    return s.select("seq", corpus.role(F.col("body"), F.col("seq") == 1).alias("role"))


@query("role_filter_prior", f"""
SELECT role AS speaker, r AS role, count(*) AS n, sum(CASE r WHEN 'ratio' THEN 1.0 WHEN 'precedent_relied' THEN 0.5 WHEN 'analysis' THEN 0.5 ELSE 0.0 END)::DOUBLE AS prior FROM (SELECT role, {_ROLE_SQL.replace('body', 'text')} AS r FROM conversations) GROUP BY ALL
""")
def role_filter_prior(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("role").alias("speaker"), corpus.role(F.col("text"), F.lit(False)).alias("role"))
    prior = F.when(F.col("role") == "ratio", 1.0).when(F.col("role").isin("precedent_relied", "analysis"), 0.5).otherwise(0.0)
    return c.groupBy("speaker", "role").agg(F.count(F.lit(1)).alias("n"), F.sum(prior).alias("prior"))


@query("disposition_paragraph", f"WITH s(seq, body) AS ({_values(_SAID)}) SELECT 'v1' AS version, max(seq) AS seq FROM s WHERE regexp_matches(body, '{cue(ROLES['disposition'])}')")
def disposition_paragraph(spark, sf):
    return corpus.disposition(spark.createDataFrame(_SAID, "seq int, body string").withColumn("version", F.lit("v1")))


# ---- verdicts

_NONE = (None,) * 15
_OUTPUTS = [
    (1, "not_found", None, *_NONE, None), (2, "ambiguous", None, *_NONE, None), (3, "found", "exact", *_NONE, None),
    (4, "found", "exact", True, None, "ok", "ok", False, False, "court_majority", None, False, "good_law", None, "unclear", "full", True, "3", "3"),
    (5, "found", "party_name", False, True, "wrong_court", None, None, True, None, None, None, "overruled", None, None, "not_assessed", None, None, None),
    (6, "found", "exact", False, None, None, "wrong_paragraph", True, None, "court_dissent", None, True, None, "inapplicable", "obiter", "partial", True, "9", "3-5"),
    (7, "found", "exact", False, None, None, "ok", None, None, "quoted_precedent", True, False, "undermined", None, None, "partial", True, "4", "3-5"),
    (8, "found", "exact", False, None, None, None, None, None, "quoted_precedent", None, False, None, None, None, "contradicted", None, None, None),
    (9, "found", "exact", False, None, None, None, None, None, "counsel_argument", None, None, None, None, None, "full", True, "7", "3"),
]


def _outputs(spark) -> DataFrame:
    return spark.createDataFrame([tuple(r[:19]) for r in _OUTPUTS], verdict.INPUT)


@query("verdict_rubric")
def verdict_rubric(spark, sf):
    return verdict.rubric(_outputs(spark))


@query("grade_board")
def grade_board(spark, sf):
    return verdict.board(verdict.rubric(_outputs(spark)))


@query("brief_markers")
def brief_markers(spark, sf):
    return verdict.marker(verdict.rubric(_outputs(spark)))


_GATES = [(1, "found", True, True, "full", None), (2, "found", True, True, "partial", "narrower"), (3, "found", False, True, "full", None), (4, "found", True, False, "full", None), (5, "found", True, True, None, None), (6, "not_found", True, True, "full", None), (7, "found", True, True, "none", None), (8, "found", True, True, "error", None)]


@query("gate_status", f"""
WITH g(id, status, voice_ok, treatment_ok, support, narrowed) AS ({_values(_GATES)})
SELECT id, CASE WHEN status <> 'found' OR NOT voice_ok OR NOT treatment_ok THEN 'refused' WHEN support IS NULL OR support IN ('not_assessed', 'error', 'malformed') THEN 'unchecked'
  WHEN support = 'full' AND narrowed IS NULL THEN 'bound' WHEN support IN ('full', 'partial') AND narrowed IS NOT NULL THEN 'narrowed' ELSE 'refused' END AS status FROM g
""")
def gate_status(spark, sf):
    return verdict.gate(spark.createDataFrame(_GATES, "id int, status string, voice_ok boolean, treatment_ok boolean, support string, narrowed string"))


_ANSWERS = [(1, "full", 8, True, None, 10, None, 0.9), (2, "full", 8, False, None, 10, None, 0.9), (3, "full", 5, True, None, 10, None, None), (4, "full", 8, True, "x", 10, 12, 0.1), (5, "full", 8, True, "x", 10, 90, 0.0), (6, None, None, None, None, 10, None, None), (7, "contradicted", None, None, None, 10, None, None)]


@query("scope_verification", f"""
WITH a(id, support, quote_words, quote_found, narrowed, claim_words, narrowed_words, confidence) AS ({_values(_ANSWERS)}),
j AS (SELECT *, coalesce(support IN ('not_assessed', 'error', 'malformed'), true) AS mute, coalesce(support IN ('full', 'partial') AND NOT coalesce(quote_words >= 6 AND quote_found, false), false) AS loose FROM a)
SELECT id, CASE WHEN mute THEN 'not_assessed' WHEN loose THEN 'none' WHEN support = 'full' AND narrowed IS NOT NULL AND narrowed_words <= greatest(40, 2 * claim_words) THEN 'partial' ELSE support END AS support,
  mute OR loose OR coalesce(confidence < 0.35, false) AS needs_review FROM j
""")
def scope_verification(spark, sf):
    return verdict.scope_check(spark.createDataFrame(_ANSWERS, "id int, support string, quote_words int, quote_found boolean, narrowed string, claim_words int, narrowed_words int, confidence double"))


@query("memo_severity", """
SELECT l_orderkey AS citation_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY d DESC, mode) AS INTEGER) AS place, mode FROM (SELECT l_orderkey, CAST(1 + l_partkey % 12 AS INTEGER) AS mode, max(l_linenumber) AS d FROM lineitem GROUP BY ALL)
""")
def memo_severity(spark, sf):
    li = table(spark, sf, "lineitem")
    return verdict.memo(li.select(F.col("l_orderkey").alias("citation_id"), (1 + F.col("l_partkey") % 12).cast("int").alias("mode"), F.col("l_linenumber").alias("drop"))).drop("name")


# ---- evaluation

_ITEMS_SQL = "i AS (SELECT doc_id, CASE WHEN quality = 0 THEN CAST(1 + doc_id % 12 AS INTEGER) END AS planted_mode, CASE WHEN toxic = 1 THEN CAST(1 + doc_id % 12 AS VARCHAR) ELSE '' END AS modes FROM labels)"


def _items(spark, sf) -> DataFrame:
    mode = (1 + F.col("doc_id") % 12).cast("int")
    return table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 0, mode).alias("planted_mode"), F.when(F.col("toxic") == 1, mode.cast("string")).otherwise("").alias("modes"))


@query("eval_recall_by_mode", f"WITH {_ITEMS_SQL} SELECT planted_mode AS mode, count(*) AS planted, count(*) FILTER (modes = CAST(planted_mode AS VARCHAR)) AS caught, round(count(*) FILTER (modes = CAST(planted_mode AS VARCHAR)) / count(*)::DOUBLE, 6) AS recall, planted_mode IN (4, 7, 8, 11) AS needs_model FROM i WHERE planted_mode IS NOT NULL GROUP BY planted_mode")
def eval_recall_by_mode(spark, sf):
    return verdict.recall_by_mode(_items(spark, sf))


@query("eval_fp_rate", f"WITH {_ITEMS_SQL} SELECT count(*) AS clean, count(*) FILTER (modes <> '') AS flagged, round(count(*) FILTER (modes <> '') / nullif(count(*), 0)::DOUBLE, 6) AS rate FROM i WHERE planted_mode IS NULL")
def eval_fp_rate(spark, sf):
    return verdict.false_positives(_items(spark, sf))


@query("retrieval_recall_at_k", "SELECT event_type AS kind, count(*) AS n, round(avg(CASE WHEN r <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_1, round(avg(CASE WHEN r <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_5, round(avg(CASE WHEN r <= 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_10 FROM (SELECT event_type, CASE WHEN user_id % 3 > 0 THEN user_id % 17 END AS r FROM events) GROUP BY 1")
def retrieval_recall_at_k(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.when(F.col("user_id") % 3 > 0, F.col("user_id") % 17).alias("rank"))
    return verdict.recall_at(e, 1, 5, 10)


@query("eval_rates", "SELECT round(avg(CASE WHEN quality = 1 THEN CASE WHEN toxic = 0 THEN 1.0::DOUBLE ELSE 0 END END), 6) AS grounding, round(avg(CASE WHEN toxic = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS abstention, round(avg(CASE WHEN doc_id % 7 > 0 THEN CAST(doc_id % 7 AS DOUBLE) END), 6) AS mean_seconds FROM labels")
def eval_rates(spark, sf):
    support = F.when(F.col("quality") == 1, "full").otherwise("none")
    return verdict.rates(table(spark, sf, "labels").select(support.alias("support"), (F.col("toxic") == 0).alias("quote_verified"), (F.col("toxic") == 1).alias("needs_review"), (F.col("doc_id") % 7).alias("seconds")))


@query("line_accuracy", "SELECT event_type AS kind, count(*) FILTER (user_id % 3 > 0) AS found, round(avg(CASE WHEN user_id % 3 > 0 THEN CASE WHEN event_id % 4 > 0 THEN 1.0::DOUBLE ELSE 0 END END), 6) AS accuracy FROM events GROUP BY 1")
def line_accuracy(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.when(F.col("user_id") % 3 > 0, F.col("user_id") % 17).alias("rank"), (F.col("event_id") % 4 > 0).alias("line_matched"))
    return verdict.line_accuracy(e)


@query("seeded_sample", "SELECT doc_id FROM documents ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
def seeded_sample(spark, sf):
    """A sample of fixed size is the operator."""
    return contrary.seeded_sample(table(spark, sf, "documents").select("doc_id"), "doc_id", 50)


_SEEDS = [
    (1, "The notice was good.", "(2019) 4 SCC 1", "3", 2, "5", "The notice was bad in law.", None, None, "9", "It may be that it was late.", "A suit lies.", "AIR 1973 SC 1", "2", "It does not lie."),
    (2, "A suit lies.", "(2020) 1 SCC 9", "7", 5, None, None, "12", "I would hold otherwise.", None, None, None, None, None, None),
]
_SEED_COLUMNS = "id, sentence, citation, label, bench, counsel_label, counsel_sentence, dissent_label, dissent_sentence, obiter_label, obiter_sentence, foreign_sentence, dead_citation, dead_label, dead_sentence"


@query("planted_readings", f"""
WITH s({_SEED_COLUMNS}) AS ({_values(_SEEDS)}), m AS (
  SELECT id, 3 AS mode, CASE WHEN bench < 5 THEN 'A Constitution Bench of this Court held that ' || lower(sentence[1]) || sentence[2:] END AS claim, citation || ', para ' || label AS citation FROM s UNION ALL
  SELECT id, 4, foreign_sentence, citation || ', para ' || label FROM s UNION ALL SELECT id, 5, counsel_sentence, citation || ', para ' || counsel_label FROM s UNION ALL
  SELECT id, 6, dissent_sentence, citation || ', para ' || dissent_label FROM s UNION ALL SELECT id, 7, obiter_sentence, citation || ', para ' || obiter_label FROM s UNION ALL
  SELECT id, 10, dead_sentence, dead_citation || ', para ' || dead_label FROM s
) SELECT * FROM m WHERE claim IS NOT NULL AND citation IS NOT NULL
""")
def planted_readings(spark, sf):
    kinds = ", ".join(f"{c} {'int' if c in ('id', 'bench') else 'string'}" for c in _SEED_COLUMNS.split(", "))
    return contrary.plant_readings(spark.createDataFrame(_SEEDS, kinds))


@query("gate_traffic", "SELECT event_type AS kind, round(avg(value), 6) AS mean_value, round(count(*) / (SELECT count(*) FROM events)::DOUBLE, 6) AS share FROM events GROUP BY 1")
def gate_traffic(spark, sf):
    return verdict.traffic(table(spark, sf, "events").select(F.col("event_type").alias("kind"), "value"))


@query("contrary_flip_table", "SELECT count(*) FILTER (q AND NOT t) AS opposed_only, count(*) FILTER (t AND NOT q) AS agreed_only, count(*) FILTER (q AND t) AS both_flagged, count(*) FILTER (NOT q AND NOT t) AS neither FROM (SELECT quality = 1 AS q, toxic = 1 AS t FROM labels)")
def contrary_flip_table(spark, sf):
    return verdict.flips(table(spark, sf, "labels").select(F.col("doc_id").alias("key"), (F.col("quality") == 1).alias("opposed"), (F.col("toxic") == 1).alias("agreed")))


@query("outcome_pivot", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def outcome_pivot(spark, sf):
    return verdict.outcome_table(table(spark, sf, "orders").select("o_orderpriority", F.col("o_orderstatus").alias("outcome")), "o_orderpriority", ["F", "O", "P"])


@query("gateway_failure_rate", """
SELECT event_type || '-' || CAST(user_id % 3 AS VARCHAR) AS model, count(*) AS calls, count(*) FILTER (user_id % 5 = 0) AS failed, round(count(*) FILTER (user_id % 5 = 0) / count(*)::DOUBLE, 6) AS rate, list_sort(list(event_id))[count(*) // 2 + 1] AS median_prompt FROM events GROUP BY 1
""")
def gateway_failure_rate(spark, sf):
    e = table(spark, sf, "events")
    return readers.call_log(e.select(F.concat("event_type", F.lit("-"), (F.col("user_id") % 3).cast("string")).alias("model"), F.when(F.col("user_id") % 5 == 0, 500).otherwise(200).alias("status"), F.col("event_id").alias("prompt_tokens")))


# ---- reading kernels on literal passages

_PASSAGES = [
    (1, "Reliance is on Kasturi v. Iyyamperumal, (2005) 6 SCC 733, para 8.2, and AIR 2019 SUPREME COURT 1234.", "majority"), (2, "The Supreme Court has held that a notice is mandatory. 2023:DHC:2073-DB follows.", None),
    (3, "Learned counsel submitted that the decree is void. We are unable to accept that.", "majority"), (4, "It was held by the Constitution Bench. 2026 SCC OnLine SC 1258 is hereby overruled.", "dissenting"), (5, "", "headnote"), (6, None, "majority"),
]


def _passages(spark) -> DataFrame:
    return spark.createDataFrame(_PASSAGES, "id int, body string, opinion string")


@query("citation_extract")
def citation_extract(spark, sf):
    return flat_map(_passages(spark), lambda r: ({"id": r["id"], **c} for c in extract(r["body"])), f"id int, {CITATION}")


@query("voice_last_cue")
def voice_last_cue(spark, sf):
    own = _passages(spark).select(F.col("id").cast("long"), "body", "opinion")
    talk = table(spark, sf, "conversations").select((1000 + F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("body"), F.when(F.col("role") == "assistant", "majority").alias("opinion"))
    return flat_map(own.unionByName(talk), lambda r: [{"id": r["id"], **voice(r["body"] or "", r["opinion"])}], "id long, voice string, method string, cue string, endorsed boolean, needs_review boolean")


@query("hierarchy_check")
def hierarchy_check(spark, sf):
    return flat_map(_passages(spark), lambda r: [{"id": r["id"], "status": hierarchy(r["body"] or "", "Delhi High Court", 2)}], "id int, status string")


@query("treatment_classify")
def treatment_classify(spark, sf):
    def rows(r):
        for c in extract(r["body"]):
            yield {"id": r["id"], "normalized": c["normalized"], "treatment": treatment(r["body"], (c["start"], c["end"]))}

    return flat_map(_passages(spark), rows, "id int, normalized string, treatment string")


@query("weight_of_passage")
def weight_of_passage(spark, sf):
    return flat_map(_passages(spark), lambda r: [dict(zip(("id", "label", "method", "cue"), (r["id"], *weight(r["body"] or ""))))], "id int, label string, method string, cue string")


@query("polarity_opposes")
def polarity_opposes(spark, sf):
    pairs = spark.createDataFrame([
        (1, "The notice under section 80 is mandatory for a suit against government", "The notice under section 80 is directory for a suit against government alone"),
        (2, "The amount of compensation payable shall be deposited with interest", "The amount of compensation payable shall not be deposited with interest here"),
        (3, "The amount of compensation payable shall be deposited", "The amount of compensation payable shall be deposited"),
    ], "id int, proposition string, sentence string")

    def rows(r):
        found = opposes(r["proposition"], r["sentence"])
        yield {"id": r["id"], "kind": found["kind"] if found else None, "cue": found["cue"] if found else None}

    return flat_map(pairs, rows, "id int, kind string, cue string")


_BRIEF = "A tenancy ends only where notice is given in writing to the tenant by the landlord, unless the tenant waives it by conduct known to both parties."


@query("truncation_scan")
def truncation_scan(spark, sf):
    passages = spark.createDataFrame([("v1", 1, "1", _BRIEF), ("v1", 2, "2", "Another thing.")], "version string, seq int, label string, body string")
    claims = spark.createDataFrame([(1, "v1", "The court said a tenancy ends only where notice is given in writing to the tenant by the landlord."), (2, "v1", _BRIEF)], "claim_id int, version string, claim string")
    return contrary.truncations(claims, passages)


@query("quote_match")
def quote_match(spark, sf):
    """Benchmark items in documents; the table marks no document as scanned."""
    quotes = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote"))
    return contrary.quote_matches(quotes, table(spark, sf, "documents").select("doc_id", "text", F.lit(False).alias("ocr")))


@query("segment_paragraphs")
def segment_paragraphs(spark, sf):
    return corpus.paragraphs_of(table(spark, sf, "documents"), "doc_id", "text").select("version", "seq", "label", "start", "end", F.length("body").alias("n"))


@query("html_to_text_clean")
def html_to_text_clean(spark, sf):
    """Pages of a web table as a stand-in for page text: tags dropped, then cleaned as one page each."""
    pages = table(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", "\n").alias("text"))

    def rows(r):
        body, gone = clean_pages([r["text"]])
        yield {"page_id": r["page_id"], "n_chars": len(body), "removed": gone}

    return flat_map(pages, rows, "page_id long, n_chars int, removed int")


_JUDGMENT = "Headnote: a point of law.\nJUDGMENT\n" + "\n".join(f"{k}. Paragraph {k} of the court's reasons on the point, which runs on for some words." for k in range(1, 9)) + "\n9. I regret my inability to agree with the majority.\n10. The appeal is dismissed.\nResult of the case : Appeal dismissed.\n"


@query("judgment_parts")
def judgment_parts(spark, sf):
    return corpus.judgment_parts(spark.createDataFrame([("v1", _JUDGMENT)], "version string, text string"))


@query("separate_opinions")
def separate_opinions(spark, sf):
    return corpus.separate_opinions(corpus.paragraphs_of(spark.createDataFrame([("v1", _JUDGMENT)], "version string, text string")))


@query("strip_signoffs")
def strip_signoffs(spark, sf):
    return corpus.strip_signoff(spark.createDataFrame([("v1", 1, "Reasons."), ("v1", 2, "The appeal is allowed.\nDivya Pandey Appeal allowed.\n(Assisted by : D. Panwar)")], "version string, seq int, body string"))


@query("planted_errors")
def planted_errors(spark, sf):
    items = spark.createDataFrame([(1, _BRIEF, "(2019) 4 SCC 1", "AIR 1973 SC 1461")], "id int, sentence string, citation string, other_citation string")
    return contrary.plant(items).withColumn("mode", F.coalesce("mode", F.lit(0)))  # 0: clean


@query("negate_sentences")
def negate_sentences(spark, sf):
    rows = spark.createDataFrame([(1, "The notice is mandatory."), (2, "It cannot be waived."), (3, "So held.")], "id int, sentence string")
    return flat_map(rows, lambda r: [{"id": r["id"], "denied": negate(r["sentence"])}], "id int, denied string")


_PLAN = "title: A v. B\n# synopsis\nThe tenant was never told.\n# issue Whether notice was good\n- The notice was not served on the tenant at all\n- A notice must be in writing to be good\n# prayer\nAllow the appeal.\n"


@query("plan_parse")
def plan_parse(spark, sf):
    return readers.plan_rows(spark, _PLAN)


@query("draft_document")
def draft_document(spark, sf):
    points = [{"proposition": p, "citation": "(2019) 4 SCC 1" if k == 0 else None, "label": "3"} for k, p in enumerate(readers.plan(_PLAN)["issues"][0]["propositions"])]
    return spark.createDataFrame([(k, *b) for k, b in enumerate(writers.blocks(readers.plan(_PLAN), points))], "place int, kind string, text string")


@query("verify_brief")
def verify_brief(spark, sf):
    brief = spark.createDataFrame([(1, "The Supreme Court has held so in Kasturi v. Iyyamperumal, (2005) 6 SCC 733. It was followed in AIR 1973 SC 1461. See also (1999) 1 SCC 1.")], "brief_id int, text string")
    aliases = spark.createDataFrame([("SCC:2005:6:733", "K1"), ("AIR:SC:1973:1461", "B2")], "normalized string, case string")
    cases = spark.createDataFrame([("K1", "Kasturi v. Iyyamperumal", "Delhi High Court", 2), ("B2", "State v. Rao", "Supreme Court of India", 5)], "case string, title string, court string, bench int")
    return contrary.verify_brief(brief, aliases, cases, spark.createDataFrame([("K1", "good_law"), ("B2", "overruled")], "case string, status string"))


@query("rate_limit_windows")
def rate_limit_windows(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("client"), F.col("event_type").alias("bucket"), "ts")
    return limits.limit(e, requests=2, seconds=6 * 3600.0)


@query("court_prefixes")
def court_prefixes(spark, sf):
    from veritext.operators.drafting import high_courts

    return spark.createDataFrame([("DHC",), ("KHC-D",), ("XYZ",)], "prefix string").join(F.broadcast(high_courts(spark)), "prefix", "left")


@query("self_attack")
def self_attack(spark, sf):
    from veritext.operators.drafting import attacks

    points = spark.createDataFrame([(1, None, "unsupported"), (2, "A1", "bound"), (3, "B2", "narrowed")], "point int, case string, status string")
    edges = spark.createDataFrame([("C3", "A1", "distinguished"), ("C3", "B2", "followed")], "citing string, cited string, treatment string")
    cases = spark.createDataFrame([("A1", 2, "2001-01-01"), ("B2", 3, "1990-01-01"), ("C3", 2, "1999-01-01")], "case string, bench int, decided_on string")
    field = spark.createDataFrame([(2, "A1"), (2, "B2"), (2, "C3")], "point int, case string")
    return attacks(points, edges, cases, field, spark.createDataFrame([(2, "C3")], "point int, case string"))


@query("opinion_counts", "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role")
def opinion_counts(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("role").alias("kind"), F.col("conv_id").alias("version"))
    return corpus.opinion_counts(c).select(F.col("kind").alias("role"), "n", F.col("versions").alias("conversations"))


@query("last_turn", "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def last_turn(spark, sf):
    """The last paragraph of each group, as voice and disposition need it."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("version"), F.col("turn").alias("seq"), "role")
    return corpus.last_paragraphs(c).select(F.col("version").alias("conv_id"), F.col("seq").alias("turn"), "role")


@query("lead_dedup", """
SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id) = 1) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1
""")
def lead_dedup(spark, sf):
    """One lead a sentence, then one a judgment, best first."""
    from veritext.operators.retrieval import first_of_group

    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars", "text")
    best = (F.desc("n_chars"), F.col("doc_id"))
    return first_of_group(first_of_group(d, "text", *best), "source", *best).select("source", "doc_id", "n_chars")


@query("grade_steps", "SELECT s_suppkey, list_extract(['A', 'B', 'C', 'D', 'E', 'F'], CAST(greatest(least(s_suppkey % 6 + 2, 5), 3) + 1 AS INTEGER)) AS grade FROM supplier")
def grade_steps(spark, sf):
    """Two steps down, clamped, then a floor of D."""
    return table(spark, sf, "supplier").select("s_suppkey", verdict.lowered(F.col("s_suppkey") % 6, F.lit(2), F.lit(3)).alias("grade"))


@query("pinpoint_covers", "SELECT l_orderkey, l_linenumber, l_linenumber BETWEEN 2 AND 4 AS covered FROM lineitem")
def pinpoint_covers(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", verdict.covers(F.lit("2-4"), F.col("l_linenumber").cast("string")).alias("covered"))


@query("year_window_join", "SELECT a.o_orderkey, count(*) AS n FROM orders a JOIN orders b ON b.o_custkey = a.o_custkey AND year(b.o_orderdate) BETWEEN year(a.o_orderdate) - 1 AND year(a.o_orderdate) + 1 GROUP BY 1")
def year_window_join(spark, sf):
    """A band of a year each way as an equi-join: three copies of one side."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    # Orders of one customer and year count once before they meet, so that a busy customer costs a row a year.
    held = o.groupBy("o_custkey", "year").agg(F.count(F.lit(1)).alias("n"))
    return resolve.within_a_year(o, held, ["o_custkey"]).groupBy("o_orderkey").agg(F.sum("n").alias("n"))

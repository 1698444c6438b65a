"""Queries of the citator and the resolver: lineitem and orders stand for a graph of suppliers that cite parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritext.operators import citator, resolve
from veritext.sources.readers import table
from veritext.sources.writers import authorities_table

QUERIES, ORACLE_SQL = {}, {}
#: Treatments that the flags of a line stand for.
_TREATMENTS = ("overruled", "doubted", "relied_on", "followed", "referred", "distinguished", "partly_overruled")


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


_EDGES_SQL = """
edges AS (SELECT l_orderkey * 10 + l_linenumber AS edge_id, l_suppkey AS citing, l_partkey % 100 AS cited,
  CASE l_orderkey % 7 WHEN 0 THEN 'overruled' WHEN 1 THEN 'doubted' WHEN 2 THEN 'relied_on' WHEN 3 THEN 'followed' WHEN 4 THEN 'referred' WHEN 5 THEN 'distinguished' ELSE 'partly_overruled' END AS treatment,
  CAST(l_shipdate AS DATE) AS citing_date FROM lineitem)
"""


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(t) for t in _TREATMENTS])
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), F.col("l_suppkey").alias("citing"), (F.col("l_partkey") % 100).alias("cited"), F.get(names, (F.col("l_orderkey") % 7).cast("int")).alias("treatment"), F.col("l_shipdate").cast("date").alias("citing_date"))


@query("edges_dedup", f"WITH {_EDGES_SQL} SELECT citing, cited, treatment, min(edge_id) AS edge_id FROM edges GROUP BY ALL")
def edges_dedup(spark, sf):
    return citator.dedup_edges(_edges(spark, sf), "edge_id").select("citing", "cited", "treatment", "edge_id")


@query("treatment_histogram", f"WITH {_EDGES_SQL} SELECT treatment, count(*) AS n FROM edges GROUP BY treatment")
def treatment_histogram(spark, sf):
    return _edges(spark, sf).groupBy("treatment").agg(F.count(F.lit(1)).alias("n"))


@query("bench_rule", f"""
WITH {_EDGES_SQL} SELECT edge_id, CASE WHEN treatment IN ('overruled', 'partly_overruled') AND citing % 6 > 0 AND cited % 6 > 0 AND citing % 6 <= cited % 6 THEN 'doubted' ELSE treatment END AS treatment FROM edges
""")
def bench_rule(spark, sf):
    return _edges(spark, sf).select("edge_id", citator.bench_rule(F.col("treatment"), F.col("citing") % 6, F.col("cited") % 6).alias("treatment"))


_WORST_SQL = "worst AS (SELECT cited, treatment, edge_id, citing FROM (SELECT *, list_position(['overruled', 'reversed', 'partly_overruled', 'referred_to_larger_bench', 'doubted'], treatment) AS sev FROM edges) WHERE sev IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cited ORDER BY sev, edge_id, citing, citing_date) = 1)"


@query("worst_treatment", f"WITH {_EDGES_SQL}, {_WORST_SQL} SELECT * FROM worst")
def worst_treatment(spark, sf):
    return citator.worst_edges(_edges(spark, sf))


_UNDER_SQL = """
kills AS (SELECT cited, edge_id, citing AS killed_by, citing_date AS killed_on FROM (SELECT *, list_position(['overruled', 'reversed', 'partly_overruled'], treatment) AS sev FROM edges) WHERE sev IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cited ORDER BY sev, edge_id, citing, citing_date) = 1),
under AS (SELECT DISTINCT e.citing, e.cited, k.killed_by FROM edges e JOIN kills k USING (cited) WHERE e.treatment IN ('relied_on', 'followed') AND coalesce(e.citing_date < k.killed_on, true) AND e.citing <> k.killed_by)
"""


@query("undermined_one_hop", f"WITH {_EDGES_SQL}, {_UNDER_SQL} SELECT * FROM under")
def undermined_one_hop(spark, sf):
    return citator.undermined(_edges(spark, sf))


@query("case_standing", f"""
WITH {_EDGES_SQL}, {_WORST_SQL}, {_UNDER_SQL}, cases AS (SELECT s_suppkey AS c FROM supplier), n AS (SELECT cited, count(DISTINCT citing) AS n FROM edges GROUP BY cited),
s AS (SELECT c, coalesce(n, 0) AS citing_count, coalesce(treatment, CASE WHEN c IN (SELECT citing FROM under) THEN 'undermined' END, 'good_law') AS status FROM cases LEFT JOIN n ON n.cited = c LEFT JOIN worst ON worst.cited = c)
SELECT c AS "case", status, citing_count, status = 'good_law' AND citing_count = 0 AS is_unchecked, status NOT IN ('good_law') AS is_doubtful FROM s
""")
def case_standing(spark, sf):
    return citator.standing(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("case")), _edges(spark, sf))


@query("cited_share", f"WITH {_EDGES_SQL} SELECT count(DISTINCT cited) AS cited, (SELECT count(*) FROM part) AS cases, round(count(DISTINCT cited) / (SELECT count(*) FROM part)::DOUBLE, 6) AS share FROM edges")
def cited_share(spark, sf):
    return citator.cited_share(table(spark, sf, "part"), _edges(spark, sf))


@query("outranked_by", """
SELECT a.o_orderkey, b.o_orderkey AS by_key, CAST(row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.bench DESC, b.o_orderdate DESC, b.o_orderkey) AS INTEGER) AS place
FROM (SELECT o_orderkey, o_custkey, o_orderdate, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS bench FROM orders) a JOIN (SELECT o_orderkey, o_custkey, o_orderdate, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS bench FROM orders) b
ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND (b.bench > a.bench OR (b.bench = a.bench AND b.o_orderdate > a.o_orderdate)) QUALIFY place <= 2
""")
def outranked_by(spark, sf):
    """Cases of the same field with a larger bench, or as large and later; the first two."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.substring("o_orderpriority", 1, 1).cast("int").alias("bench"))
    a, b = o.alias("a"), o.alias("b")
    higher = (F.col("b.bench") > F.col("a.bench")) | ((F.col("b.bench") == F.col("a.bench")) & (F.col("b.o_orderdate") > F.col("a.o_orderdate")))
    met = a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderkey") != F.col("b.o_orderkey")) & higher)
    w = Window.partitionBy("a.o_orderkey").orderBy(F.desc("b.bench"), F.desc("b.o_orderdate"), "b.o_orderkey")
    return met.select(F.col("a.o_orderkey"), F.col("b.o_orderkey").alias("by_key"), F.row_number().over(w).alias("place")).where("place <= 2")


@query("table_of_authorities", """
WITH c AS (SELECT DISTINCT p_partkey AS judgment, p_name AS title, p_size AS court_rank, CAST(l_linenumber AS VARCHAR) AS label FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT judgment, title, string_agg(label, ', ' ORDER BY len(label), label) AS labels, CAST(row_number() OVER (ORDER BY court_rank, title, judgment) AS INTEGER) AS place FROM c GROUP BY judgment, title, court_rank
""")
def table_of_authorities(spark, sf):
    cites = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return authorities_table(cites.select(F.col("p_partkey").alias("judgment"), F.col("p_name").alias("title"), F.col("p_size").alias("court_rank"), F.lit(None).cast("date").alias("decided"), F.col("l_linenumber").cast("string").alias("label")))


_ALIASES = [("A1", "SCC", "(2019) 4 SCC 1", "SCC:2019:4:1"), ("A1", "AIR", "AIR 2019 SC 77", "AIR:SC:2019:77"), ("A1", "SCC", "(2018) 9 SCC 9", "SCC:2018:9:9"), ("B2", "AIR", "AIR 1973 SC 1461", "AIR:SC:1973:1461"), ("B2", "SCR", "[1973] 2 SCR 5", "SCR:1973:2:5"), ("C3", "JT", "JT 2001 (3) SC 4", "JT:2001:3:4")]


def _alias_table(spark) -> DataFrame:
    return spark.createDataFrame(_ALIASES, "case string, reporter string, citation string, normalized string")


def _values(rows) -> str:
    """Rows as SQL VALUES."""
    def one(x):
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


_A = f"a(\"case\", reporter, citation, normalized) AS ({_values(_ALIASES)})"


@query("preferred_citation", f"""
WITH {_A} SELECT "case", citation FROM a QUALIFY row_number() OVER (PARTITION BY "case" ORDER BY CASE reporter WHEN 'SCC' THEN 0 WHEN 'SCR' THEN 1 WHEN 'AIR' THEN 2 ELSE 3 END, citation) = 1
""")
def preferred_citation(spark, sf):
    return resolve.preferred_citation(_alias_table(spark))


_CITED = [(1, "SCC:2019:4:1"), (2, "AIR:SC:1973:1461"), (3, "SCC:1950:1:1"), (4, "JT:2001:3:4")]


@query("exact_resolve", f"""
WITH {_A}, c(citation_id, normalized) AS ({_values(_CITED)}) SELECT citation_id, min("case") AS "case", CASE WHEN min("case") IS NULL THEN 'not_found' ELSE 'found' END AS status FROM c LEFT JOIN a USING (normalized) GROUP BY citation_id
""")
def exact_resolve(spark, sf):
    return resolve.exact(spark.createDataFrame(_CITED, "citation_id int, normalized string"), _alias_table(spark)).select("citation_id", "case", "status")


@query("customer_resolve", "SELECT e.event_id, c.c_custkey, CASE WHEN c.c_custkey IS NULL THEN 'not_found' ELSE 'found' END AS status FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id * 3")
def customer_resolve(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("user_id") * 3).cast("string").alias("normalized"))
    known = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("normalized"), F.col("c_custkey").alias("case"))
    return resolve.exact(e, known).select("event_id", F.col("case").alias("c_custkey"), "status")


_RUNS = [("d1", 10, "See", "k1", "A1"), ("d1", 30, " : ", "k9", None), ("d1", 60, " and then ", "k8", None), ("d1", 80, "; ", "k2", "B2"), ("d2", 5, "", "k3", "C3"), ("d2", 20, ", ", "k2", "B2"), ("d2", 40, " = ", "k7", None), ("d3", 1, "", "k9", None), ("d3", 9, ":", "k1", "A1")]
_RUN_SQL = f"""
s(doc, start, gap_text, normalized, "case") AS ({_values(_RUNS)}),
r AS (SELECT *, CAST(sum(CASE WHEN regexp_matches(gap_text, '^[\\s:;=,]{{1,4}}$') THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY start) AS BIGINT) AS run FROM s)
"""


@query("alias_runs", f"WITH {_RUN_SQL} SELECT doc, start, run FROM r")
def alias_runs(spark, sf):
    return resolve.citation_runs(_spans(spark)).select("doc", "start", "run")


def _spans(spark) -> DataFrame:
    return spark.createDataFrame(_RUNS, "doc string, start int, gap_text string, normalized string, case string")


@query("alias_pairs_sessionise", f"""
WITH {_RUN_SQL}, k AS (SELECT doc, run, min("case") AS c FROM r WHERE "case" IS NOT NULL GROUP BY ALL HAVING count(DISTINCT "case") = 1)
SELECT normalized, min(c) AS "case" FROM r JOIN k USING (doc, run) WHERE r."case" IS NULL GROUP BY normalized HAVING count(DISTINCT c) = 1
""")
def alias_pairs_sessionise(spark, sf):
    return resolve.paired_aliases(resolve.citation_runs(_spans(spark)))


_SEEN = [("k1", "A1", 97.0, "d1"), ("k2", "A1", 93.0, "d1"), ("k2", "A1", 94.0, "d2"), ("k3", "B2", 93.0, "d1"), ("k4", "A1", 99.0, "d1"), ("k4", "B2", 92.5, "d2")]


@query("alias_accept", f"""
WITH s(normalized, "case", score, citing) AS ({_values(_SEEN)}) SELECT normalized, arg_max("case", score) AS "case", CAST(max(score) AS DOUBLE) AS score, count(DISTINCT citing) AS citing,
  CASE WHEN count(DISTINCT "case") > 1 THEN 'conflict' WHEN max(score) >= 96 OR count(DISTINCT citing) >= 2 THEN 'accepted' ELSE 'held' END AS verdict FROM s GROUP BY normalized
""")
def alias_accept(spark, sf):
    return resolve.accept_sightings(spark.createDataFrame(_SEEN, "normalized string, case string, score double, citing string"))


@query("fuzzy_party_match")
def fuzzy_party_match(spark, sf):
    """Part names with their words turned round, matched to parts by word sets within a year."""
    p = table(spark, sf, "part")
    titles = p.select(F.col("p_partkey").alias("case"), F.concat_ws(" versus ", "p_name", "p_type").alias("title"), (2000 + F.col("p_size")).alias("title_year"))
    names = p.select(F.col("p_partkey").alias("name_id"), F.concat_ws(" v. ", "p_type", "p_name").alias("name"), (2000 + F.col("p_size")).alias("year"))
    return resolve.by_parties(names, titles)


@query("supra_resolve")
def supra_resolve(spark, sf):
    body = spark.createDataFrame([("d1", 3, "As held in Kasturi (supra), the rule applies."), ("d1", 4, "In Unknown Person (supra) nothing was said.")], "citing string, seq int, body string")
    cited = spark.createDataFrame([("d1", "A1", "Kasturi v. Iyyamperumal"), ("d1", "B2", "State of Kerala v. Rao")], "citing string, cited string, title string")
    return citator.supra_references(body, cited)


@query("edges_from_text")
def edges_from_text(spark, sf):
    body = spark.createDataFrame([("Z9", 1, "We respectfully follow the law in A v. B, (2019) 4 SCC 1."), ("Z9", 2, "B v. C, AIR 1973 SC 1461 is hereby overruled."), ("Z9", 3, "“B v. C, AIR 1973 SC 1461 is hereby overruled.”")], "citing string, seq int, body string")
    return citator.citation_edges(body, _alias_table(spark))

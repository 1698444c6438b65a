"""The citator: treatment edges, the bench rule, standing of a case, and one hop of undermining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritext.functions.citations import extract
from veritext.functions.kernels import flat_map, group_map
from veritext.functions.lexicon import KILLING, NEEDS_LARGER_BENCH, NEGATIVE, RELIANCE, SEVERITY, SUPRA_MARGIN, SUPRA_SCORE
from veritext.functions.reading import treatment
from veritext.functions.text import in_quotation, token_set_ratio


def severity(label: Column) -> Column:
    """0 for the worst treatment; null for those that do no harm."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in SEVERITY]), label), F.lit(0).cast("long")) - 1


def bench_rule(label: Column, citing: Column, cited: Column) -> Column:
    """A bench can't overrule one as large as itself: what it says is then a doubt."""
    blocked = label.isin(*NEEDS_LARGER_BENCH) & (F.coalesce(citing, F.lit(0)) > 0) & (F.coalesce(cited, F.lit(0)) > 0) & (citing <= cited)
    return F.when(blocked, "doubted").otherwise(label)


def dedup_edges(edges: DataFrame, *order: str) -> DataFrame:
    """The first edge of each (citing, cited, treatment)."""
    w = Window.partitionBy("citing", "cited", "treatment").orderBy(*order)
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def worst_edges(edges: DataFrame, id_col: str = "edge_id") -> DataFrame:
    """cited, treatment, edge: the gravest treatment of each case; the smallest edge among equals."""
    worst = edges.withColumn("sev", severity(F.col("treatment"))).where("sev is not null")
    return worst.groupBy("cited").agg(F.min(F.struct("sev", id_col, "citing", "treatment")).alias("w")).select("cited", "w.treatment", F.col(f"w.{id_col}").alias(id_col), "w.citing")


def standing(cases: DataFrame, edges: DataFrame) -> DataFrame:
    """case, status, citing_count, is_unchecked: the worst direct treatment, else undermined, else good law.

    edges: edge_id, citing, cited, treatment, citing_date. Good law that nobody cites is unchecked, not cleared."""
    cites = edges.groupBy("cited").agg(F.countDistinct("citing").alias("citing_count"))
    direct = worst_edges(edges).select(F.col("cited").alias("case"), F.col("treatment").alias("direct"))
    hurt = undermined(edges).select(F.col("citing").alias("case")).distinct().withColumn("hop", F.lit("undermined"))
    out = cases.join(direct, "case", "left").join(hurt, "case", "left").join(cites.withColumnRenamed("cited", "case"), "case", "left")
    out = out.withColumn("citing_count", F.coalesce("citing_count", F.lit(0).cast("long"))).withColumn("status", F.coalesce("direct", "hop", F.lit("good_law")))
    return out.select("case", "status", "citing_count", ((F.col("status") == "good_law") & (F.col("citing_count") == 0)).alias("is_unchecked"), F.col("status").isin(*NEGATIVE, "undermined").alias("is_doubtful"))


def undermined(edges: DataFrame) -> DataFrame:
    """citing, cited, killed_by: cases that rest on one killed after they were decided. One hop; unknown dates pass."""
    deadly = edges.where(F.col("treatment").isin(*KILLING)).withColumn("sev", severity(F.col("treatment")))
    kills = deadly.groupBy("cited").agg(F.min(F.struct("sev", "edge_id", "citing", "citing_date")).alias("k")).select("cited", F.col("k.citing").alias("killed_by"), F.col("k.citing_date").alias("killed_on"))
    rests = edges.where(F.col("treatment").isin(*RELIANCE)).select("citing", "cited", "citing_date")
    late = F.coalesce(F.col("citing_date") < F.col("killed_on"), F.lit(True))
    return rests.join(kills, "cited").where(late & (F.col("citing") != F.col("killed_by"))).select("citing", "cited", "killed_by").distinct()


def cited_share(cases: DataFrame, edges: DataFrame) -> DataFrame:
    """share: how many of the cases anybody cites."""
    n = cases.agg(F.count(F.lit(1)).alias("cases"))
    return edges.agg(F.countDistinct("cited").alias("cited")).join(n, F.lit(True)).select("cited", "cases", F.round(F.try_divide(F.col("cited").cast("double"), F.col("cases")), 6).alias("share"))


def citation_edges(paragraphs: DataFrame, aliases: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Edges of paragraphs (citing, seq, body): every citation, its sentence's treatment of it, joined to the alias table.

    done: cases (column citing) whose paragraphs were read before and are not read again. Harm said inside a quotation is the quoted court's, and counts as a mere reference."""
    def rows(r):
        for k, c in enumerate(extract(r["body"])):
            what = treatment(r["body"], (c["start"], c["end"]))
            if what in NEGATIVE and in_quotation(r["body"], c["start"]):
                what = "referred"
            yield {"citing": r["citing"], "seq": r["seq"], "pos": k, "normalized": c["normalized"], "treatment": what}

    if done is not None:
        paragraphs = paragraphs.join(done.select("citing").distinct(), "citing", "left_anti")
    found = flat_map(paragraphs.select("citing", "seq", "body"), rows, "citing string, seq int, pos int, normalized string, treatment string")
    known = found.join(aliases.select("normalized", F.col("case").alias("cited")), "normalized").where("citing <> cited")
    return dedup_edges(known, "seq", "pos").select("citing", "cited", "treatment", "seq")


SUPRA = r"((?:[A-Z][\w.'-]*\s+(?:of\s+|and\s+|the\s+|vs?\.?\s+)*){1,8})\(supra\)"


def supra_references(paragraphs: DataFrame, cited: DataFrame) -> DataFrame:
    """citing, seq, name, cited: short names before (supra), matched with titles of cases cited in the same document."""
    import re

    pattern = re.compile(SUPRA)
    names = flat_map(paragraphs, lambda r: ({"citing": r["citing"], "seq": r["seq"], "name": " ".join(m[1].split())} for m in pattern.finditer(r["body"] or "")), "citing string, seq int, name string")
    pairs = names.join(cited.select("citing", "cited", "title").distinct(), "citing")

    def pick(rows):
        by = sorted(((token_set_ratio(r["name"], r["title"]), r["cited"]) for r in rows), key=lambda x: (-x[0], x[1]))
        if by[0][0] >= SUPRA_SCORE and (len(by) < 2 or by[0][0] - by[1][0] >= SUPRA_MARGIN):
            yield {"citing": rows[0]["citing"], "seq": rows[0]["seq"], "name": rows[0]["name"], "cited": by[0][1]}

    return group_map(pairs, ["citing", "seq", "name"], ["cited"], pick, "citing string, seq int, name string, cited string")

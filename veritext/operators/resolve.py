"""Resolving citations: exact aliases, fuzzy party names, and learning of new aliases."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritext.functions.lexicon import LEARN_MARGIN, LEARN_SCORE, NAME_CHARS, NAME_FLOOR, PARTY_MARGIN, PARTY_SCORE, SIGHTINGS, SURE_SCORE
from veritext.functions.text import name_words, token_set_ratio


@F.pandas_udf(T.DoubleType())
def name_score(left, right):
    """token_set_ratio of two columns of names."""
    return left.combine(right, lambda a, b: token_set_ratio(a or "", b or ""))


def exact(citations: DataFrame, aliases: DataFrame) -> DataFrame:
    """The citations with case and status found or not_found. An alias that two cases claim goes to the smaller key."""
    one = aliases.groupBy("normalized").agg(F.min("case").alias("case"))
    return citations.join(one, "normalized", "left").withColumn("status", F.when(F.col("case").isNull(), "not_found").otherwise("found"))


#: Bins of the letter counts that a pair of names is judged by first.
LETTER_BINS = 61


def _letters(names: list[str]):
    """Counts of the letters of each name's different words, by bins, and the length of those words joined."""
    sets = [name_words(n) for n in names]
    counts = np.zeros((len(names), LETTER_BINS), np.int32)
    for row, words in zip(counts, sets):
        for c in "".join(words):
            row[ord(c) % LETTER_BINS] += 1
    return counts, np.array([sum(map(len, w)) + max(0, len(w) - 1) for w in sets], np.float64)


def may_score(left: list[str], right: list[str], a, b, least: float):
    """Whether the pairs (left[a[k]], right[b[k]]) may have a token_set_ratio of least: never false for one that has.

    Letters that one name has beyond the other are no more than the edits between their own words, nor than the
    letters of its own words; so the score is under least where they are too many for each of its three forms."""
    (x, n), (y, m) = _letters(left), _letters(right)
    free = 1 - least / 100 + 1e-6
    over = np.maximum(x[a] - y[b], 0).sum(axis=1)
    under = over - (x.sum(axis=1)[a] - y.sum(axis=1)[b])
    n, m = n[a], m[b]
    share = 2 * free / (1 + free)
    return (over + under <= free * (n + m)) | (over <= share * n) | (under <= share * m)


def alike(pairs: DataFrame, least: float) -> DataFrame:
    """name, title, score of the pairs (name, title) that score least or more."""
    def run(batches):
        for batch in batches:
            name, title = (batch.column(k).dictionary_encode() for k in (0, 1))
            left, right, a, b = name.dictionary.to_pylist(), title.dictionary.to_pylist(), name.indices.to_numpy(), title.indices.to_numpy()
            met = [(left[a[k]], right[b[k]]) for k in np.flatnonzero(may_score(left, right, a, b, least))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in met], pa.string()), pa.array([y for _, y in met], pa.string()), pa.array([token_set_ratio(x, y) for x, y in met], pa.float64())], ["name", "title", "score"])

    # Not a UDF: its filter would be pushed below the distinct of the pairs, and equal pairs be scored again and again.
    scored = pairs.select("name", "title").mapInArrow(run, "name string, title string, score double")
    return scored.withColumn("score", F.round("score", 6)).where(F.col("score") >= least)


def blocked_pairs(names: DataFrame, titles: DataFrame) -> DataFrame:
    """name, title: each different name with the titles of its years, those before and those after, or with all titles if it has no year; each pair once.

    No word need be shared: names may differ in a letter of every word."""
    asked, titles = names.where("name is not null"), titles.where("title is not null")
    dated = asked.where("year <> 0").select("name", F.explode(F.sequence(F.col("year") - 1, F.col("year") + 1)).alias("title_year")).distinct()
    met = dated.join(titles.select("title", "title_year").distinct(), "title_year").select("name", "title")
    bare = asked.where("coalesce(year, 0) = 0").select("name").distinct()
    return met.unionByName(bare.crossJoin(titles.select("title").distinct())).distinct()


def _places(names: DataFrame, titles: DataFrame, near: DataFrame) -> DataFrame:
    """name, year, title, score, case, n: the pairs near (name, title, score) for each year of the name, with the smallest case of the title and year, and their number; of all years if the name has none."""
    titles = titles.where("title is not null")
    of_year = titles.groupBy("title", "title_year").agg(F.min("case").alias("case"), F.count(F.lit(1)).alias("n")).withColumn("any_year", F.lit(False))
    of_any = titles.groupBy("title").agg(F.min("case").alias("case"), F.count(F.lit(1)).alias("n")).select("title", F.lit(0).alias("title_year"), "case", "n", F.lit(True).alias("any_year"))
    asked = names.select("name", "year").where("name is not null").distinct().withColumn("any_year", F.coalesce("year", F.lit(0)) == 0)
    years = F.when(F.col("any_year"), F.array(F.lit(0))).otherwise(F.sequence(F.col("year") - 1, F.col("year") + 1))
    wanted = asked.join(near, "name").withColumn("title_year", F.explode(years))
    return wanted.join(of_year.unionByName(of_any), ["title", "title_year", "any_year"]).select("name", "year", "title", "score", "case", "n")


def within_a_year(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two tables with equal keys whose years differ by one at most: a band join as an equi-join of three copies of one side."""
    near = left.withColumn("_year", F.explode(F.sequence(F.col("year") - 1, F.col("year") + 1))).drop("year")
    return near.join(right.withColumnRenamed("year", "_year"), [*keys, "_year"]).drop("_year")


def by_parties(names: DataFrame, titles: DataFrame, least: float = PARTY_SCORE, margin: float = PARTY_MARGIN, top: int = 5) -> DataFrame:
    """name_id, case, score, status: found, or ambiguous if a runner-up is within the margin; not_found otherwise."""
    scored = _places(names, titles, alike(blocked_pairs(names, titles), least))
    w = Window.partitionBy("name", "year").orderBy(F.desc("score"), "case")
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= min(top, 2))
    # Cases of one title tie; so do those of a title in the two years beside it.
    runner_up = F.when(F.lit(top > 1), F.max(F.when((F.col("rank") == 2) | ((F.col("rank") == 1) & (F.col("n") > 1)), F.col("score"))))
    best = ranked.groupBy("name", "year").agg(F.max(F.when(F.col("rank") == 1, F.col("case"))).alias("case"), F.max("score").alias("score"), runner_up.alias("second"))
    best = best.withColumnsRenamed({"name": "_name", "year": "_year"})
    out = names.select("name_id", "name", "year").join(best, (F.col("name") == F.col("_name")) & F.col("year").eqNullSafe(F.col("_year")), "left")
    status = F.when(F.col("case").isNull(), "not_found").when(F.col("score") - F.col("second") < margin, "ambiguous").otherwise("found")
    return out.select("name_id", "case", "score", status.alias("status"))


def name_mismatch(resolved: DataFrame) -> DataFrame:
    """Adds mismatch: the parties named are too unlike the title found, if they are long enough to tell. resolved: parties, title."""
    long_enough = F.length("parties") >= NAME_CHARS
    return resolved.withColumn("mismatch", F.coalesce(long_enough & (name_score("parties", "title") < NAME_FLOOR), F.lit(False)))


def citation_runs(spans: DataFrame, longest_gap: int = 4) -> DataFrame:
    """Adds run: citations of a document that follow each other with at most a short separator. spans: doc, start, end, gap_text (text before it).

    A new run starts where the text before a citation is more than separators."""
    w = Window.partitionBy("doc").orderBy("start")
    joins = F.col("gap_text").rlike(rf"^[\s:;=,]{{1,{longest_gap}}}$")
    return spans.withColumn("run", F.sum(F.when(joins, 0).otherwise(1)).over(w))


def paired_aliases(runs: DataFrame) -> DataFrame:
    """normalized, case: unknown aliases of runs in which all known ones name one case."""
    known = runs.where("case is not null").groupBy("doc", "run").agg(F.countDistinct("case").alias("n"), F.min("case").alias("of")).where("n = 1")
    pairs = runs.where("case is null").join(known, ["doc", "run"])
    one = pairs.groupBy("normalized").agg(F.countDistinct("of").alias("n"), F.min("of").alias("case"))
    return one.where("n = 1").select("normalized", "case")


def accept_sightings(sightings: DataFrame) -> DataFrame:
    """normalized, case, verdict over sightings (normalized, case, score, citing): conflict, accepted (sure score or enough citing documents) or held."""
    g = sightings.groupBy("normalized").agg(F.countDistinct("case").alias("cases"), F.max_by("case", F.struct("score", "case")).alias("case"), F.max("score").alias("score"), F.countDistinct("citing").alias("citing"))
    verdict = F.when(F.col("cases") > 1, "conflict").when((F.col("score") >= SURE_SCORE) | (F.col("citing") >= SIGHTINGS), "accepted").otherwise("held")
    return g.select("normalized", "case", "score", "citing", verdict.alias("verdict"))


def learn_aliases(names: DataFrame, titles: DataFrame) -> DataFrame:
    """Accepted aliases of party names that match one title clearly. names: name_id, name, year, normalized, citing."""
    best = by_parties(names.select("name_id", "name", "year"), titles, LEARN_SCORE, LEARN_MARGIN).where("status = 'found'")
    return accept_sightings(best.join(names.select("name_id", "normalized", "citing"), "name_id"))


def preferred_citation(aliases: DataFrame) -> DataFrame:
    """case, citation: one per case by reporter (SCC, SCR, AIR, others), ties by the citation's text."""
    order = F.when(F.col("reporter") == "SCC", 0).when(F.col("reporter") == "SCR", 1).when(F.col("reporter") == "AIR", 2).otherwise(3)
    return aliases.groupBy("case").agg(F.min_by("citation", F.struct(order, "citation")).alias("citation"))

"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, mixing.

Each stage applies one operator to all that the stage before kept, and its
decisions take effect; the columns stay those of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.llm.common import Scratch, table
from veritext.llm.decontaminate import contamination
from veritext.llm.language_id import UNDETERMINED, identify
from veritext.llm.line_dedup import dedup_lines
from veritext.llm.mixing import weighed
from veritext.llm.near_dedup import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if its language score is under SLACK times the median of the training documents with a right prediction
#: and about its number of n-grams (the median, since garbage that carries a language's label scores low but "right");
#: groups of under LEAST such documents take the lowest of the others' thresholds.
SLACK, LEAST = 0.33, 20


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the profiles know, whose lang becomes the predicted one.

    Those without letters, and those whose score is low beside the scores of rightly predicted training documents
    of their size, go; null text counts as empty, a wrong or null lang is replaced, repeated rows stay or go
    together, an empty table stays empty."""
    scored = Scratch(spark, "language").write(identify(docs.select(*COLUMNS), keep=COLUMNS), "scored")
    size = F.floor(F.log2(F.col("n_ranked").cast("double"))).cast("int")  # at most 9 groups
    right = scored.where(~F.col("held_out") & F.col("doc_id").isNotNull() & (F.col("lang_pred") == F.col("lang")) & (F.col("n_ranked") > 0))
    # Scores in thousandths, so that the quantile keeps at most a thousand numbers a group.
    found = right.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n"), F.expr("percentile(floor(score * 1000), 0.5)").alias("q")).collect()
    least = {r["size"]: SLACK * r["q"] / 1000 for r in found if r["n"] >= LEAST}
    lowest = min(least.values(), default=0.0)
    needed = F.create_map(*[F.lit(x) for k, v in least.items() for x in (k, v)]) if least else None
    threshold = F.coalesce(needed[size], F.lit(lowest)) if least else F.lit(lowest)
    kept = scored.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= threshold))
    return kept.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col(c) for c in COLUMNS])


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that earlier ones have; those left without text go. n_chars is counted anew.

    Null and empty texts and null ids stay as they are; an empty table stays empty."""
    out = dedup_lines(docs.select(*COLUMNS)).where("_n_removed = 0 or trim(text) <> ''")
    return out.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id.

    Documents without words, and those without an id, stay; rows that repeat a kept id stay together."""
    dropped = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    # The merge join moves alike at every size; a group of copies may be most of the corpus.
    return docs.join(dropped.hint("merge"), "doc_id", "left_anti").select(*COLUMNS)


def no_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised ones included. Null and empty texts stay."""
    found = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id", "tag").distinct()
    tagged = docs.withColumn("_tag", F.xxhash64(F.coalesce("text", F.lit(""))))
    return tagged.join(found.withColumnRenamed("doc_id", "_id"), F.col("_tag").eqNullSafe(F.col("tag")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample at the target weights of sources, predicted languages and topics; rows of one id stay or go together."""
    return weighed(docs).where("_kept").select(*COLUMNS)


STAGES = [
    ("language", known_language),
    ("lines", unique_lines),
    ("near-copies", no_near_copies),
    ("benchmark", no_benchmark_text),
    ("mix", mixed),
]

#: Language profiles and patience diff have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each result is written and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.write(docs, f"{i}-{name}")
    return docs

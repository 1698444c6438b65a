"""Exact deduplication with a log-structured merge index of text digests.

Each task fills a memtable (digest -> smallest id, count), flushes it as a run
sorted by digest with a Bloom filter per row group, and compaction merges the
runs of all tasks, keeping the smallest id. Digests that more than one row
carries are hits; the rows of hits are read again and compared byte by byte.

Defined results: a null text counts as empty, and empty texts are equal; a row
with a null id never stays before one with an id, and stays if all its equals
have none; rows that repeat an id and its text stay together; an empty table
gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritext.llm.common import Bitmap, Scratch, id_keys, table

#: Digests that a task holds before it flushes a run (about 100 MB of Python objects).
MEMTABLE_ROWS = 400_000


def normalised(text_col: str) -> F.Column:
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


class DigestIndex:
    """The merge index over one scratch folder: `flush` adds runs, `compact` merges them, `hits` lists repeated digests."""

    def __init__(self, scratch: Scratch, memtable_rows: int = MEMTABLE_ROWS):
        self.scratch, self.memtable_rows, self.runs, self.level = scratch, memtable_rows, [], None

    def flush(self, digests: DataFrame) -> None:
        """Adds rows (digest binary, id long) as sorted runs."""
        most = self.memtable_rows

        def fill(batches):
            memtable: dict[bytes, list] = {}

            def run():
                keys = sorted(memtable)
                return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([memtable[k][0] for k in keys], pa.int64()), pa.array([memtable[k][1] for k in keys], pa.int64())], ["digest", "keep_id", "n"])

            for batch in batches:
                for digest, i in zip(batch.column("digest").to_pylist(), batch.column("id").to_pylist()):
                    held = memtable.get(digest)
                    if held is None:
                        if len(memtable) >= most:
                            yield run()
                            memtable.clear()
                        memtable[digest] = [i, 1]
                    else:
                        held[1] += 1
                        if i is not None and (held[0] is None or i < held[0]):
                            held[0] = i
            yield run()

        run = digests.select("digest", "id").mapInArrow(fill, "digest binary, keep_id long, n long")
        self.runs.append(self.scratch.write(run, f"run-{len(self.runs)}", **{"parquet.bloom.filter.enabled#digest": "true"}))

    def compact(self) -> DataFrame:
        """Merges all runs and the last level into one level: digest, keep_id (smallest), n."""
        parts = self.runs + ([self.level] if self.level is not None else [])
        merged = parts[0]
        for part in parts[1:]:
            merged = merged.unionByName(part)
        merged = merged.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n")).sortWithinPartitions("digest")
        self.level, self.runs = self.scratch.write(merged, f"level-{len(parts)}-{id(merged)}", **{"parquet.bloom.filter.enabled#digest": "true"}), []
        return self.level

    def hits(self) -> DataFrame:
        return self.level.where("n > 1")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    digest_bytes shortens the index key; byte verification then separates texts
    that share a key (tests use it to force such clashes)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    text = docs.select(F.col(id_col).cast("long").alias("id"), normalised(text_col).alias("norm"))
    sha = F.unhex(F.sha2(F.col("norm"), 256))
    digests = scratch.write(text.select("id", sha.alias("sha"), F.substring(sha, 1, digest_bytes).alias("digest")), "digests")
    index = DigestIndex(scratch, memtable_rows)
    index.flush(digests)
    index.compact()

    # Rows of hits come back by a bit map on their ids, so texts that occur once
    # are never normalised, hashed or moved again. Grouping by the text itself
    # compares bytes, and merges the copies within a task before the shuffle.
    members = scratch.write(digests.join(index.hits().select("digest"), "digest", "left_semi").select(id_keys("id").alias("key")), "members")
    in_hits = Bitmap(spark, members, "key").test()

    @F.pandas_udf(T.BooleanType())
    def maybe(keys):
        import pandas as pd

        return pd.Series(in_hits(keys.to_numpy()))

    again = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(maybe(id_keys("id"))).select("id", normalised("text").alias("norm"))
    groups = again.groupBy("norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    verified = scratch.write(groups.select(sha.alias("sha"), F.substring(sha, 1, digest_bytes).alias("digest"), "keep_id", "group_size"), "verified")
    own = F.col("group_size").isNull()
    return digests.join(verified.select("sha", "keep_id", "group_size"), "sha", "left").select(
        F.col("id").alias(id_col),
        F.when(own, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(own, F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""

"""Line deduplication by pairwise alignment.

Lines are compared without surrounding white space, by a 128-bit hash; blank
lines never match by themselves. Documents are paired through hashed runs of
lines: the least runs of consecutive lines with MIN_CHARS characters, from each
line on and up to each line. Each run that several documents hold pairs every
later document with the run's first one, so two documents that share a block of
MIN_CHARS, at any frequency, meet in some chain of pairs, a run costs one
row an occurrence, and copies of one document pair with its first copy only.

A pair is aligned by patience diff: equal heads and tails match, lines that are
unique in both anchor the alignment in their longest common order, and the gaps
between anchors are aligned again. Aligned blocks of at least MIN_CHARS
characters are deleted from the later document. Shared runs of the pair that no
monotone alignment can hold (a block that moved before another, or that stands
twice in the later document) are blocks of the same pair too and go as moved
ones; `_n_moved` counts their lines. The first document to hold a run keeps it,
so no text vanishes altogether.

Defined results: null or empty text has no lines and stays as it is; equal ids
are one document, whose rows are never compared with each other and are each
rewritten by their own lines; a null id is never compared; ties of the
alignment go to the earlier line; an empty table gives an empty result; other
columns pass through, but for those named as the added ones.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.llm.common import Bitmap, Scratch, chunks, id_keys, long_lists, slices, table, unused

MIN_CHARS = 40


def line_hashes(text: str | None) -> tuple[list[bytes], list[int]]:
    """Hash and length of each stripped line; blank lines hash to b''."""
    lines = [x.strip() for x in (text or "").split("\n")]
    return [xxhash.xxh3_128_digest(x) if x else b"" for x in lines], [len(x) for x in lines]


def _outline(batches):
    for batch in chunks(batches, 2):
        got = [line_hashes(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([h for h, _ in got], pa.list_(pa.binary())), long_lists([np.array(n) for _, n in got], pa.int32())], ["id", "tag", "lines", "chars"])


def _anchors(old: list[bytes], new: list[bytes]) -> list[tuple[int, int]]:
    """Lines that are unique in both, as (position in old, position in new), in their longest common order."""
    def unique(lines):
        at: dict[bytes, int] = {}
        for i, x in enumerate(lines):
            at[x] = -1 if x in at else i
        return at

    there = unique(old)
    pairs = [(there[x], i) for x, i in unique(new).items() if x and i >= 0 and there.get(x, -1) >= 0]
    tails, links, ends = [], [], []  # longest increasing subsequence of the positions in old; pairs are in order of new
    for k, (i, _) in enumerate(pairs):
        p = bisect_left(tails, i)
        links.append(ends[p - 1] if p else -1)
        tails[p : p + 1], ends[p : p + 1] = [i], [k]
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(pairs[k])
        k = links[k]
    return chain[::-1]


def patience_blocks(old: list[bytes], new: list[bytes]) -> list[tuple[int, int, int]]:
    """Aligned common blocks (start in old, start in new, lines), in order."""
    matched, gaps = [], [(0, len(old), 0, len(new))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and old[a] == new[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and old[b - 1] == new[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        chain = _anchors(old[a:b], new[c:d]) if a < b and c < d else []
        low_old, low_new = a, c
        for i, j in [(a + i, c + j) for i, j in chain]:
            matched.append((i, j))
            gaps.append((low_old, i, low_new, j))
            low_old, low_new = i + 1, j + 1
        if chain:
            gaps.append((low_old, b, low_new, d))
    blocks: list[tuple[int, int, int]] = []
    for i, j in sorted(matched):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks


def doomed_lines(old: list[bytes], new: list[bytes], chars: list[int], min_chars: int = MIN_CHARS) -> list[int]:
    """Lines of the later document in aligned blocks that are long enough; blank lines count for nothing."""
    out = []
    for _, at, n in patience_blocks(old, new):
        if sum(chars[at : at + n]) >= min_chars:
            out.extend(range(at, at + n))
    return out


def least_runs(chars: list[int], min_chars: int = MIN_CHARS) -> list[tuple[int, int]]:
    """First and last line of the least runs of at least min_chars characters, from each line on and up to each line; they don't start or end blank."""
    upto = np.cumsum(np.array(chars, dtype=np.int64))
    before = upto - chars
    lines = np.flatnonzero(np.array(chars, dtype=np.int64))
    ends = np.searchsorted(upto, before[lines] + min_chars)
    starts = np.searchsorted(before, upto[lines] - min_chars, "right") - 1
    return sorted({(int(s), int(e)) for s, e in zip(lines, ends) if e < len(chars)} | {(int(s), int(e)) for s, e in zip(starts, lines) if s >= 0})


def run_key(lines: list[bytes]) -> bytes:
    """One hash for a run of line hashes; blank lines count in it."""
    return lines[0] if len(lines) == 1 else xxhash.xxh3_128_digest(b"".join(x or bytes(16) for x in lines))


def _runs(batches):
    for batch in slices(batches, (2,)):
        ids, tags, keys, starts, ends = [], [], [], [], []
        for i, tag, lines, chars in zip(*(c.to_pylist() for c in batch.columns)):
            for s, e in least_runs(chars):
                ids.append(i)
                tags.append(tag)
                keys.append(run_key(lines[s : e + 1]))
                starts.append(s)
                ends.append(e)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(keys, pa.binary()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["id", "tag", "run", "start", "end"])


def _align(batches):
    """Rows (id, tag, old, lines, chars, runs) of pairs to the doomed lines: aligned ones, and those of shared runs left over."""
    for batch in slices(batches, (2, 3)):
        out = []
        for i, tag, old, new, chars, runs in zip(*(c.to_pylist() for c in batch.columns)):
            aligned = set(doomed_lines(old, new, chars))
            moved = {k for r in runs for k in range(r["start"], r["end"] + 1)} - aligned
            out.append((i, tag, sorted(aligned), sorted(moved)))
        cols = list(zip(*out)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["id", "tag", "aligned", "moved"])


def deletions(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, tag, doomed, moved): indexes of the lines to delete from each later document of a pair, and how many of them are moved ones only. docs: id, tag (a hash of the text), text."""
    outline = scratch.write(docs.where("id is not null").mapInArrow(_outline, "id long, tag long, lines array<binary>, chars array<int>"), "outline")
    runs = outline.mapInArrow(_runs, "id long, tag long, run binary, start int, end int")
    owners = runs.groupBy("run").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    # Written first, so that the join deals both sides itself and a frequent run can be split.
    owners = scratch.write(owners.select("run", "first"), "owners")
    shared = runs.join(owners, "run").where("id <> first")
    pairs = scratch.write(shared.groupBy("first", "id", "tag").agg(F.collect_list(F.struct("start", "end")).alias("runs")), "pairs")
    earlier = outline.select(F.col("id").alias("first"), F.col("lines").alias("old"))
    both = pairs.join(outline, ["id", "tag"]).join(earlier, "first").select("id", "tag", "old", "lines", "chars", "runs")
    found = both.mapInArrow(_align, "id long, tag long, aligned array<int>, moved array<int>")
    each = found.groupBy("id", "tag").agg(F.array_distinct(F.flatten(F.collect_list("aligned"))).alias("aligned"), F.array_distinct(F.flatten(F.collect_list("moved"))).alias("moved"))
    return each.select("id", "tag", F.array_union("aligned", "moved").alias("doomed"), F.size(F.array_except("moved", "aligned")).cast("long").alias("moved"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, without deleted lines, and _n_lines, _n_removed and _n_moved.

    Lines stay as they are and in order; a document that loses all its lines has empty text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    tag = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    doomed = scratch.write(deletions(docs.select(F.col(id_col).cast("long").alias("id"), tag.alias("tag"), F.col(text_col).alias("text")), scratch), "doomed")
    touched = Bitmap(spark, doomed.select(id_keys("id").alias("key")), "key").test()

    @F.pandas_udf("boolean")
    def maybe(keys):
        import pandas as pd

        return pd.Series(touched(keys.to_numpy()))

    # Untouched documents, known by a bit map on ids, pass without a shuffle. The
    # others meet their lines by a merge join at any size.
    docs = docs.drop("_n_lines", "_n_removed", "_n_moved")
    flag, gone, moved, key, mark = (unused(docs, x) for x in ("_maybe", "_doomed", "_moved", "_key", "_mark"))
    marked = docs.withColumn(flag, F.col(id_col).isNotNull() & maybe(id_keys(id_col)))
    calm = marked.where(~F.col(flag)).drop(flag).withColumn(gone, F.lit(None).cast("array<int>")).withColumn(moved, F.lit(None).cast("long"))
    theirs = doomed.select(F.col("id").alias(key), F.col("tag").alias(mark), F.col("doomed").alias(gone), F.col("moved").alias(moved)).hint("merge")
    cut = marked.where(F.col(flag)).drop(flag).join(theirs, (F.col(id_col).cast("long") == F.col(key)) & (tag == F.col(mark)), "left").drop(key, mark)
    lines = F.split(F.col(text_col), "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains(gone, i))
    counts = F.when(F.coalesce(F.col(text_col), F.lit("")) == "", 0).otherwise(F.size(lines)).cast("long")
    out = calm.unionByName(cut).withColumn("_n_lines", counts).withColumn("_n_removed", F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")).withColumn("_n_moved", F.coalesce(moved, F.lit(0).cast("long")))
    return out.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))).drop(gone, moved)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, n_moved and the digest of the text that is left, per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.col("_n_moved").alias("n_moved"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))

"""Removal of repeated 13-word windows, by recompression.

Words become 64-bit names. A round first renames each run of one name (by name
and length), then splits the names in two halves by a bit of a hash and
replaces each pair of a left and a right name by one new name. Names come from
content only, so all tasks name equal runs and pairs alike without an exchange,
and equal stretches of text get equal symbols except near their borders. For
each symbol the kernel keeps the stretch of words that decides it. A window
that holds this stretch holds the symbol, wherever the window occurs.

1. Each window takes as its anchor its longest decided symbol (ties: largest
   name), or itself if it holds none; a document reports its distinct anchors.
2. Anchors of two or more documents make a bit map of bounded size.
3. Windows whose anchor is in it are the candidates; their exact 96-bit hashes
   meet in one shuffle, in which all but the first document's are repeats.
   Repeats within one Arrow batch never travel, so a passage that a third of
   all documents share costs a row per batch.
4. Documents with repeats (another bit map) are read again and rewritten.

Defined results: null text has no words; texts of under 13 words stay whole;
ties (equal ids) are one document, and windows it repeats itself stay; a null
id counts as larger than all others; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.llm.common import Bitmap, Scratch, chunks, hash_words, id_keys, long_lists, mix, signed, table, utf8

WINDOW = 13
ROUNDS = 3
#: Copies whose ids are shipped to tasks so they don't report anchors (8 bytes each); those beyond it do.
MAX_COPIES = 4_000_000
NULL_ID = 2**63 - 1
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_SEPARATOR = np.uint64(0x5E9A)


def recompress(names: np.ndarray, barrier: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """Symbols after some rounds: names, first word, end, and the stretch of words [low, high) that decides each.

    barrier marks separators between documents, which take part in nothing."""
    n = len(names)
    start, end = np.arange(n), np.arange(1, n + 1)
    low, high = start.copy(), end.copy()
    barrier = barrier.copy()
    for r in range(rounds):
        if r == 0:  # runs of a word; later rounds see a repeated pair as equal neighbours, which never pair up
            new = np.concatenate([[True], (names[1:] != names[:-1]) | barrier[1:]])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(names)) - 1
            length = (last - first + 1).astype(np.uint64)
            low, high = low[first] - 1, high[last] + 1  # -1 and n + 1 lie in no window
            names, start, end, barrier = np.where(length > 1, mix(names[first] + length * np.uint64(0x9E3779B97F4A7C15)), names[first]), start[first], end[last], barrier[first]
        side = mix(names + np.uint64(r + 1)) >> np.uint64(63)
        left, right = (side == 0) & ~barrier, (side == 1) & ~barrier
        pair = np.zeros(len(names), dtype=bool)
        pair[:-1] = left[:-1] & right[1:]
        second = np.concatenate([[False], pair[:-1]])
        # A single left name is decided by its successor too, a single right one by its predecessor.
        alone_left, alone_right = left & ~pair, right & ~second
        next_low, next_high = np.append(low[1:], n), np.append(high[1:], n + 1)
        prev_low, prev_high = np.concatenate([[-1], low[:-1]]), np.concatenate([[0], high[:-1]])
        new_low = np.where(alone_right, np.minimum(low, prev_low), np.where(alone_left, np.minimum(low, next_low), low))
        new_high = np.where(alone_right, np.maximum(high, prev_high), np.where(alone_left, np.maximum(high, next_high), high))
        at = np.flatnonzero(pair)
        names = names.copy()
        names[at] = mix(mix(names[at] + np.uint64(0xD6E8FEB86659FD93)) + names[at + 1])
        end = end.copy()
        end[at] = end[at + 1]
        new_low[at], new_high[at] = np.minimum(low[at], low[at + 1]), np.maximum(high[at], high[at + 1])
        keep = ~second
        names, start, end, low, high, barrier = names[keep], start[keep], end[keep], new_low[keep], new_high[keep], barrier[keep]
    return names, start, end, low, high, barrier


def window_hashes(names: np.ndarray, multiplier: int) -> np.ndarray:
    """A hash of the names of each window of 13 (position p: names p to p + 12)."""
    n = max(0, len(names) - WINDOW + 1)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        total *= np.uint64(multiplier)
        total += names[k : k + n]
    return mix(total)


def anchors(names: np.ndarray, barrier: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The anchor of each window; windows over a separator get some value that nobody reads."""
    sym, start, end, low, high, bar = recompress(names, barrier)
    ok = ~bar & (high - low <= WINDOW)
    sym, low, high, size = sym[ok], low[ok], high[ok], (end - start)[ok]
    rank = (size.astype(np.uint64) << np.uint64(58)) | (sym >> np.uint64(6))
    best = np.zeros(len(hashes), dtype=np.uint64)
    for t in range(WINDOW):  # the windows that hold [low, high) start in [high - 13, low]
        at = high - WINDOW + t
        use = (at <= low) & (at >= 0) & (at < len(best))
        np.maximum.at(best, at[use], rank[use])
    whole = (np.uint64(WINDOW) << np.uint64(58)) | (hashes >> np.uint64(6))
    return np.where(best > 0, best, whole)


def _laid_out(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of documents end to end, a separator after each: names, barrier, first word and end of each document."""
    hashes, counts = hash_words(texts)
    ends = np.cumsum(counts + 1) - 1
    barrier = np.zeros(len(hashes) + len(counts), dtype=bool)
    barrier[ends] = True
    names = np.full(len(barrier), _SEPARATOR, dtype=np.uint64)
    names[~barrier] = hashes
    return names, barrier, ends - counts, ends


def _windows_of(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions of all windows that lie within a document, in order."""
    n = np.maximum(0, ends - starts - WINDOW + 1)
    return np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def _tag(text_col: str) -> F.Column:
    """Part of a hash of the text that tells apart rows of one id."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def _copy_keys(ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    return mix(mix(ids.astype(np.int64).view(np.uint64)) + tags.astype(np.int64).view(np.uint64))


def _report(batches):
    for batch in chunks(batches, 2, 1_000_000):
        texts = utf8(batch.column(2))
        names, barrier, starts, ends = _laid_out(texts)
        own = anchors(names, barrier, window_hashes(names, 0x9E3779B97F4A7C15)) if len(names) >= WINDOW else np.empty(0, dtype=np.uint64)
        lists = [signed(np.unique(own[s : max(s, e - WINDOW + 1)])) for s, e in zip(starts.tolist(), ends.tolist())]
        shas = [hashlib.sha256(b" ".join((t or b"").split())).digest() for t in texts]  # bytes.split knows the contract's separators only
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends - starts, pa.int64()), pa.array(shas, pa.binary()), long_lists(lists, pa.int64())], ["id", "tag", "n_words", "sha", "anchors"])


def _lists(flat: np.ndarray, doc: np.ndarray, docs: int, kind: pa.DataType) -> pa.Array:
    """A list column of values that are ordered by document."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=docs))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def _later(batches):
    """Windows (h1, h2, id, at), sorted, one batch after another: those of all but the smallest id of each window."""
    carried = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, ids, at = (np.asarray(batch.column(k)) for k in range(4))
        new = np.concatenate([[carried is None or carried[:2] != (h1[0], h2[0])], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        first = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))
        least = np.where(first < 0, carried[2] if carried else 0, ids[first])
        carried = (h1[-1], h2[-1], least[-1])
        later = ids > least
        yield pa.RecordBatch.from_arrays([pa.array(ids[later]), pa.array((at[later] >> 32).astype(np.int32)), pa.array((at[later] & 0xFFFFFFFF).astype(np.int32))], ["id", "tag", "pos"])


def _rewrite(batches):
    """Rows (id, tag, text, positions of repeated windows) without the covered words."""
    for batch in chunks(batches, 2):
        out = []
        for text, starts in zip(utf8(batch.column(2)), batch.column(3).to_pylist()):
            words = (text or b"").split()
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            starts = np.unique(np.array(starts, dtype=np.int64))
            edge[starts] += 1
            edge[starts + WINDOW] -= 1
            kept = [w for w, c in zip(words, np.cumsum(edge)[:-1].tolist()) if not c]
            out.append((len(words) - len(kept), b" ".join(kept)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([n for n, _ in out], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for _, t in out], pa.string()), pa.array([t for _, t in out], pa.binary()).cast(pa.string())],
            ["id", "tag", "n_removed", "kept_sha256", "kept_text"],
        )


def repeated_windows(docs: DataFrame, scratch: Scratch, report: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, tag, positions) of documents that have windows of an earlier one, and (id, tag) of whole copies, which it leaves out."""
    spark = docs.sparkSession
    # Whole copies lose every word to the first of them and can't be first anywhere else.
    # Written first, so that the join deals both sides itself and a large group of copies can be split.
    firsts = report.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    firsts = scratch.write(firsts.select("sha", "first"), "firsts")
    copies = scratch.write(report.select("id", "tag", "sha", "n_words").join(firsts, "sha").where(f"id > first and n_words >= {WINDOW}").select("id", "tag", "n_words"), "copies")
    # As many as the list holds are spared the steps below; any others take them like all documents, to the same result.
    rows = copies.select("id", "tag").limit(MAX_COPIES).toPandas()
    known = np.sort(_copy_keys(rows["id"].to_numpy(), rows["tag"].to_numpy())) if len(rows) else np.zeros(1, dtype=np.uint64)
    known = spark.sparkContext.broadcast(known)

    def original(ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
        keys, held = _copy_keys(ids, tags), known.value
        return held[np.minimum(np.searchsorted(held, keys), len(held) - 1)] != keys

    def spread(batches):
        for batch in batches:
            lists = batch.column(2).filter(pa.array(original(np.asarray(batch.column(0)), np.asarray(batch.column(1)))))
            yield pa.RecordBatch.from_arrays([lists.flatten()], ["anchor"])

    counted = report.select("id", "tag", "anchors").mapInArrow(spread, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    shared = scratch.write(counted.where("n > 1").select("anchor"), "shared")
    in_shared = Bitmap(spark, shared, "anchor").test()

    def candidates(batches):
        for part in chunks(batches, 2, 3_000_000):
            part = part.filter(pa.array(original(np.asarray(part.column(0)), np.asarray(part.column(1)))))
            ids, tags = np.asarray(part.column(0)), part.column(1)
            names, barrier, starts, ends = _laid_out(utf8(part.column(2)))
            if len(names) < WINDOW:
                continue
            h1 = window_hashes(names, 0x9E3779B97F4A7C15)
            here = _windows_of(starts, ends)
            here = here[in_shared(anchors(names, barrier, h1)[here])]
            h1, h2 = signed(h1[here]), (window_hashes(names, 0xC2B2AE3D27D4EB4F)[here] >> np.uint64(33)).astype(np.int64)
            doc = np.searchsorted(ends, here, side="right")
            at = here - starts[doc]
            # Of equal windows in these documents only those of the smallest id go on; the others are repeats already.
            order = np.lexsort((ids[doc], h2, h1))
            new = np.concatenate([[True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])])[: len(order)]
            least = np.empty(len(order), dtype=np.int64)
            least[order] = ids[doc[order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]]]
            repeat = ids[doc] > least
            go = ~repeat
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), tags, _lists(at[repeat], doc[repeat], n, pa.int32()), _lists(h1[go], doc[go], n, pa.int64()), _lists(h2[go], doc[go], n, pa.int32()), _lists(at[go], doc[go], n, pa.int32())],
                ["id", "tag", "repeats", "h1", "h2", "pos"],
            )

    found = scratch.write(docs.mapInArrow(candidates, "id long, tag int, repeats array<int>, h1 array<long>, h2 array<int>, pos array<int>"), "windows")
    meet = found.where("size(h1) > 0").select("id", "tag", F.explode(F.arrays_zip("h1", "h2", "pos")).alias("w"))
    meet = meet.select("w.h1", "w.h2", "id", F.shiftleft(F.col("tag").cast("long"), 32).bitwiseOR(F.col("w.pos").cast("long")).alias("at"))
    later = meet.repartition("h1").sortWithinPartitions("h1", "h2", "id").mapInArrow(_later, "id long, tag int, pos int")
    positions = later.groupBy("id", "tag").agg(F.collect_list("pos").alias("repeats")).unionByName(found.where("size(repeats) > 0").select("id", "tag", "repeats"))
    return positions.groupBy("id", "tag").agg(F.flatten(F.collect_list("repeats")).alias("repeats")), copies


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256, and kept_text if asked for.

    The kept words are joined by one space; kept_text is null where nothing was removed."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring-dedup")
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), _tag(text_col).alias("tag"), F.col(text_col).alias("text"))
    report = scratch.write(source.mapInArrow(_report, "id long, tag int, n_words long, sha binary, anchors array<long>"), "report")
    positions, copies = repeated_windows(source, scratch, report)
    positions = scratch.write(positions, "positions")
    changed = Bitmap(spark, positions.select(id_keys("id").alias("key")), "key").test()

    def pick(batches):
        for batch in batches:
            yield batch.filter(pa.array(changed(np.asarray(batch.column(3))))).select(["id", "tag", "text"])

    texts = source.withColumn("key", id_keys("id")).mapInArrow(pick, "id long, tag int, text string")
    rewritten = texts.join(positions, ["id", "tag"]).select("id", "tag", "text", "repeats").mapInArrow(_rewrite, "id long, tag int, n_removed long, kept_sha256 string, kept_text string")
    whole = copies.select("id", "tag", F.col("n_words").alias("n_removed"), F.lit(EMPTY_SHA).alias("kept_sha256"), F.lit("").alias("kept_text"))
    if not with_text:
        rewritten, whole = rewritten.drop("kept_text"), whole.drop("kept_text")
    changes = rewritten.unionByName(whole).dropDuplicates(["id", "tag"])
    out = report.select("id", "tag", "n_words", "sha").join(changes, ["id", "tag"], "left")
    return out.select(
        F.when(F.col("id") != NULL_ID, F.col("id")).alias(id_col),
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"),
        *(["kept_text"] if with_text else []),
    )


def op9_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


SQL = """
WITH words AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS MATERIALIZED (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS x FROM words WHERE len(w) >= 13
), firsts AS (SELECT x, min(doc_id) AS first FROM windows GROUP BY x
), hits AS (SELECT DISTINCT doc_id, p FROM windows JOIN firsts USING (x) WHERE doc_id > first
), covered AS (SELECT DISTINCT doc_id, p + k AS p FROM hits, range(13) t(k)
), each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM words
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM each ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

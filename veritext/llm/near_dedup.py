"""Near-duplicate detection with min-max hashing.

Every permutation of the shingle space gives two signature values, its minimum
and its maximum, so a signature of 128 values costs 64 hash evaluations a
shingle. Bands of two permutations (four values) put documents in buckets:
documents of similarity 0.75 miss each other in all 32 bands with probability
(1 - 0.75**4)**32 < 6e-6, and links are confirmed on the full shingle sets.

Shape: equal sets collapse first; bucket mates of the remaining classes are
joined to the smallest id of the bucket only, and the connected parts of that
star graph are the units in which sets meet. A part with more than
BLOCK_SHINGLES shingles is cut into blocks and every pair of blocks meets in a
task of its own. A task finds every link between its documents and returns a
spanning forest of them, never the pairs.

Defined results: null or empty text has the empty set, n_shingles 0, and its
own component. A document is its id: rows that repeat an id with other text
count as one document holding all the texts' links. An id of null is its own
component and is kept. Ties go to the smallest id. An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritext.llm.common import Bitmap, Scratch, chunks, connected_components, grouped, hash_words, id_keys, long_lists, mix, signed, table, utf8

SHINGLE_WORDS, BANDS, PERMUTATIONS = 5, 32, 64
#: Shingles of the documents of one block; two blocks of 64-bit hashes are in a task at once.
BLOCK_SHINGLES = 400_000
SEED = 20240229


def shingles(texts: list[bytes | None]) -> list[np.ndarray]:
    """Distinct 64-bit hashes of each text's 5-word shingles; fewer words make one shingle."""
    h, counts = hash_words(texts, lower=True)
    n = max(0, len(h) - SHINGLE_WORDS + 1)
    every = np.empty(0, dtype=np.uint64)
    if n:
        every = mix(h[:n])
        for k in range(1, SHINGLE_WORDS):
            every = mix(every + h[k : k + n])
    out, at = [], 0
    for c in counts.tolist():
        if c >= SHINGLE_WORDS:
            out.append(np.unique(every[at : at + c - SHINGLE_WORDS + 1]))
        elif c:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[at : at + c].tobytes())], dtype=np.uint64))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        at += c
    return out


def signature_bands(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One bucket key per band from the minima and maxima of all permutations."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    high = np.zeros(PERMUTATIONS, dtype=np.uint64)
    for s in range(0, len(values), 4096):
        m = values[s : s + 4096, None] * a
        m += b
        np.minimum(low, m.min(0), out=low)
        np.maximum(high, m.max(0), out=high)
    per = PERMUTATIONS // BANDS
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in (low, high):
        for k in range(per):
            key = mix(key + part[k::per])
    return key


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def _signatures(batches):
    a, b = _permutations()
    for batch in chunks(batches, 1):
        values = shingles(utf8(batch.column(1)))
        bands = [signature_bands(v, a, b) if len(v) else v for v in values]
        digests = [xxhash.xxh3_128_digest(v.tobytes()) if len(v) else None for v in values]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(v) for v in values], pa.int64()), pa.array(digests, pa.binary()), long_lists([signed(x) for x in bands], pa.int64())], ["id", "n_shingles", "digest", "bands"])


def links_forest(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int = 75) -> list[tuple[int, int]]:
    """A spanning forest of the links within one group of documents.

    side: the block of each document; with two blocks only links across count.
    A link: percent * |union| <= 100 * |intersection|. Overlaps of a document
    with all earlier ones are counted from the postings of its shingles."""
    n = len(ids)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    ranked, owners = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    many = np.diff(np.append(first, len(ranked)))
    at = np.empty(len(flat), dtype=np.int64)
    at[order] = np.repeat(np.arange(len(first)), many)
    ends = np.cumsum(sizes)
    across, forest = len(np.unique(side)) > 1, []
    for i in range(1, n):
        codes = at[ends[i] - sizes[i] : ends[i]]
        codes = codes[many[codes] > 1]
        if not len(codes):
            continue
        starts, counts = first[codes], many[codes]
        spans = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        both = np.bincount(owners[spans], minlength=n)[:i]
        linked = 100 * both >= percent * (sizes[:i] + sizes[i] - both)
        if across:
            linked &= side[:i] != side[i]
        for j in np.flatnonzero(linked):
            x, y = root(i), root(int(j))
            if x != y:
                parent[max(x, y)] = min(x, y)
                forest.append((int(ids[i]), int(ids[j])))
    return forest


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed_docs = scratch.write(source.mapInArrow(_signatures, "id long, n_shingles long, digest binary, bands array<long>"), "signatures")

    classes = scratch.write(signed_docs.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.max("n_shingles").alias("n")), "classes")
    # Bucket keys of class representatives only: copies share their sets and need no buckets.
    keys = signed_docs.select("id", "n_shingles", "digest", "bands").join(classes.select("digest", "rep"), "digest").where("id = rep").select("rep", F.explode("bands").alias("bucket"))
    keys = scratch.write(keys, "keys")
    mates = keys.groupBy("bucket").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most")
    # A document joins the smallest of its buckets' smallest ids, and so do those ids: as connected as
    # one edge for each document and bucket, but many documents of a group of copies share their edges.
    met = keys.join(mates, "bucket").select("rep", "least").withColumn("dst", F.min("least").over(Window.partitionBy("rep")))
    stars = met.select(F.col("rep").alias("src"), "dst").unionByName(met.select(F.col("least").alias("src"), "dst")).where("src <> dst").distinct()
    stars = scratch.write(stars, "stars")
    scratch.drop("keys")
    parts = connected_components(scratch, stars, "parts")

    sized = parts.join(classes.select(F.col("rep").alias("node"), "n"), "node")
    weights = sized.groupBy("component").agg(F.sum("n").alias("weight"))
    # Blocks by a hash of the id; a block pair (i, j) is one task's group, and a part of one block is the group (0, 0).
    placed = sized.join(weights, "component").withColumn("blocks", F.ceil(F.col("weight") / F.lit(BLOCK_SHINGLES)).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.select("node", "component", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("node", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("block").alias("side"))
    placed = scratch.write(placed, "placed")
    wanted = Bitmap(spark, scratch.write(parts.select(id_keys("node").alias("key")), "wanted"), "key").test()

    def sets(batches):
        for batch in batches:
            batch = batch.filter(pa.array(wanted(np.asarray(batch.column("key")))))
            for part in chunks([batch], 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v.tobytes() for v in shingles(utf8(part.column(1)))], pa.binary())], ["node", "shingles"])

    held = source.select("id", "text", id_keys("id").alias("key")).mapInArrow(sets, "node long, shingles binary")
    groups = placed.join(held, "node").select("component", "i", "j", "side", "node", "shingles").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node")

    def verify(batches):
        for _, rows in grouped(batches, 3):
            values = [np.frombuffer(x, dtype=np.uint64) for x in rows.column("shingles").to_pylist()]
            found = links_forest(np.asarray(rows.column("node")), values, np.asarray(rows.column("side")))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["src", "dst"])

    links = scratch.write(groups.mapInArrow(verify, "src long, dst long"), "links")
    # Rows that repeat an id with other text are one document: its classes are linked.
    own = signed_docs.where("digest is not null and id is not null").join(classes.select("digest", "rep"), "digest").select("id", "rep")
    several = own.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    links = links.unionByName(own.join(several, "id", "left_semi").select(F.col("id").alias("src"), F.col("rep").alias("dst")))
    components = connected_components(scratch, links, "links")
    of_class = classes.join(components, classes.rep == components.node, "left").select("digest", F.coalesce("component", "rep").alias("component"))
    component = F.coalesce("component", "id")
    return signed_docs.select("id", "n_shingles", "digest").join(of_class, "digest", "left").select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets
), items AS (SELECT doc_id, unnest(s) AS x FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * n_both >= 75 * (p.n + q.n - n_both)
), reach AS (
  SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), components AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN components USING (doc_id)
"""

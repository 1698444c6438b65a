"""Helpers shared by the corpus operators: scratch tables, bit maps, word hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word and text separators of every contract: space, tab, LF, VT, FF, CR.
SPACES = "\x20\x09-\x0d"
WORD_RE = "[^\\x20\\x09-\\x0D]+"
#: A-Z to a-z only; other letters stay as they are.
ASCII_LOWER = {65 + i: 97 + i for i in range(26)}
#: Entries a worker keeps in its word-hash cache before it starts anew.
WORD_CACHE = 300_000
#: Upper bound of a broadcast bit map: 2**28 bits are 32 MB.
MAX_BITMAP_BITS = 1 << 28


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: spark.checkpoint.dir, or a temporary
    one where it is unset and the master is local (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="veritext-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Parquet tables of one run of an operator, in a folder of its own.

    A written table cuts the lineage and outlives lost executors, unlike a
    cache or local checkpoint."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Deletes a table that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have yet."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def slices(batches, columns: tuple[int, ...], items: int = 500_000):
    """Slices of record batches whose list columns hold about so many items, to bound what a worker turns into Python objects."""
    for batch in batches:
        sizes = sum(np.asarray(pc.fill_null(pc.list_value_length(batch.column(k)), 0)).astype(np.int64) for k in columns)
        part = np.cumsum(sizes) // items if batch.num_rows else []
        starts = np.flatnonzero(np.diff(part, prepend=-1)) if batch.num_rows else []
        for i, s in enumerate(starts):
            e = starts[i + 1] if i + 1 < len(starts) else batch.num_rows
            yield batch.slice(s, e - s)


def held_out(id_col: str) -> F.Column:
    """The evaluation fold of the contracts: crc32 of the id as text, modulo 5, is 0. A null id is in no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class WordHashes(dict):
    """Word to 64-bit hash, with a bounded cache."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


#: Longest word that hash_words handles in numpy; longer ones are hashed one by one.
_LONG_WORD = 4096
#: Bytes that hash_words works on at a time.
_SLICE = 1 << 20


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    letter = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    letter[[9, 10, 11, 12, 13, 32]] = 0
    low = letter.copy()
    low[65:91] = letter[97:123]
    return letter, low, rng.integers(0, 2**63, _LONG_WORD, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_LETTER, _LOW, _PLACE = _tables()


def hash_words(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of UTF-8 texts end to end, and the number of words of each text.

    Words are separated as in WORD_RE. A word's hash sums, over its bytes, a
    random value of the byte times a random odd value of its place. lower: A-Z
    count as a-z. Bytes are worked on in slices of about _SLICE that end after a
    separator, so memory doesn't grow with the texts."""
    texts = [t or b"" for t in texts]
    flat = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    hashes, places, low = [], [], 0
    while low < len(flat):
        high = min(len(flat), low + _SLICE)
        while high < len(flat) and _LETTER[flat[high - 1]]:
            gaps = np.flatnonzero(_LETTER[flat[high : high + _LONG_WORD]] == 0)
            high = high + int(gaps[0]) + 1 if len(gaps) else min(len(flat), high + _LONG_WORD)
        h, at = _hash_slice(flat[low:high], lower)
        hashes.append(h)
        places.append(at + low)
        low = high
    at = np.concatenate(places)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.concatenate(hashes), np.diff(np.searchsorted(at, np.concatenate([[0], ends])))


def _hash_slice(flat: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the words of a slice that cuts no word."""
    value = (_LOW if lower else _LETTER)[flat]
    inside = value != 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    at = np.flatnonzero(start)
    if not len(at):
        return np.empty(0, dtype=np.uint64), at
    span = np.diff(np.append(at, len(flat)))
    place = np.arange(at[0], len(flat)) - np.repeat(at, span)
    value = value[at[0] :]
    value *= _PLACE[np.minimum(place, _LONG_WORD - 1)]
    hashes = mix(np.add.reduceat(value, at - at[0]))
    for k in np.flatnonzero(span > _LONG_WORD):
        word = flat[at[k] : at[k] + span[k]].tobytes().split()[0]
        if len(word) > _LONG_WORD:
            hashes[k] = xxhash.xxh3_64_intdigest(word.lower() if lower else word)
    return hashes, at


def utf8(column: pa.Array) -> list[bytes | None]:
    """A text column as bytes."""
    return column.cast(pa.binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word (wraps modulo 2**64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def long_lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from numpy arrays without a Python object per element."""
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind.to_pandas_dtype(), copy=False), type=kind))


def chunks(batches, column: int, chars: int = 4_000_000):
    """Slices of record batches that hold about so many characters of a text column, to bound a worker's memory."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        part = np.cumsum(sizes) // chars
        starts = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else []
        for i, s in enumerate(starts):
            e = starts[i + 1] if i + 1 < len(starts) else batch.num_rows
            yield batch.slice(s, e - s)


def grouped(batches, keys: int):
    """Groups of consecutive rows with equal first `keys` columns, as (key, table) over batch borders.

    The rows must be sorted by these columns. One group is in memory at a time,
    so its size must be bounded by whoever forms the groups."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_pylist() for k in range(keys)]
        rows = list(zip(*cols))
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i] != rows[start]:
                if held and rows[start] != key:
                    yield key, pa.Table.from_batches(held)
                    held = []
                key = rows[start]
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield key, pa.Table.from_batches(held)


class Bitmap:
    """A broadcast bit map of hashed keys: no key is missed, few others pass.

    Its size is bounded by MAX_BITMAP_BITS whatever the number of keys; with
    more keys than that more others pass, so use it only to spare work that a
    later exact step would discard anyway."""

    CHUNK = 1 << 16

    def __init__(self, spark: SparkSession, keys: DataFrame, column: str, n: int | None = None, per_key: int = 16):
        """column: a bigint of `keys`, well spread over 64 bits; n: number of keys, counted if not given."""
        n = keys.count() if n is None else n
        bits = self.CHUNK
        while bits < min(max(n, 1) * per_key, MAX_BITMAP_BITS):
            bits <<= 1
        self.bits, chunk = bits, self.CHUNK

        def build(batches):
            found: dict[int, np.ndarray] = {}
            for b in batches:
                pos = np.asarray(b.column(0)).view(np.uint64) & np.uint64(bits - 1)
                which = (pos // np.uint64(chunk)).astype(np.int64)
                for c in np.unique(which):
                    flags = found.setdefault(int(c), np.zeros(chunk, dtype=bool))
                    flags[(pos[which == c] % np.uint64(chunk)).astype(np.int64)] = True
            ids = list(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([np.packbits(found[c], bitorder="little").tobytes() for c in ids], pa.binary())], ["chunk", "flags"])

        tasks = max(1, min(bits // chunk, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        by_chunk = F.shiftright(F.col("k").bitwiseAND(F.lit(bits - 1)), 16)
        rows = keys.select(F.col(column).alias("k")).repartition(tasks, by_chunk).mapInArrow(build, "chunk long, flags binary").collect() if n else []
        flags = np.zeros(bits // 8, dtype=np.uint8)
        for r in rows:
            at = r["chunk"] * chunk // 8
            flags[at : at + chunk // 8] |= np.frombuffer(r["flags"], dtype=np.uint8)
        self.shared = spark.sparkContext.broadcast(flags)

    def test(self):
        """A picklable function from uint64 keys to a Boolean array."""
        shared, bits = self.shared, self.bits

        def has(keys: np.ndarray) -> np.ndarray:
            pos = keys.view(np.uint64) & np.uint64(bits - 1)
            return (shared.value[(pos >> np.uint64(3)).astype(np.int64)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1 > 0

        return has


def id_keys(column: str) -> F.Column:
    """Spread 64-bit keys of an id column for a Bitmap. All nulls have one key."""
    return F.coalesce(F.xxhash64(F.col(column).cast("long")), F.lit(0).cast("long"))


def connected_components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, component): component is the smallest node reachable over `edges` (src, dst, bigints).

    Minimum label of the neighbours, then the label's label, until nothing
    changes. Minima combine before each shuffle, so a hub of any degree never
    gathers its neighbours in one task; every round is a written table."""
    both = scratch.write(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct(), f"{name}-edges")
    labels = scratch.write(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("component")), f"{name}-0")
    step = 0
    while True:
        step += 1
        seen = both.join(labels, both.dst == labels.node).select(F.col("src").alias("node"), "component")
        least = labels.select("node", "component", F.col("component").alias("old")).unionByName(seen.withColumn("old", F.lit(None).cast("long"))).groupBy("node").agg(F.min("component").alias("component"), F.min("old").alias("old"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jumped = least.join(up, "component", "left").select("node", F.least("component", "above").alias("component"), "old")
        new = scratch.write(jumped, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        labels = new.select("node", "component")
        if not new.where("component <> old").limit(1).count():
            return labels

"""Benchmark decontamination by template canonicalisation.

Words lose surrounding punctuation and case. Numbers, units and names (a
capitalised word inside a sentence; a run of such words is one name) become
typed placeholders, so a question keeps its template when it is asked again with
other values. Windows of WINDOW template tokens of all items are joined by hash
with the windows of all documents. Where a document meets an item, windows whose
places in both run on alike form one occurrence, also across places at which a
value has more words than its counterpart. In an occurrence one value of the
item must always become the same value of the document, the most frequent one;
windows that break this are dropped, the others count.

Template windows with under MIN_LITERALS literal tokens say too little and are
not used; the words themselves are, so that items of few words or mostly values
are still found word for word: windows of WINDOW bare words (of all words, for a
shorter item) are joined the same way and need no slots.

A document is contaminated by an item if the windows that count cover COVERAGE
of the item's words, or VERBATIM consecutive words of it stand in the document.

Documents first test their window hashes on a bit map of bounded size, so only
hits leave the scan; the join that follows is an ordinary equi-join for any
number of items.

Defined results: null or empty texts match nothing; an item of under WINDOW
words is found where all its words stand in a row, however few they are; items
of equal text are one item, listed under the smallest id; repeated rows get
equal rows; empty tables give no hits; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.llm.common import WORD_CACHE, Bitmap, Scratch, chunks, mix, signed, table

WINDOW, MIN_LITERALS, COVERAGE, VERBATIM = 8, 4, 0.6, 24
#: Places at which windows of one occurrence may drift apart.
DRIFT = 3
_EDGES = "\"'`.,;:!?()[]{}<>*&$#%|~_=+-/\\“”‘’«»"
#: Unit words and symbols.
UNITS = frozenset("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons l ml liter liters litre litres gallon gallons s sec ms min h hr second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur percent degree degrees mph kph kmh hz khz mhz ghz kb mb gb tb w kw v volt volts watt watts".split())
_NUM, _UNIT, _CAPITAL, _STOP = 1, 2, 4, 8
_DIGIT = re.compile(r"\d")


class Tokens(dict):
    """Word to a 64-bit value: hash of its bare lower-case form with flags in the low four bits; 0 if nothing is left."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        bare = word.strip(_EDGES)
        value = 0
        if bare:
            low = bare.lower()
            value = xxhash.xxh3_64_intdigest(low) & ~15
            if not bare.isalpha() and _DIGIT.search(bare):
                value |= _NUM
            elif low in UNITS:
                value |= _UNIT
            elif low != bare and bare[0] != low[0] and bare[1:] == low[1:]:
                value |= _CAPITAL
        if word[-1] in ".!?:":
            value |= _STOP
        self[word] = value
        return value


_NUMBER, _MEASURE, _NAME = 1, 2, 3
_STEP, _RAW = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x51ED270B7A65C3D1)


class Flat:
    """Texts end to end. Words that have a bare form: `raw` (hash of it), `text` (its text) and `place` (among `words`);
    template tokens: `names`, `slots` (is a placeholder), `owner` (its text), first word `low` and end `high` among the bare words."""

    def __init__(self, texts: list[str | None], tokens: Tokens):
        words: list[str] = []
        starts, counts = [], []
        for t in texts:
            before = len(words)
            for line in (t or "").split("\n"):
                starts.append(len(words))
                words += line.split()
            counts.append(len(words) - before)
        self.words = words
        flags = np.fromiter(map(tokens.__getitem__, words), dtype=np.uint64, count=len(words))
        start = np.zeros(len(words) + 1, dtype=bool)
        start[starts] = True
        start[1:-1] |= (flags[:-1] & np.uint64(_STOP)) > 0
        bare = (flags >> np.uint64(4)) > 0
        self.place = np.flatnonzero(bare)
        flags, start = flags[bare], start[:-1][bare]
        self.text = np.repeat(np.arange(len(texts)), counts)[bare]
        self.raw = flags & ~np.uint64(15)
        kind = np.where(flags & np.uint64(_NUM), _NUMBER, np.where(flags & np.uint64(_UNIT), _MEASURE, np.where(((flags & np.uint64(_CAPITAL)) > 0) & ~start, _NAME, 0)))
        first = np.ones(len(kind), dtype=bool)
        first[1:] = (kind[1:] != _NAME) | (kind[:-1] != _NAME) | (self.text[1:] != self.text[:-1])
        self.low = np.flatnonzero(first)
        self.high = np.append(self.low[1:], len(kind))
        kind = kind[self.low]
        self.owner, self.slots = self.text[self.low], kind > 0
        self.names = np.where(self.slots, kind.astype(np.uint64), self.raw[self.low])

    def value(self, k: int) -> str:
        """The words behind a placeholder."""
        return " ".join(self.words[p].strip(_EDGES).lower() for p in self.place[self.low[k] : self.high[k]])


def _rolled(names: np.ndarray, owner: np.ndarray, size: int, salt: np.uint64) -> np.ndarray:
    """Hash of each window of some size; 0 where it would cross texts."""
    n = len(names) - size + 1
    if n <= 0 or not size:
        return np.empty(0, dtype=np.uint64)
    total = np.full(n, np.uint64(size) ^ salt, dtype=np.uint64)
    spread = mix(names)
    for k in range(size):
        total *= _STEP
        total += spread[k : k + n]
    return np.where(owner[size - 1 :] == owner[:n], mix(total) | np.uint64(1), np.uint64(0))


def template_windows(flat: Flat, size: int = WINDOW) -> np.ndarray:
    """Hash of each template window; 0 where it would cross texts or too few tokens are literal."""
    h = _rolled(flat.names, flat.owner, size, np.uint64(0))
    literal = np.concatenate([[0], np.cumsum(~flat.slots)])
    return np.where(literal[size:][: len(h)] - literal[: len(h)] >= MIN_LITERALS, h, np.uint64(0))


def word_windows(flat: Flat, size: int = WINDOW) -> np.ndarray:
    return _rolled(flat.raw, flat.text, size, _RAW)


def _values(flat: Flat, at: int, size: int) -> list[str]:
    return [flat.value(k) for k in np.flatnonzero(flat.slots[at : at + size]) + at]


def _item_windows(batches):
    """Windows of items: whole length in words, kind (0 words, 1 template), size, hash, span of words, and values of the slots."""
    tokens = Tokens()
    for batch in batches:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            flat = Flat([text], tokens)
            n, size = len(flat.raw), min(WINDOW, len(flat.raw))
            rows += [(item, n, 0, size, int(x), p, p + size, []) for p, x in enumerate(signed(word_windows(flat, size)).tolist())]
            rows += [(item, n, 1, WINDOW, int(x), int(flat.low[p]), int(flat.high[p + WINDOW - 1]), _values(flat, p, WINDOW)) for p, x in enumerate(signed(template_windows(flat)).tolist()) if x]
        cols = list(zip(*rows)) or [[]] * 8
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["item", "words", "kind", "size", "hash", "low", "high", "ours"])


def occurrences(hits: list[dict]) -> list[list[dict]]:
    """Template hits (low, high in the item; pos in the document) in groups whose places run on alike."""
    out: list[list[dict]] = []
    live: list[list[dict]] = []
    for h in sorted(hits, key=lambda h: (h["pos"], h["low"])):
        live = [g for g in live if h["pos"] - g[-1]["pos"] <= 4 * WINDOW]
        best = None
        for g in live:
            ahead, along = h["low"] - g[-1]["low"], h["pos"] - g[-1]["pos"]
            if ahead >= 0 and along >= 0 and (ahead > 0) == (along > 0) and abs(ahead - along) <= DRIFT and (best is None or abs(ahead - along) < best[0]):
                best = (abs(ahead - along), g)
        if best:
            best[1].append(h)
        else:
            live.append([h])
            out.append(live[-1])
    return out


def covered(hits: list[dict], words: int) -> tuple[float, int]:
    """Share of an item's words that the windows which count cover, and its longest run of words that stands in the document."""
    own: set[int] = set()
    runs: dict[int, list[tuple[int, int]]] = {}
    for h in hits:
        if not h["kind"]:
            own.update(range(h["low"], h["high"]))
            runs.setdefault(h["pos"] - h["low"], []).append((h["low"], h["high"]))
    longest = 0
    for spans in runs.values():  # windows on one diagonal
        start = end = -1
        for low, high in sorted(spans):
            start, end = (low, high) if low > end else (start, max(end, high))
            longest = max(longest, end - start)
    for group in occurrences([h for h in hits if h["kind"]]):
        votes: dict[str, Counter] = {}
        for h in group:
            for a, b in zip(h["ours"], h["theirs"]):
                votes.setdefault(a, Counter())[b] += 1
        became = {a: min(c.items(), key=lambda x: (-x[1], x[0]))[0] for a, c in votes.items()}
        for h in group:
            if all(became[a] == b for a, b in zip(h["ours"], h["theirs"])):
                own.update(range(h["low"], h["high"]))
    return (round(len(own) / words, 6) if words else 0.0), longest


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: id, tag (a hash of the text), n_tokens, contaminated, coverage, item_ids (sorted)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).groupBy("text").agg(F.min("item").alias("item"))
    items = scratch.write(items.select("item", "text").mapInArrow(_item_windows, "item long, words int, kind int, size int, hash long, low int, high int, ours array<string>"), "items")
    sizes = sorted({r["size"] for r in items.where("kind = 0").select("size").distinct().collect()})  # at most WINDOW values
    known = Bitmap(spark, items.select("hash").distinct(), "hash", per_key=64).test()

    def scan(batches):
        tokens = Tokens()
        for batch in chunks(batches, 2, 1_000_000):
            n = batch.num_rows
            flat = Flat(batch.column(2).to_pylist(), tokens)
            first_word = np.searchsorted(flat.text, np.arange(n))
            met = []  # text, hash, place among its words, values
            for size in sizes:
                own = word_windows(flat, size)
                for at in np.flatnonzero(known(own) & (own > 0)).tolist() if len(own) else ():
                    met.append((int(flat.text[at]), int(own[at].view(np.int64)), at - int(first_word[flat.text[at]]), []))
            own = template_windows(flat)
            for at in np.flatnonzero(known(own) & (own > 0)).tolist() if len(own) else ():
                met.append((int(flat.owner[at]), int(own[at].view(np.int64)), int(flat.low[at]) - int(first_word[flat.owner[at]]), _values(flat, at, WINDOW)))
            met.sort(key=lambda x: x[0])
            offsets = np.searchsorted(np.array([m[0] for m in met], dtype=np.int64), np.arange(n + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array([m[k] for m in met], kind)) for k, kind in ((1, pa.int64()), (2, pa.int32()), (3, pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.bincount(flat.text, minlength=n), pa.int64()), *lists], ["id", "tag", "n_tokens", "hashes", "places", "slots"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tag"), F.col(text_col).alias("text"))
    scanned = scratch.write(source.mapInArrow(scan, "id long, tag long, n_tokens long, hashes array<long>, places array<int>, slots array<array<string>>"), "scanned")
    hits = scanned.where("size(hashes) > 0").dropDuplicates(["id", "tag"]).select("id", "tag", F.explode(F.arrays_zip("hashes", "places", "slots")).alias("h"))
    met = hits.select("id", "tag", F.col("h.hashes").alias("hash"), F.col("h.places").alias("pos"), F.col("h.slots").alias("theirs")).join(items, "hash")
    met = met.groupBy("id", "tag", "item", "words").agg(F.collect_list(F.struct("kind", "low", "high", "pos", "ours", "theirs")).alias("hits"))

    def judge(batches):
        for batch in batches:
            got = [covered(h, n) for h, n in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([c for c, _ in got], pa.float64()), pa.array([n for _, n in got], pa.int32())], ["id", "tag", "item", "coverage", "verbatim"])

    pairs = met.mapInArrow(judge, "id long, tag long, item long, coverage double, verbatim int").where((F.col("coverage") >= COVERAGE) | (F.col("verbatim") >= VERBATIM))
    found = pairs.groupBy("id", "tag").agg(F.max("coverage").alias("coverage"), F.array_sort(F.collect_set("item")).alias("item_ids"))
    found = scratch.write(found, "found").select(F.col("id").alias("_id"), F.col("tag").alias("_tag"), "coverage", "item_ids")
    out = scanned.select("id", "tag", "n_tokens").join(found, F.col("tag").eqNullSafe(F.col("_tag")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    return out.select(F.col("id").alias(id_col), "tag", "n_tokens", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, contaminated, kept, coverage and the items found (joined by commas), per document."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_tokens", "contaminated", (~F.col("contaminated")).alias("kept"), "coverage", F.array_join(F.col("item_ids").cast("array<string>"), ",").alias("items"))

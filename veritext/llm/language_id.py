"""Language identification by rank-order profiles of character n-grams.

A language's profile ranks its most frequent n-grams (1 to 3 letters of words
padded with spaces) over the training fold. A document's own most frequent
n-grams are ranked alike, over its whole text, and the language whose profile
has the least out-of-place distance wins. Letters of every script count as
themselves, in lower case; three code points fit in one 64-bit n-gram code, so a
document costs one sort of its codes.

The profiles are fitted on about PROFILE_DOCS documents a language, chosen by a
hash of the id; that bound does not touch what is predicted.

Defined results: null text, or text without a letter, gets `und` and score 0;
equal distances go to the language that sorts first; documents without a lang
or without an id take no part in training; if nothing can be learned every
document is `und`; an empty table gives an empty result; repeated rows get
equal rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritext.llm.common import chunks, held_out, table

PROFILE_DOCS = 4000
#: N-grams of a profile, and of a document's ranking.
PROFILE_SIZE, DOCUMENT_SIZE = 1000, 400
#: Rank distance of an n-gram that a profile lacks.
OUT_OF_PLACE = PROFILE_SIZE
UNDETERMINED = "und"
#: Bits of a letter's code point, and the code of the gap between words.
_BITS, _GAP = 21, 1

_CODE_TABLE: list[np.ndarray] = []


def _letter(point: int) -> int:
    """The lower-case code point of a letter; 0 for other characters."""
    ch = chr(point)
    return ord(ch.lower()[0]) if ch.isalpha() else 0


def letters(points: np.ndarray) -> np.ndarray:
    """Lower-case code points of letters, 0 for other characters; those of the first plane come from a table."""
    if not _CODE_TABLE:
        _CODE_TABLE.append(np.array([_letter(c) for c in range(65536)], dtype=np.int64))
    out = _CODE_TABLE[0][np.minimum(points, 65535)]
    high = points > 65535
    if high.any():
        kinds, which = np.unique(points[high], return_inverse=True)
        out[high] = np.array([_letter(int(c)) for c in kinds], dtype=np.int64)[which]
    return out


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of a text and how often each occurs."""
    c = letters(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
    c = np.concatenate([[0], c, [0]])
    c = c[(c > 0) | np.concatenate([[True], c[:-1] > 0])]  # one gap between words
    is_letter = c > 0
    c = np.where(is_letter, c, _GAP)
    two = (c[:-1] << _BITS) | c[1:]
    three = (two[:-1] << _BITS) | c[2:]
    return np.unique(np.concatenate([c[is_letter], two[is_letter[:-1] | is_letter[1:]], three[is_letter[1:-1]]]), return_counts=True)


def ranking(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes first; ties by code."""
    return codes[np.lexsort((codes, -counts))][:most]


def fit_profiles(docs: DataFrame, id_col: str, text_col: str, lang_col: str, fold: F.Column) -> dict[str, np.ndarray]:
    """Language to its ranked n-gram codes: PROFILE_SIZE numbers a language, from a bounded sample."""
    labelled = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(~fold & F.col("lang").isNotNull() & F.col("id").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, PROFILE_DOCS / n))])
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def count(batches):
        total: dict[tuple[str, int], int] = {}
        for batch in chunks(batches, 1):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes, counts = ngram_counts(text)
                for c, n in zip(codes.tolist(), counts.tolist()):
                    total[lang, c] = total.get((lang, c), 0) + n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int64()), pa.array(list(total.values()), pa.int64())], ["lang", "code", "n"])

    sample = labelled.where(F.col("text").isNotNull() & (chance < share[F.col("lang")]))
    counts = sample.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    rows = counts.withColumn("place", order).where(F.col("place") <= PROFILE_SIZE).select("lang", "code", "place").collect()
    profiles: dict[str, list] = {lang: [] for lang in sorted(sizes)}
    for r in sorted(rows, key=lambda r: (r["lang"], r["place"])):
        profiles[r["lang"]].append(r["code"])
    return {lang: np.array(codes, dtype=np.int64) for lang, codes in profiles.items() if codes}


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None, train: DataFrame | None = None) -> DataFrame:
    """id, held_out, lang_pred, score and n_ranked (n-grams that were ranked) per document; keep: further columns to return.

    score is the margin of the winning distance over the runner-up's, times the
    share of the document's n-grams the winner's profile knows; 0 to 1."""
    fold = held_out(id_col)
    profiles = fit_profiles(docs if train is None else train, id_col, text_col, lang_col, held_out("id"))
    langs = sorted(profiles)
    codes = np.unique(np.concatenate([profiles[x] for x in langs])) if langs else np.empty(0, dtype=np.int64)
    place = np.full((len(langs), len(codes) + 1), OUT_OF_PLACE, dtype=np.int64)  # the last column: codes that no profile has
    for i, lang in enumerate(langs):
        place[i, np.searchsorted(codes, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(batches):
        for batch in chunks(batches, batches_text):
            names, scores, ranked = [], [], []
            for text in batch.column(batches_text).to_pylist():
                found, counts = ngram_counts(text or "")
                if not len(found) or not langs:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    ranked.append(min(len(found), DOCUMENT_SIZE))
                    continue
                own = ranking(found, counts, DOCUMENT_SIZE)
                at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
                at = np.where(codes[at] == own, at, len(codes))
                theirs = place[:, at]
                away = np.where(theirs == OUT_OF_PLACE, OUT_OF_PLACE, np.abs(theirs - np.arange(len(own)))).sum(1)
                order = np.argsort(away, kind="stable")
                best = int(order[0])
                known = float((theirs[best] < OUT_OF_PLACE).mean())
                rival = away[order[1]] if len(order) > 1 else OUT_OF_PLACE * len(own)
                margin = 1.0 - away[best] / rival if rival else 0.0
                names.append(langs[best])
                ranked.append(len(own))
                scores.append(round(min(1.0, max(0.0, (0.5 + 0.5 * margin) * known)), 6))
            columns = [c for i, c in enumerate(batch.columns) if i != batches_text or text_col in (keep or [])]
            labels = [c for i, c in enumerate(batch.schema.names) if i != batches_text or text_col in (keep or [])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(ranked, pa.int32())], [*labels, "lang_pred", "score", "n_ranked"])

    keep = list(dict.fromkeys([id_col, *(keep or [])]))
    inner = docs.select(*[F.col(f"`{c}`") for c in keep if c != text_col], fold.alias("held_out"), F.col(text_col))
    batches_text = len(inner.columns) - 1
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema if f.name != text_col or text_col in keep)
    return inner.mapInArrow(predict, f"{shape}, lang_pred string, score double, n_ranked int")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))

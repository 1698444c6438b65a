"""Passages that oppose a proposition, planted errors, and verification of whole briefs."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritext.functions.citations import extract
from veritext.functions.kernels import flat_map
from veritext.functions.lexicon import KEPT_WORDS, QUALIFIERS, QUOTE_WORDS, cue
from veritext.functions.reading import asks, contrary_queries, distinctive, hierarchy, of_the_record, opposes
from veritext.functions.text import find_quote, folded, in_quotation, plain, quote_keys, sentence_at, sentences, shared_run, source_keys, truncation, word_count
from veritext.operators import resolve, retrieval, verdict

FIELD, TOP, LONGEST_SENTENCE = 150, 5, 120
_QUALIFIER = re.compile(cue(QUALIFIERS, word=True))


def find_contrary(paragraphs: DataFrame, proposition: str, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", exclude: DataFrame | None = None) -> DataFrame:
    """id, sentence, kind, cue, score, place: the first opposing sentence of each retrieved paragraph, best first, each sentence once.

    Passed over are questions, sentences about a record rather than the law, quoted ones and tables that read as one
    sentence. exclude: ids (column id) whose paragraphs are not asked."""
    spark = paragraphs.sparkSession
    queries = spark.createDataFrame([(k, q) for k, q in enumerate(contrary_queries(proposition))], "query_id int, query string")
    field = retrieval.bm25(paragraphs, queries, FIELD, id_col, text_col).groupBy("id").agg(F.max("score").alias("score"))
    if exclude is not None:
        field = field.join(exclude.select("id").distinct(), "id", "left_anti")
    terms = spark.createDataFrame([(t,) for t in sorted(distinctive(proposition))], "term string")
    weights = {r["term"]: r["weight"] for r in retrieval.idf_weights(paragraphs, terms, id_col, text_col).collect()}  # one row a term of the proposition
    rows = paragraphs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(field, "id")

    def leads(r):
        for line, at in sentences(r["text"] or ""):
            if len(line.split()) > LONGEST_SENTENCE or asks(line) or of_the_record(line) or in_quotation(r["text"], at):
                continue
            found = opposes(proposition, line, weights)
            if found:
                yield {"id": r["id"], "sentence": line, "kind": found["kind"], "cue": found["cue"], "score": r["score"]}
                return

    kind = rows.schema["id"].dataType.simpleString()
    found = flat_map(rows, leads, f"id {kind}, sentence string, kind string, cue string, score double")
    once = found.withColumn("_n", F.row_number().over(Window.partitionBy("sentence").orderBy(F.desc("score"), "id"))).where("_n = 1").drop("_n")
    best = once.orderBy(F.desc("score"), "id").limit(top)
    return best.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id")))  # over `top` rows


# Denials and what undoes them, then assertions and what denies them; the first that fits is applied once.
DENIED = (
    ("cannot", "can"), ("is not", "is"), ("are not", "are"), ("was not", "was"), ("were not", "were"), ("does not", "does"), ("do not", "do"), ("did not", "did"), ("shall not", "shall"), ("will not", "will"),
    ("may not", "may"), ("must not", "must"), ("need not", "must"), ("has not", "has"), ("have not", "have"), ("had not", "had"), ("no longer", "still"), ("has no", "has"), ("have no", "have"), ("had no", "had"),
)
ASSERTED = (
    ("cannot", "can"), ("can", "cannot"), ("is", "is not"), ("are", "are not"), ("was", "was not"), ("were", "were not"), ("shall", "shall not"), ("must", "need not"), ("may", "may not"), ("would", "would not"),
    ("has to", "does not have to"), ("have to", "do not have to"), ("does", "does not"), ("do", "do not"),
)


def negate(sentence: str) -> str | None:
    """The sentence saying the opposite by its first rewritable verb; None if no rule fits."""
    for old, new in DENIED + ASSERTED:
        out, n = re.subn(rf"(?i)\b{old}\b", new, sentence, count=1)
        if n:
            return out
    return None


def plant(items: DataFrame) -> DataFrame:
    """id, mode, claim, citation over clean items (id, sentence, citation, other_citation): clean, phantom, mis-cite, selective quotation and wrong pinpoint."""
    def rows(r):
        said, cite = r["sentence"].rstrip(" ."), r["citation"]
        yield {"id": r["id"], "mode": None, "claim": f"{said}: {cite}.", "citation": cite}
        yield {"id": r["id"], "mode": 1, "claim": f"{said}: {_shift(cite, 7)}.", "citation": _shift(cite, 7)}
        yield {"id": r["id"], "mode": 2, "claim": f"{said}: {r['other_citation']}.", "citation": r["other_citation"]}
        cut = next((m.start() for m in _QUALIFIER.finditer(said) if len(said[: m.start()].split()) >= KEPT_WORDS), None)
        if cut is not None:
            kept = said[:cut].rstrip(" ,")
            yield {"id": r["id"], "mode": 9, "claim": f"{kept}: {cite}.", "citation": cite}
        yield {"id": r["id"], "mode": 12, "claim": f"{said}: {cite}, para 999.", "citation": cite}

    return flat_map(items, rows, "id int, mode int, claim string, citation string")


def plant_readings(seeds: DataFrame) -> DataFrame:
    """id, mode, claim, citation: errors of reading, each where its seed has the words for it.

    A claim of too large a bench (3), another case's proposition (4), counsel's words (5), a dissent's (6), words the
    court did not decide on (7), and an overruled case (10). seeds: id, sentence, citation, label, bench, and the pairs
    counsel, dissent and obiter (_label, _sentence), foreign_sentence, and dead_ (citation, label, sentence)."""
    def at(label: str, citation: str = "citation") -> Column:
        return F.concat(F.col(citation), F.lit(", para "), F.col(label))

    lowered = F.concat(F.lower(F.substring("sentence", 1, 1)), F.expr("substring(sentence, 2)"))
    larger = F.when(F.coalesce("bench", F.lit(0)) < 5, F.concat(F.lit("A Constitution Bench of this Court held that "), lowered))
    made = [
        (3, larger, at("label")), (4, F.col("foreign_sentence"), at("label")), (5, F.col("counsel_sentence"), at("counsel_label")), (6, F.col("dissent_sentence"), at("dissent_label")),
        (7, F.col("obiter_sentence"), at("obiter_label")), (10, F.col("dead_sentence"), at("dead_label", "dead_citation")),
    ]
    items = F.array(*[F.struct(F.lit(m).alias("mode"), claim.alias("claim"), citation.alias("citation")) for m, claim, citation in made])
    return seeds.select("id", F.inline(F.filter(items, lambda x: x["claim"].isNotNull() & x["citation"].isNotNull())))


#: Words of a fragment query, words that a sentence has beyond them, and how many of them must be plain words.
FRAGMENT_WORDS, FRAGMENT_REST, READABLE_WORDS = 12, 4, 8


def fragment(sentence: str) -> str | None:
    """A readable run of words as near the middle of a sentence as there is one, the earlier of two; None for short sentences."""
    words = sentence.split()
    if len(words) < FRAGMENT_WORDS + FRAGMENT_REST:
        return None
    plain_word = [len(b) >= 3 and b.isalpha() for b in (w.strip(".,;:()[]") for w in words)]
    last = len(words) - FRAGMENT_WORDS
    for start in sorted(range(last + 1), key=lambda k: (abs(k - last // 2), k)):
        if sum(plain_word[start : start + FRAGMENT_WORDS]) >= READABLE_WORDS:
            return " ".join(words[start : start + FRAGMENT_WORDS])
    return None


def seeded_sample(items: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows in the order of a hash of seed and key: the same ones in every run, whatever the partitions."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return items.orderBy(order, key).limit(n)


def _shift(cite: str, by: int) -> str:
    """The citation with its last number moved on."""
    return re.sub(r"(\d+)(\D*)$", lambda m: f"{int(m[1]) + by}{m[2]}", cite)


def word_runs(text: Column, *sizes: int) -> Column:
    """Hashes of all runs of so many words of a folded text, each once, sliced within the row."""
    def runs(words: Column, size: int) -> Column:
        last = F.size(words) - size + 1
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), last)), lambda i: F.xxhash64(F.lit(size), F.slice(words, i, size)))
        return F.when(last >= 1, F.array_distinct(each)).otherwise(F.array().cast("array<long>"))

    # The words are the variable of a lambda, so a row is folded and split once; an expression would be evaluated again at every place.
    return F.element_at(F.transform(F.array(F.split(text, " ")), lambda words: F.flatten(F.array(*[runs(words, n) for n in sizes]))), 1)


#: Words inside a quotation by which it meets texts.
INNER_WORDS = 6


def contained(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, item_id: texts that hold a quotation as a string, both folded. quotes: item_id, quote; texts: doc_id, text.

    The words inside a quotation, without its first and last, are whole words wherever it stands; a run of them
    joins quotations and texts by hash, and the strings are compared. Quotations of one or two words have none
    inside, so these, part of a stated set, are looked up in every text."""
    asked = quotes.where("quote is not null").select("item_id", folded(F.col("quote")).alias("quote")).withColumn("inner", F.least(F.size(F.split("quote", " ")) - 2, F.lit(INNER_WORDS)))
    said = texts.where("text is not null").select("doc_id", folded(F.col("text")).alias("said"))
    sizes = sorted(r[0] for r in asked.select("inner").distinct().collect())  # INNER_WORDS + 1 numbers at most
    found = said.join(asked.where("inner < 1"), F.contains("said", "quote")).select("doc_id", "item_id") if sizes and sizes[0] < 1 else None
    long = [n for n in sizes if n > 0]
    if long:
        words = F.split("quote", " ")
        keyed = asked.where("inner > 0").select("item_id", F.xxhash64("inner", F.slice(words, F.lit(2), F.col("inner"))).alias("g"))
        held = said.select("doc_id", F.explode(word_runs(F.col("said"), *long)).alias("g"))
        pairs = held.join(keyed, "g").select("doc_id", "item_id").distinct()
        met = pairs.join(said, "doc_id").join(asked.select("item_id", "quote"), "item_id").where(F.contains("said", "quote")).select("doc_id", "item_id")
        found = met if found is None else found.unionByName(met)
    return (said.crossJoin(asked.limit(0)).select("doc_id", "item_id") if found is None else found).distinct()


def shared_runs(claims: DataFrame, passages: DataFrame, least: int = 6) -> DataFrame:
    """claim_id, id, words: the longest run of each claim's words in each passage that shares least words in a row with it.

    Claims meet passages by hashed word runs of that length, cut within the row, so only sharing pairs are compared."""
    def grams(df, key, text):
        return df.select(key, F.explode(word_runs(folded(F.col(text)), least)).alias("g"))

    left, right = grams(claims, "claim_id", "claim"), grams(passages, "id", "text")
    pairs = right.join(left, "g").select("claim_id", "id").distinct()
    rows = pairs.join(claims.select("claim_id", "claim"), "claim_id").join(passages.select("id", "text"), "id")

    def run(r):
        n, said = shared_run(r["claim"], r["text"] or "")
        yield {"claim_id": r["claim_id"], "id": r["id"], "words": n, "run": said}

    return flat_map(rows, run, "claim_id long, id long, words int, run string").where(F.col("words") >= least)


def quote_matches(quotes: DataFrame, passages: DataFrame) -> DataFrame:
    """item_id, doc_id, kind, start, end of each quotation that find_quote finds in a passage. quotes: item_id, quote; passages: doc_id, text, ocr (scanned).

    They meet by hashed word runs of the plain text, in scanned passages by hashed pieces too. Quotations without a
    key are compared with all passages."""
    def keyed(r):
        if word_count(r["quote"]) >= QUOTE_WORDS:
            for ocr in (False, True):
                for size, key in quote_keys(r["quote"], ocr) or [(0, 0)]:
                    yield {"item_id": r["item_id"], "ocr": ocr, "size": size, "key": key}

    quotes, passages = quotes.where("quote is not null"), passages.where("text is not null").withColumn("ocr", F.coalesce("ocr", F.lit(False)))
    keys = flat_map(quotes.select("item_id", "quote"), keyed, "item_id long, ocr boolean, size int, key long")
    sizes = [r[0] for r in keys.select("size").distinct().collect()]  # no more than the sizes of runs and pieces

    def held(r):
        for size, key in source_keys(r["text"], [n for n in sizes if n > 0 or r["ocr"]]):
            yield {"doc_id": r["doc_id"], "size": size, "key": key}

    found = flat_map(passages.select("doc_id", "text", "ocr"), held, "doc_id long, size int, key long").join(keys.where("size <> 0").drop("ocr"), ["size", "key"]).select("item_id", "doc_id")
    if 0 in sizes:
        bare = keys.where("size = 0").select("item_id", F.col("ocr").alias("scans"))
        found = found.unionByName(passages.crossJoin(bare).where("ocr or not scans").select("item_id", "doc_id"))

    def match(r):
        q = find_quote(r["quote"], r["text"], r["ocr"])
        if q.start is not None:
            yield {"item_id": r["item_id"], "doc_id": r["doc_id"], "kind": q.kind, "start": q.start, "end": q.end}

    met = found.distinct().join(quotes.select("item_id", "quote"), "item_id").join(passages.select("doc_id", "text", "ocr"), "doc_id")
    return flat_map(met, match, "item_id long, doc_id long, kind string, start int, end int")


def truncations(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """claim_id, label, kept, dropped, qualifier: claims that quote a passage of their version up to its condition. claims: claim_id, version, claim; passages: version, seq, label, body."""
    def rows(r):
        found = truncation(r["claim"], [(r["label"], r["body"])])
        if found:
            yield {"claim_id": r["claim_id"], "seq": r["seq"], **found}

    # A claim meets the paragraphs that share a run of KEPT_WORDS with it, paragraph by paragraph; the first in order counts.
    # The first and last word of a shared run may be parts of words, the ones between are whole.
    def keyed(df, key, text):
        def runs(r):
            w = plain(r[text] or "").split()
            for run in {" ".join(w[k : k + KEPT_WORDS - 2]) for k in range(len(w) - KEPT_WORDS + 3)}:
                yield {"version": r["version"], key: r[key], "g": int.from_bytes(hashlib.blake2b(run.encode(), digest_size=8).digest(), "big", signed=True)}

        return flat_map(df.select("version", key, text), runs, f"version string, {key} int, g long")

    asked = keyed(claims, "claim_id", "claim")
    held = keyed(passages.join(claims.select("version").distinct(), "version", "left_semi"), "seq", "body")
    met = held.join(asked, ["version", "g"]).select("claim_id", "version", "seq").distinct()
    pairs = met.join(claims, ["claim_id", "version"]).join(passages.select("version", "seq", "label", "body"), ["version", "seq"])
    found = flat_map(pairs.select("claim_id", "claim", "seq", "label", "body"), rows, "claim_id int, seq int, label string, kept string, dropped string, qualifier string")
    first = found.groupBy("claim_id").agg(F.min_by(F.struct("label", "kept", "dropped", "qualifier"), "seq").alias("t"))
    return first.select("claim_id", "t.*")


def verify_brief(brief: DataFrame, aliases: DataFrame, cases: DataFrame, standings: DataFrame) -> DataFrame:
    """citation_id, raw, grade, modes, needs_review, support of each citation of briefs (brief_id, text).

    Citations are extracted with their sentence, resolved by alias, and checked for party names, court, bench and standing. aliases: normalized, case; cases: case, title, court, bench; standings: case, status."""
    def rows(r):
        for k, c in enumerate(extract(r["text"])):
            a, b = sentence_at(r["text"], c["start"])
            yield {"brief_id": r["brief_id"], "citation_id": k + 1, "raw": c["raw"], "normalized": c["normalized"], "parties": c["parties"], "proposition": " ".join(r["text"][a:b].split())}

    found = flat_map(brief, rows, "brief_id int, citation_id int, raw string, normalized string, parties string, proposition string")
    met = resolve.exact(found, aliases).join(cases, "case", "left").join(standings.select("case", F.col("status").alias("treatment")), "case", "left")
    met = resolve.name_mismatch(met)

    @F.pandas_udf("string")
    def check(said, court, bench):
        import pandas as pd

        return pd.Series([hierarchy(p or "", c, None if b is None or b != b else b) for p, c, b in zip(said, court, bench)], dtype=object)

    columns = {n: t for n, t in (x.split(" ") for x in verdict.INPUT.split(", "))}
    have = {"citation_id": F.col("citation_id"), "status": F.col("status"), "name_mismatch": F.col("mismatch"), "hierarchy": check("proposition", "court", "bench"), "treatment": F.col("treatment")}
    shaped = met.select("raw", "brief_id", *[have.get(n, F.lit(None)).cast(t).alias(n) for n, t in columns.items()])
    return shaped.select("raw", "citation_id").join(verdict.rubric(shaped), "citation_id")


def dissents(paragraphs: DataFrame, opinions: DataFrame, proposition: str) -> DataFrame:
    """version, seq, sentence, overlap: of each dissent the sentence nearest to a proposition, the first of equals.

    paragraphs: version, seq, body; opinions: version, kind, seq_start, seq_end."""
    wanted = distinctive(proposition)
    own = opinions.where("kind = 'dissenting'").alias("o")
    inside = (F.col("p.version") == F.col("o.version")) & F.col("p.seq").between(F.col("o.seq_start"), F.col("o.seq_end"))
    rows = paragraphs.alias("p").join(own, inside).select("p.version", F.col("o.seq_start").alias("opinion"), "p.seq", "p.body")

    def score(r):
        for k, (line, _) in enumerate(sentences(r["body"] or "")):
            n = len(wanted & distinctive(line))
            if n:
                yield {"version": r["version"], "opinion": r["opinion"], "seq": r["seq"], "at": k, "sentence": line, "overlap": n}

    found = flat_map(rows, score, "version string, opinion int, seq int, at int, sentence string, overlap int")
    best = found.groupBy("version", "opinion").agg(F.max_by(F.struct("seq", "sentence", "overlap"), F.struct("overlap", -F.col("seq"), -F.col("at"))).alias("b"))
    return best.select("version", "b.seq", "b.sentence", "b.overlap")


def pair_outcomes(outcomes: DataFrame) -> DataFrame:
    """key, label, opposed, agreed: the two forms of each holding side by side. outcomes: key, label, kind (opposed or agreed), flagged."""
    a, b = (outcomes.where(F.col("kind") == k).select("key", "label", F.col("flagged").alias(k)) for k in ("opposed", "agreed"))
    return a.join(b, ["key", "label"])

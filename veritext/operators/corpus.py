"""Building and keeping the corpus: metadata, versions, paragraphs, opinions, index upkeep and repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritext.functions import structure
from veritext.functions.citations import extract
from veritext.functions.kernels import flat_map, group_map
from veritext.functions.lexicon import PREAMBLE, ROLES, cue
from veritext.functions.text import label_value, shared_run

MIN_EMBEDDED_CHARS = 60


def tidy_title(title: Column) -> Column:
    """Without a trailing versus; the title itself if nothing else is left."""
    short = F.trim(F.regexp_replace(title, r"(?i)\s+(?:versus|vs\.?|v\.?)\s*$", ""))
    return F.coalesce(F.nullif(short, F.lit("")), title)


def judges(names: Column) -> Column:
    """Names of a bench, without honours."""
    parts = F.split(F.coalesce(names, F.lit("")), r",|\s+AND\s+")
    bare = F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"(?i)\b(?:hon'?ble|mr|mrs|ms|dr|justice)\b\.?", "")))
    return F.filter(bare, lambda x: F.length(x) > 1)


def decision_date(text: Column) -> Column:
    """A date in one of three spellings, else null."""
    return F.coalesce(F.try_to_date(text, "dd-MM-yyyy"), F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "dd/MM/yyyy"))


def canonical_key(case_id: Column, year: Column, path: Column) -> Column:
    """INSC key if the id reads as one, else year and path; null without either."""
    number = F.regexp_extract(case_id, r"(?i)^\s*(\d{4})\s*INSC\s*0*(\d+)\s*$", 2)
    insc = F.concat(F.lit("INSC:"), F.regexp_extract(case_id, r"(\d{4})", 1), F.lit(":"), number)
    return F.when(F.coalesce(number, F.lit("")) != "", insc).when((F.coalesce(path, F.lit("")) != "") & year.isNotNull(), F.concat(F.lit("SCP:"), year.cast("string"), F.lit(":"), path))


def judgments(meta: DataFrame) -> DataFrame:
    """Rows of judgments from source metadata; the first row of each key by path, rows without a key dropped."""
    c = F.col
    title = F.coalesce(F.nullif(tidy_title(c("title")), F.lit("")), F.nullif(F.concat_ws(" versus ", F.nullif(c("petitioner"), F.lit("")), F.nullif(c("respondent"), F.lit(""))), F.lit("")), F.lit("Unknown"))
    out = meta.select(canonical_key(c("case_id"), c("year"), c("path")).alias("canonical_key"), title.alias("title"), judges(c("judge")).alias("judges"), decision_date(c("decision_date")).alias("decided_on"), F.coalesce(F.nullif(c("court"), F.lit("")), F.lit("Unknown")).alias("court"), "path")
    out = out.where("canonical_key is not null").withColumn("bench_strength", F.size("judges"))
    return out.withColumn("_n", F.row_number().over(Window.partitionBy("canonical_key").orderBy("path"))).where("_n = 1").drop("_n")


def new_rows(found: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not held yet: imports may run again."""
    return found.join(held.select(key), key, "left_anti")


def aliases_of(meta: DataFrame) -> DataFrame:
    """canonical_key, normalized, raw: citations in the citation column of metadata."""
    return flat_map(meta.select("canonical_key", "citation"), lambda r: ({"canonical_key": r["canonical_key"], "normalized": c["normalized"], "raw": c["raw"]} for c in extract(r["citation"])), "canonical_key string, normalized string, raw string").dropDuplicates(["normalized"])


def pick_version(versions: DataFrame) -> DataFrame:
    """One text version per judgment: the preferred one first, then the smallest key."""
    return versions.withColumn("_n", F.row_number().over(Window.partitionBy("judgment").orderBy(F.desc("preferred"), "version_key"))).where("_n = 1").drop("_n")


def belongs_in_index(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs of preferred versions outside headnotes; a paragraph of unknown kind belongs."""
    return paragraphs.where("preferred and coalesce(kind, '') <> 'headnote'")


def reconcile(index: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """key, action: delete what the index holds too much, insert what it lacks. Nothing to do gives nothing."""
    gone = index.select(key).join(wanted.select(key), key, "left_anti").withColumn("action", F.lit("delete"))
    return gone.unionByName(wanted.select(key).join(index.select(key), key, "left_anti").withColumn("action", F.lit("insert")))


def needing_text(documents: DataFrame, have: DataFrame, key: str, newest: str, limit: int | None = None, years: list[int] | None = None, year: Column | None = None) -> DataFrame:
    """Documents without text yet, newest first; years: only those of these years, year: where it stands (a date column `newest` by default)."""
    out = documents if years is None else documents.where((F.year(newest) if year is None else F.coalesce(year, F.year(newest))).isin(*years))
    out = out.join(have.select(key), key, "left_anti").orderBy(F.desc(newest), key)
    return out if limit is None else out.limit(limit)


def embeddable(paragraphs: DataFrame, body: str = "body") -> DataFrame:
    return belongs_in_index(paragraphs).where(F.length(body) >= MIN_EMBEDDED_CHARS)


def in_opinions(paragraphs: DataFrame, opinions: DataFrame) -> DataFrame:
    """paragraph rows with opinion and kind: the opinion whose range holds the paragraph, headnotes aside, else the majority.

    An equi-join on the version with the range as a condition; a paragraph in several takes the latest start."""
    inside = (F.col("p.version") == F.col("o.version")) & F.col("p.seq").between(F.col("o.seq_start"), F.col("o.seq_end")) & (F.col("o.kind") != "headnote")
    met = paragraphs.alias("p").join(opinions.alias("o"), inside, "left").select("p.version", "p.seq", F.coalesce("o.kind", F.lit("majority")).alias("kind"), F.coalesce("o.seq_start", F.lit(-1)).alias("at"))
    return met.groupBy("version", "seq").agg(F.max_by("kind", F.struct("at", "kind")).alias("kind"))


def first_labels(paragraphs: DataFrame) -> DataFrame:
    """The first paragraph of each printed label of a version: later ones are quoted."""
    return paragraphs.where("label is not null").withColumn("_n", F.row_number().over(Window.partitionBy("version", "label").orderBy("seq"))).where("_n = 1").drop("_n")


def repeated_lines(pages: DataFrame, doc: str, page: str, text: str, share: float = structure.REPEAT_SHARE, longest: int = structure.REPEAT_CHARS) -> DataFrame:
    """doc, line, n: lines on so many pages of a document of three pages or more that they are furniture."""
    lines = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.explode(F.split(text, "\n")).alias("line")).withColumn("line", F.trim("line")).where(f"line <> '' and length(line) < {longest}")
    size = pages.groupBy(F.col(doc).alias("doc")).agg(F.countDistinct(page).alias("pages")).where("pages >= 3")
    seen = lines.groupBy("doc", "line").agg(F.countDistinct("page").alias("n"))
    return seen.join(size, "doc").where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * share))).select("doc", "line", "n")


def role(body: Column, first: Column) -> Column:
    """The rhetorical role of a paragraph as one chain of JVM patterns; the kernel `reading.role` says the same."""
    out = F.when(first & body.rlike(cue(PREAMBLE)), "preamble")
    for name, phrases in ROLES.items():
        out = out.when(body.rlike(cue(phrases)), name)
    return out.otherwise("none")


def paragraphs_of(documents: DataFrame, key: str = "version", text: str = "text") -> DataFrame:
    """version, seq, label, body, start, end of each document's paragraphs."""
    rows = documents.select(F.col(key).cast("string").alias("version"), F.col(text).alias("text"))
    return flat_map(rows, lambda r: ({"version": r["version"], **p} for p in structure.segment(r["text"])), "version string, seq int, label string, body string, start int, end int")


def out_of_sequence(paragraphs: DataFrame) -> DataFrame:
    """version, seq, resumes: paragraphs whose numbers are not the document's own, and whether its own go on after them."""
    def find(rows):
        labels = [(r["seq"], r["label"]) for r in rows]
        inner = structure.quoted_within(labels)
        for seq in sorted(structure.out_of_sequence(labels)):
            yield {"version": rows[0]["version"], "seq": seq, "resumes": seq in inner}

    return group_map(paragraphs.select("version", "seq", "label"), ["version"], ["seq"], find, "version string, seq int, resumes boolean")


def judgment_parts(documents: DataFrame, key: str = "version", text: str = "text") -> DataFrame:
    """version, headnote, judgment, trailer, coram, author of each document's pages (form feeds between pages)."""
    def split(r):
        body, _ = structure.clean_pages((r["text"] or "").split("\f"))
        head, rest = structure.split_headnote(body)
        rest, tail = structure.split_trailer(rest)
        yield {"version": r["version"], "headnote": head, "judgment": rest, "trailer": tail, "coram": structure.coram(body), "author": structure.author(rest)}

    return flat_map(documents.select(F.col(key).cast("string").alias("version"), F.col(text).alias("text")), split, "version string, headnote string, judgment string, trailer string, coram array<string>, author string")


def separate_opinions(paragraphs: DataFrame) -> DataFrame:
    """version, kind, seq_start, seq_end: the majority and the opinions that begin after it."""
    def find(rows):
        later, last = structure.separate_opinions([(r["seq"], r["body"]) for r in rows]), rows[-1]["seq"]
        marks = [{"kind": "majority", "seq_start": rows[0]["seq"]}, *later]
        for k, m in enumerate(marks):
            yield {"version": rows[0]["version"], **m, "seq_end": marks[k + 1]["seq_start"] - 1 if k + 1 < len(marks) else last}

    return group_map(paragraphs.select("version", "seq", "body"), ["version"], ["seq"], find, "version string, kind string, seq_start int, seq_end int")


def strip_signoff(paragraphs: DataFrame) -> DataFrame:
    """The last paragraph of each version without the publisher's sign-off at its foot; others as they are."""
    last = F.col("seq") == F.max("seq").over(Window.partitionBy("version"))
    strip = structure.without_signoff

    @F.pandas_udf("string")
    def bare(bodies):
        return bodies.map(lambda x: None if x is None else strip(x))

    marked = paragraphs.withColumn("_last", last)
    # Only last paragraphs go through Python.
    return marked.where(~F.col("_last")).unionByName(marked.where("_last").withColumn("body", bare("body"))).drop("_last")


def disposition(paragraphs: DataFrame) -> DataFrame:
    """version, seq of the last paragraph that disposes of the matter."""
    return paragraphs.where(F.col("body").rlike(cue(ROLES["disposition"]))).groupBy("version").agg(F.max("seq").alias("seq"))


#: Words in a row that place a claim elsewhere, and how many times as many as at its pinpoint.
ELSEWHERE_WORDS, ELSEWHERE_TIMES = 10, 2


def check_pinpoint(claims: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """claim_id, result: none_claimed, ok, wrong_paragraph, out_of_range or not_in_judgment. claims: claim_id, version, pinpoint (label or range), and maybe claim; paragraphs: version, seq, label, and maybe body.

    With texts, a pinpoint that exists is wrong if another paragraph has ten or more of the claim's words in a row, and twice as many as those it points at."""
    c = F.col
    low, high = label_value(F.split_part("pinpoint", F.lit("-"), F.lit(1))), label_value(F.split_part("pinpoint", F.lit("-"), F.lit(2)))
    asked = claims.withColumn("low", low).withColumn("high", F.coalesce(high, low))
    labels = first_labels(paragraphs).select("version", "label", label_value(c("label")).alias("value"))
    inside = F.coalesce((c("label") == c("pinpoint")) | c("value").between(c("low"), c("high")), F.lit(False))
    met = asked.join(labels, "version", "left").groupBy("claim_id", "pinpoint", "low", "high").agg(F.max(inside).alias("hit"), F.max("value").alias("top"), F.count("label").alias("n"))
    found = F.when(c("hit"), "ok")
    if "claim" in claims.columns and "body" in paragraphs.columns:
        texts = asked.where("claim is not null").join(first_labels(paragraphs).select("version", "label", "body", label_value(c("label")).alias("value")), "version")
        runs = flat_map(texts.select("claim_id", "claim", "body", inside.alias("here")), lambda r: [{"claim_id": r["claim_id"], "here": r["here"], "words": shared_run(r["claim"], r["body"] or "")[0]}], "claim_id int, here boolean, words int")
        longest = runs.groupBy("claim_id").agg(F.coalesce(F.max(F.when(c("here"), c("words"))), F.lit(0)).alias("at"), F.coalesce(F.max(F.when(~c("here"), c("words"))), F.lit(0)).alias("off"))
        met = met.join(longest, "claim_id", "left")
        found = F.when(c("hit") & F.coalesce((c("off") >= ELSEWHERE_WORDS) & (c("off") >= ELSEWHERE_TIMES * c("at")), F.lit(False)), "wrong_paragraph").when(c("hit"), "ok")
    state = F.when(c("pinpoint").isNull(), "none_claimed").when(found.isNotNull(), found).when((c("n") > 0) & (c("low") > c("top")), "out_of_range").otherwise("not_in_judgment")
    return met.select("claim_id", state.alias("result"))


def text_versions(documents: DataFrame, key: str = "version", text: str = "text") -> DataFrame:
    """version, sha256, char_count, n_words, and whether enough text for a judgment is there."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_count(body, F.lit("[\\p{L}\\p{N}_]+"))
    return documents.select(F.col(key).alias("version"), F.sha2(body, 256).alias("sha256"), F.length(body).alias("char_count"), words.alias("n_words"), (F.length(body) > 500).alias("has_judgment"))


def replace_versions(held: DataFrame, new: DataFrame, key: str = "version") -> DataFrame:
    """What is held, with the rows of versions that come anew replaced: storing twice changes nothing."""
    return held.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def corrected_bench(recorded: Column, coram: Column) -> Column:
    """The printed bench line corrects the recorded strength upward only."""
    return F.greatest(F.coalesce(recorded, F.lit(0)), F.coalesce(F.size(coram), F.lit(0)))


def figures(documents: DataFrame, source: str, judgments: DataFrame, day: str) -> DataFrame:
    """n, sources, first_day, last_day: size of a corpus and the days that it spans."""
    days = judgments.agg(F.min(day).cast("date").cast("string").alias("first_day"), F.max(day).cast("date").cast("string").alias("last_day"))
    return documents.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(source).alias("sources")).join(F.broadcast(days), F.lit(True))  # one row each


def by_court(judgments: DataFrame) -> DataFrame:
    """court, n; a court of null is unrecorded."""
    return judgments.groupBy(F.coalesce("court", F.lit("unrecorded")).alias("court")).agg(F.count(F.lit(1)).alias("n"))


def opinion_counts(opinions: DataFrame) -> DataFrame:
    """kind, n, versions: opinions of each kind, and how many versions have one."""
    return opinions.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("version").alias("versions"))


def last_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """The last paragraph of each version, in one pass without a window."""
    rest = [c for c in paragraphs.columns if c != "version"]
    last = paragraphs.groupBy("version").agg(F.max_by(F.struct(*rest), "seq").alias("last"))
    return last.select("version", *[F.col(f"last.{c}").alias(c) for c in rest])

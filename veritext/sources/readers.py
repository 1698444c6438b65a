"""Sources: metadata, JSON lines, failure lists, briefs, call logs and case plans."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = "title string, petitioner string, respondent string, description string, judge string, author_judge string, citation string, case_id string, cnr string, decision_date string, disposal_nature string, court string, available_languages string, raw_html string, path string, nc_display string, scraped_at string, year string"
GOLD = "id string, claim_text string, citation_raw string, planted_error int, labels struct<exists:boolean,judgment_key:string,paragraph_label:string,support:string,voice:string,weight:string,treatment:string,applicability:string>, source string, user_facts string, annotator string, second_annotator string, notes string"
RETRIEVAL = "judgment_key string, paragraph_label string, sentence string, query string, kind string"
ENCODINGS = ("utf-8", "utf-16", "cp1252", "latin-1")
MIN_PROPOSITION_WORDS = 6


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """Parquet metadata, one file a year; year=YYYY folders are read as partitions."""
    return spark.read.schema(METADATA).option("basePath", path).parquet(path)


def years(spark: SparkSession, path: str) -> DataFrame:
    """year, from the names of the partition folders alone, in order."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm.Path(root, "year=*")) or []
    names = sorted(f.getPath().getName().partition("=")[2] for f in found)
    return spark.createDataFrame([(int(n),) for n in names if n.isdigit()], "year int")


def json_lines(spark: SparkSession, path: str, schema: str = GOLD) -> DataFrame:
    """JSON lines with a fixed schema: unknown keys are dropped, blank lines skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def failures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("source_id string, reason string").option("sep", "\t").csv(path)


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """vec_id and float vectors as stored."""
    return spark.read.parquet(path)


def briefs(spark: SparkSession, path: str) -> DataFrame:
    """path, text, error of brief files: text in the first encoding that fits; .doc is refused, .pdf and .docx need readers that are not installed."""
    raw = spark.read.format("binaryFile").load(path)
    from veritext.functions.kernels import flat_map

    def decode(r):
        kind = r["path"].rsplit(".", 1)[-1].lower()
        if kind in ("doc", "pdf", "docx"):
            yield {"path": r["path"], "text": None, "error": f"{kind} files can't be read here"}
            return
        for name in ENCODINGS:
            try:
                if name == "utf-16" and r["content"][:2] not in (b"\xff\xfe", b"\xfe\xff"):
                    continue
                yield {"path": r["path"], "text": r["content"].decode(name), "error": None}
                return
            except UnicodeDecodeError:
                continue

    return flat_map(raw.select("path", "content"), decode, "path string, text string, error string")


def call_log(calls: DataFrame) -> DataFrame:
    """model, calls, failed, rate, upper median of prompt tokens. calls: model, status, prompt_tokens."""
    failed = F.count_if(F.coalesce(F.col("status") >= 400, F.lit(True)))
    middle = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY prompt_tokens DESC)").cast("long")  # counts a number once, however often it occurs
    return calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), failed.alias("failed"), F.round(failed / F.count(F.lit(1)), 6).alias("rate"), middle.alias("median_prompt"))


class PlanError(ValueError):
    """A case plan that can't be read; the message names the line."""


def plan(text: str) -> dict:
    """A case plan: `key: value` headers, then sections synopsis, dates, issue (with propositions) and prayer; // starts a comment."""
    out = {"headers": {}, "synopsis": [], "dates": [], "issues": [], "prayer": []}
    section = None
    for number, raw in enumerate(text.splitlines(), 1):
        line = re.sub(r"(^|\s)//.*$", "", raw).strip()
        if not line:
            continue
        if line.startswith("#"):
            name, _, rest = line[1:].strip().partition(" ")
            section = name.lower().rstrip(":")
            if section not in ("synopsis", "dates", "issue", "prayer"):
                raise PlanError(f"line {number}: no section is called {name!r}")
            if section == "issue":
                out["issues"].append({"title": rest.strip(" :"), "propositions": []})
        elif section is None:
            key, colon, value = line.partition(":")
            if not colon:
                raise PlanError(f"line {number}: a header is `key: value`")
            out["headers"][key.strip().lower()] = value.strip()
        elif section == "issue":
            said = line.lstrip("-* ").strip()
            if len(said.split()) < MIN_PROPOSITION_WORDS:
                raise PlanError(f"line {number}: a proposition has at least {MIN_PROPOSITION_WORDS} words")
            out["issues"][-1]["propositions"].append(said)
        else:
            out[section].append(line)
    return out


def plan_rows(spark: SparkSession, text: str) -> DataFrame:
    """issue, title, place, proposition of a plan."""
    rows = [(i, x["title"], k, p) for i, x in enumerate(plan(text)["issues"], 1) for k, p in enumerate(x["propositions"], 1)]
    return spark.createDataFrame(rows, "issue int, title string, place int, proposition string")

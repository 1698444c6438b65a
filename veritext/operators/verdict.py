"""From detector outputs to graded verdicts, gates, memos and boards, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritext.functions.lexicon import GRADES, MODEL_MODES, MODES

#: Detector outputs of a citation; nulls mean that the detector did not run.
INPUT = (
    "citation_id int, status string, method string, name_mismatch boolean, review boolean, hierarchy string, pinpoint string, truncated boolean, likely_quoted boolean, voice string, endorsed boolean, voice_review boolean, "
    "treatment string, applicability string, weight string, support string, quote_verified boolean, found_label string, claimed_label string"
)


def _fixed(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def covers(claimed: Column, label: Column) -> Column:
    """Whether a claimed pinpoint, one label or a range, holds a label."""
    low, high = F.split_part(claimed, F.lit("-"), F.lit(1)).try_cast("double"), F.split_part(claimed, F.lit("-"), F.lit(2)).try_cast("double")
    return _fixed(claimed == label) | _fixed(F.contains(claimed, F.lit("-")) & (label.try_cast("double") >= low) & (label.try_cast("double") <= high))


def rubric(df: DataFrame) -> DataFrame:
    """citation_id, grade, modes (in order, joined by commas), needs_review, support.

    A grade falls by steps or to a floor and never rises; unresolved and
    ambiguous citations end there, and what was not assessed costs nothing."""
    c = F.col
    problem_voice = c("voice").isin("counsel_argument", "lower_court", "headnote") | ((c("voice") == "quoted_precedent") & ~_fixed(c("endorsed")))
    dissent = _fixed(c("voice") == "court_dissent")
    doubtful = c("treatment").isin("overruled", "partly_overruled", "reversed", "doubted", "referred_to_larger_bench", "undermined")
    read = c("support").isNotNull() & ~c("support").isin("not_assessed", "error", "malformed")
    elsewhere = read & _fixed(c("quote_verified")) & c("found_label").isNotNull() & c("claimed_label").isNotNull() & ~covers(c("claimed_label"), c("found_label"))
    # Each step: condition, mode, how far the grade drops, floor. The order is that of the findings.
    steps = [
        (_fixed(c("name_mismatch")), 2, 2, 0), (_fixed(c("method") == "party_name"), 2, 2, 0), (_fixed(c("hierarchy").isin("wrong_court", "overstated_bench")), 3, 0, 3),
        (_fixed(c("pinpoint").isin("wrong_paragraph", "out_of_range", "not_in_judgment")), 12, 2, 0), (_fixed(c("truncated")), 9, 2, 0), (_fixed(c("likely_quoted")) & c("voice").isNull(), 5, 1, 0),
        (dissent, 6, 0, 3), (~dissent & _fixed(problem_voice), 5, 0, 3), (_fixed(doubtful), 10, 0, 3), (_fixed(c("applicability") == "inapplicable"), 11, 1, 0), (_fixed(c("weight") == "obiter"), 7, 1, 0),
        (read & c("support").isin("contradicted", "none"), 4, 5, 0), (read & (c("support") == "partial") & ~_fixed(c("truncated")), 8, 2, 0), (read & (c("support") == "partial") & _fixed(c("truncated")), None, 2, 0), (elsewhere, 12, 1, 0),
    ]
    taken = F.array(*[F.struct(when.alias("holds"), F.lit(drop).alias("drop"), F.lit(floor).alias("floor")) for when, _, drop, floor in steps])
    grade = F.aggregate(taken, F.lit(0), lambda g, s: F.when(s["holds"], F.greatest(F.least(g + s["drop"], F.lit(5)), s["floor"])).otherwise(g))
    modes = [F.when(when, F.lit(str(mode))) for when, mode, _, _ in steps if mode]
    missing, ambiguous = _fixed(c("status") == "not_found"), _fixed(c("status") == "ambiguous")
    letters = F.array(*[F.lit(g) for g in GRADES])
    unread = c("support").isNotNull() & ~read
    asked = missing | ambiguous | _fixed(c("review")) | (c("voice").isNotNull() & _fixed(c("voice_review"))) | unread
    return df.select(
        "citation_id",
        F.when(missing, "F").when(ambiguous, "C").otherwise(F.get(letters, grade)).alias("grade"),
        F.when(missing, "1").when(ambiguous, "").otherwise(F.concat_ws(",", *modes)).alias("modes"),
        asked.alias("needs_review"),
        F.when(missing | ambiguous | c("support").isNull() | unread, "not_assessed").otherwise(c("support")).alias("support"),
    )


def board(verdicts: DataFrame) -> DataFrame:
    """grade, n, plus the number of verdicts at D or worse and of those in need of review, over all grades."""
    totals = verdicts.agg(F.count_if(F.col("grade") >= "D").alias("d_or_worse"), F.count_if("needs_review").alias("in_review"))
    return verdicts.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(totals), F.lit(True))


def marker(verdicts: DataFrame) -> DataFrame:
    """The mark that a brief gets behind each citation: grade and modes, a question, or ok."""
    text = F.when(F.col("modes") != "", F.concat(F.lit("[!"), "grade", F.lit(" "), F.array_join(F.array_distinct(F.split("modes", ",")), ","), F.lit("]"))).when(F.col("needs_review"), F.concat(F.lit("[?"), "grade", F.lit("]"))).otherwise("[ok]")
    return verdicts.select("citation_id", text.alias("marker"))


def gate(df: DataFrame) -> DataFrame:
    """id, status of a proposition's authority: bound, narrowed, unchecked or refused, by the first rule that holds.

    df: id, status, voice_ok, treatment_ok, support, narrowed."""
    c = F.col
    state = (
        F.when(c("status") != "found", "refused").when(~_fixed(c("voice_ok")), "refused").when(~_fixed(c("treatment_ok")), "refused")
        .when(c("support").isNull() | c("support").isin("not_assessed", "error", "malformed"), "unchecked")
        .when((c("support") == "full") & c("narrowed").isNull(), "bound").when(c("support").isin("full", "partial") & c("narrowed").isNotNull(), "narrowed").otherwise("refused")
    )
    return df.select("id", state.alias("status"))


def scope_check(df: DataFrame) -> DataFrame:
    """id, support, needs_review of model answers after the string checks. df: id, support, quote_words, quote_found, narrowed, claim_words, narrowed_words, confidence.

    Support needs a quotation of six words that stands in the source; a narrowing that is far longer than the claim is ignored; no confidence is not low confidence."""
    c = F.col
    grounded = (c("quote_words") >= 6) & _fixed(c("quote_found"))
    narrowed = c("narrowed").isNotNull() & (c("narrowed_words") <= F.greatest(F.lit(40.0), 2.0 * c("claim_words")))
    claims = c("support").isin("full", "partial")
    support = F.when(c("support").isNull() | c("support").isin("not_assessed", "error", "malformed"), "not_assessed").when(claims & ~_fixed(grounded), "none").when((c("support") == "full") & narrowed, "partial").otherwise(c("support"))
    review = c("support").isNull() | c("support").isin("not_assessed", "error", "malformed") | (claims & ~_fixed(grounded)) | _fixed(c("confidence") < 0.35)
    return df.select("id", support.alias("support"), review.alias("needs_review"))


def memo(findings: DataFrame) -> DataFrame:
    """citation_id, place, mode, name: one attack per failure mode, gravest first. findings: citation_id, mode, drop."""
    names = F.create_map(*[F.lit(x) for k, v in MODES.items() for x in (k, v)])
    worst = findings.groupBy("citation_id", "mode").agg(F.max("drop").alias("drop"))
    from pyspark.sql import Window

    w = Window.partitionBy("citation_id").orderBy(F.desc("drop"), "mode")
    return worst.select("citation_id", F.row_number().over(w).alias("place"), "mode", names[F.col("mode")].alias("name"))


def recall_by_mode(items: DataFrame) -> DataFrame:
    """mode, planted, caught, recall, needs_model over items (item, planted_mode, modes found joined by commas); clean items have no mode."""
    planted = items.where("planted_mode is not null")
    hit = F.array_contains(F.split("modes", ","), F.col("planted_mode").cast("string"))
    out = planted.groupBy(F.col("planted_mode").alias("mode")).agg(F.count(F.lit(1)).alias("planted"), F.count_if(hit).alias("caught"))
    return out.select("mode", "planted", "caught", F.round(F.col("caught") / F.col("planted"), 6).alias("recall"), F.col("mode").isin(*MODEL_MODES).alias("needs_model"))


def false_positives(items: DataFrame) -> DataFrame:
    """clean, flagged, rate: clean items that got a finding; no rate without clean items."""
    clean = items.where("planted_mode is null")
    out = clean.agg(F.count(F.lit(1)).alias("clean"), F.count_if(F.col("modes") != "").alias("flagged"))
    return out.select("clean", "flagged", F.round(F.try_divide(F.col("flagged").cast("double"), F.col("clean")), 6).alias("rate"))


def recall_at(outcomes: DataFrame, *ks: int) -> DataFrame:
    """kind, n, recall_at_k for each k, over outcomes (kind, rank or null)."""
    found = [F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_at_{k}") for k in ks]
    return outcomes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), *found)


def flips(pairs: DataFrame) -> DataFrame:
    """opposed_only, agreed_only, both, neither over pairs (key, opposed, agreed) of flags."""
    return pairs.agg(F.count_if(F.expr("opposed and not agreed")).alias("opposed_only"), F.count_if(F.expr("agreed and not opposed")).alias("agreed_only"), F.count_if(F.expr("opposed and agreed")).alias("both_flagged"), F.count_if(F.expr("not opposed and not agreed")).alias("neither"))


def traffic(calls: DataFrame) -> DataFrame:
    """kind, mean_value, share of all calls. calls: kind, value."""
    n = calls.agg(F.count(F.lit(1)).alias("total"))
    by = calls.groupBy("kind").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.count(F.lit(1)).alias("n"))
    return by.join(F.broadcast(n), F.lit(True)).select("kind", "mean_value", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def outcome_table(items: DataFrame, key: str, outcomes: list[str]) -> DataFrame:
    """Counts of each outcome per key, a column an outcome; zero where there is none. items: key, outcome."""
    return items.groupBy(key).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in outcomes])


def lowered(step: Column, down: Column, floor: Column) -> Column:
    """The grade (A to F) some steps below a step (0 for A), F at the most, and at least as bad as a floor's step."""
    return F.get(F.array(*[F.lit(g) for g in "ABCDEF"]), F.greatest(F.least(step + down, F.lit(5)), floor).cast("int"))


def rates(items: DataFrame) -> DataFrame:
    """grounding (verdicts that claim support and have a verified quotation), abstention (those in need of review), mean_seconds of timed items; null without any. items: support, quote_verified, needs_review, seconds."""
    claims = F.col("support").isin("full", "partial")
    return items.agg(
        F.round(F.avg(F.when(claims, _fixed(F.col("quote_verified")).cast("double"))), 6).alias("grounding"),
        F.round(F.avg(F.when(F.col("support").isNotNull(), _fixed(F.col("needs_review")).cast("double"))), 6).alias("abstention"),
        F.round(F.avg(F.when(F.col("seconds") > 0, F.col("seconds").cast("double"))), 6).alias("mean_seconds"),
    )


def line_accuracy(outcomes: DataFrame) -> DataFrame:
    """kind, found, accuracy: of the searches that found the paragraph, how many named its line; null where none did. outcomes: kind, rank, line_matched."""
    hit = F.when(F.col("rank").isNotNull(), _fixed(F.col("line_matched")).cast("double"))
    return outcomes.groupBy("kind").agg(F.count("rank").alias("found"), F.round(F.avg(hit), 6).alias("accuracy"))

"""Operators on small fixtures: invariants, states and upkeep."""

import time

import pytest

from pyspark.sql import functions as F

from veritext.functions.text import find_quote, token_set_ratio
from veritext.operators import citator, contrary, corpus, drafting, resolve, retrieval, verdict
from veritext.sources import readers, writers
from veritext.streaming import limits


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def asked(spark, q):
    return spark.createDataFrame([(0, q)], "query_id int, query string")


def test_bm25(spark):
    d = docs(spark, "red fox", "red red dog", "blue sea", "", None)
    got = retrieval.bm25(d, asked(spark, "red fox"), 10).orderBy("rank").collect()
    assert [r.id for r in got] == [0, 1]
    assert retrieval.bm25(d, asked(spark, "the of"), 10).count() == 0
    assert retrieval.bm25(d.limit(0), asked(spark, "red"), 10).count() == 0


def test_index_equals_scan(spark, tmp_path):
    d = docs(spark, "red fox red", "red dog", "blue sea fox", "", None)
    retrieval.write_index(d, str(tmp_path), buckets=4)
    q = spark.createDataFrame([(0, "red fox"), (1, "sea"), (2, "nothing here")], "query_id int, query string")
    key = lambda df: sorted((r.query_id, r.id, round(r.score, 9), r["rank"]) for r in df.collect())
    assert key(retrieval.search_index(spark, str(tmp_path), q, 10)) == key(retrieval.bm25(d, q, 10)) != []
    plan = retrieval.search_index(spark, str(tmp_path), q, 10)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan


def test_near_counts_all_tokens(spark):
    gap = " ".join(["x"] * 12)
    d = docs(spark, f"alpha {gap} beta", f"alpha {gap} x x beta", "beta alpha")
    assert {r.id for r in retrieval.near(d, ["alpha", "beta"]).collect()} == {0, 2}


def test_fusion_of_one_ranking_is_that_ranking(spark):
    r = spark.createDataFrame([(0, i, k) for k, i in enumerate("cab", 1)], "ranker int, item string, rank int")
    assert [x["item"] for x in retrieval.fuse(r).orderBy("score", ascending=False).collect()] == list("cab")


def test_bench_rule_and_standing(spark):
    e = spark.createDataFrame([(1, "F", "B", "followed", "2016-01-01"), (2, "K", "B", "overruled", "2020-01-01"), (3, "L", "B", "relied_on", "2022-01-01")], "edge_id int, citing string, cited string, treatment string, citing_date string")
    cases = spark.createDataFrame([(x,) for x in "BFKL"], "case string")
    got = {r.case: (r.status, r.is_unchecked, r.is_doubtful) for r in citator.standing(cases, e).collect()}
    assert got == {"B": ("overruled", False, True), "F": ("undermined", False, True), "K": ("good_law", True, False), "L": ("good_law", True, False)}


def test_reconcile_twice_changes_nothing(spark):
    have, want = docs(spark, "a", "b"), docs(spark, "a", "b", "c").where("doc_id > 0")
    got = sorted((r.doc_id, r.action) for r in corpus.reconcile(have, want, "doc_id").collect())
    assert got == [(0, "delete"), (2, "insert")]
    assert corpus.reconcile(want, want, "doc_id").count() == 0


def test_blocked_names_equal_all_pairs(spark):
    titles = [("A", "Gurmit Singh Bhatia versus Kiran Robinson", 2019), ("B", "State of Kerala versus Rao", 2018), ("C", "Union of India versus Sharma", 2001)]
    names = [(1, "Gurmit Singh Bhatia v. Kiran Robinson", 2020), (2, "State of Kerala v. Rao", 2021), (3, "Kerala State v. Rao", 2018)]
    t, n = spark.createDataFrame(titles, "case string, title string, title_year int"), spark.createDataFrame(names, "name_id int, name string, year int")
    got = {r.name_id: (r.case, r.status) for r in resolve.by_parties(n, t).collect()}
    assert got == {1: ("A", "found"), 2: (None, "not_found"), 3: ("B", "found")}


def test_names_without_year_or_long_word_or_common_word(spark):
    titles = [("A", "Gurmit Singh Bhatia versus Kiran Robinson", 2019), ("B", "Rao versus Das", 2018), ("C", "Ramachandran Krishnamurthy", None), ("D", "Ramachandran Krishnamurthy", 1990), ("E", "Lal versus Om", 2001), ("F", "Om versus Lal", 2002), ("G", None, 2018)]
    names = [(1, "Gurmit Singh Bhatia v. Kiran Robinson", None), (2, "Rao versus Das", 2019), (3, "Ramachandra Krishnamurti", 1991), (4, "Ramachandra Krishnamurti", None), (5, "Lal versus Om", 2001), (6, "Lal versus Om", 2001), (7, None, 2018), (8, "Rao versus Das", 2021)]
    t, n = spark.createDataFrame(titles, "case string, title string, title_year int"), spark.createDataFrame(names, "name_id int, name string, year int")
    want = {}
    for i, name, year in names:
        near = sorted((-round(token_set_ratio(name or "", title or ""), 6), case) for case, title, y in titles if year is None or y is not None and abs(y - year) <= 1)
        near = [x for x in near if -x[0] >= resolve.PARTY_SCORE]
        close = len(near) > 1 and near[1][0] - near[0][0] < resolve.PARTY_MARGIN
        want[i] = (near[0][1] if near else None, "not_found" if not near else "ambiguous" if close else "found")
    got = resolve.by_parties(n, t).collect()
    assert {r.name_id: (r.case, r.status) for r in got} == want and len(got) == len(names)
    assert want[1] == ("A", "found") and want[2] == ("B", "found") and want[3] == ("D", "found") and want[4] == ("C", "ambiguous") and want[5] == ("E", "ambiguous")


def test_equal_pairs_of_names_are_scored_once(spark, tmp_path, monkeypatch):
    """4 names and 4 titles of 40 years: 16 different pairs, and 1,888 with their years."""
    real, log = token_set_ratio, str(tmp_path / "log")

    def counted(a, b):
        with open(log, "a") as f:
            f.write(f"{a}|{b}\n")
        return real(a, b)

    monkeypatch.setattr(resolve, "token_set_ratio", counted)
    said = ["Rao versus Das", "Lal versus Om", "Gurmit Singh Bhatia", "State of Kerala"]
    t = spark.createDataFrame([(100 * y + k, s, y) for y in range(1980, 2020) for k, s in enumerate(said)], "case int, title string, title_year int")
    n = spark.createDataFrame([(100 * y + k, s, y) for y in range(1980, 2020) for k, s in enumerate(said)], "name_id int, name string, year int")
    got = resolve.by_parties(n, t).collect()
    assert len(got) == 160 and all(r.case == (r.name_id - 100 if r.name_id >= 198100 else r.name_id) and r.status == "ambiguous" for r in got)
    lines = open(log).read().split("\n")[:-1]
    assert 4 <= len(lines) <= 2 * 16


@pytest.mark.parametrize("least", [0, 60, 88, 92, 100])
def test_letter_counts_pass_over_no_alike_names(least):
    import numpy as np

    names = ["", "Rao", "rao v. state", "State of Kerala v. Rao", "Stat of Kerela v Rao", "Ramachandran Krishnamurthy", "Ramachandra Krishnamurti", "Krishnamurti", "Om Lal", "Lal Om and others", "é É", "123 456", "Union of India versus Sharma", "a b c d e f g h"]
    a, b = map(np.ravel, np.meshgrid(np.arange(len(names)), np.arange(len(names))))
    kept = resolve.may_score(names, names, a, b, least)
    assert all(k or round(token_set_ratio(names[i], names[j]), 6) < least for i, j, k in zip(a, b, kept)) and (least < 88 or not kept.all())


def test_verdict_states(spark):
    none = {f.split(" ")[0]: None for f in verdict.INPUT.split(", ")}
    rows = [{**none, "citation_id": 1, "status": "found"}, {**none, "citation_id": 2, "status": "found", "support": "error"}, {**none, "citation_id": 3, "status": "found", "support": "none"}]
    got = {r.citation_id: (r.grade, r.support, r.needs_review) for r in verdict.rubric(spark.createDataFrame(rows, verdict.INPUT)).collect()}
    assert got == {1: ("A", "not_assessed", False), 2: ("A", "not_assessed", True), 3: ("F", "none", False)}


def test_rate_limit_batch_and_stream_agree(spark, tmp_path):
    rows = [("a", "read", f"2024-01-01 00:00:{s:02d}") for s in (0, 1, 2, 30, 59)] + [("b", "read", "2024-01-01 00:00:05")]
    events = spark.createDataFrame(rows, "client string, bucket string, ts string").selectExpr("client", "bucket", "cast(ts as timestamp_ntz) as ts")
    want = sorted(map(tuple, limits.limit(events, 2, 30.0).collect()))
    assert [w[4] for w in want if w[0] == "a"] == [True, True, False, True, True]
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = limits.limit_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), 2, 30.0).writeStream.format("memory").queryName("limits").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("limits").collect())) == want


def test_incremental_index(spark, tmp_path):
    src, index, state = (str(tmp_path / x) for x in ("src", "index", "state"))
    for part in (docs(spark, "red fox"), docs(spark, "x", "blue sea").where("doc_id = 1")):
        part.write.mode("append").parquet(src)
        limits.index_new_documents(spark.readStream.schema(part.schema).parquet(src), index, state).awaitTermination()
    assert sorted((r.id, r.term) for r in spark.read.parquet(index + "/postings").collect()) == [(0, "fox"), (0, "red"), (1, "blue"), (1, "sea")]
    assert [r.id for r in retrieval.search_index(spark, index, asked(spark, "red sea"), 10).orderBy("id").collect()] == [0, 1]
    # A batch that runs again after a failure replaces itself.
    retrieval.add_to_index(docs(spark, "x", "blue sea").where("doc_id = 1"), index, 2)
    assert spark.read.parquet(index + "/postings").count() == 4 and spark.read.parquet(index + "/figures").agg({"n": "sum"}).first()[0] == 2


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "gold.jsonl").write_text('{"id": "1", "claim_text": "x", "unknown": 3}\n\n{"id": "2", "planted_error": 4}\n')
    assert {r.id: r.planted_error for r in readers.json_lines(spark, str(tmp_path / "gold.jsonl")).collect()} == {"1": None, "2": 4}
    fails = spark.createDataFrame([("a", "gone")], "source_id string, reason string")
    writers.failures(fails, str(tmp_path / "f"))
    assert readers.failures(spark, str(tmp_path / "f")).collect() == fails.collect()
    (tmp_path / "b").mkdir()
    (tmp_path / "b/a.txt").write_bytes("é".encode("cp1252"))
    (tmp_path / "b/x.doc").write_bytes(b"d")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error is None) for r in readers.briefs(spark, str(tmp_path / "b")).collect()}
    assert got == {"a.txt": ("é", True), "x.doc": (None, False)}
    part = spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string")
    writers.replace_partitions(part, str(tmp_path / "p"), "k")
    writers.replace_partitions(part.where("k = 'a'").selectExpr("9 as v", "k"), str(tmp_path / "p"), "k")
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [2, 9]


def test_plan():
    p = readers.plan("title: X\n# issue Notice // comment\n- one two three four five six\n")
    assert p["issues"][0]["propositions"] == ["one two three four five six"]
    with pytest.raises(readers.PlanError, match="line 2"):
        readers.plan("# issue A\nfew words")
    assert writers.roman(14) == "xiv" and writers.annotate("ab", [(1, "[x]"), (2, "[y]")]) == "a [x]b [y]"
    assert writers.markdown(writers.blocks(p, [{"proposition": "It is so.", "citation": None, "label": None}])).startswith("# X")


def test_storing_twice_changes_nothing(spark):
    d = spark.createDataFrame([("v1", "x" * 600), ("v2", None)], "version string, text string")
    rows = corpus.text_versions(d)
    assert {r.version: (r.char_count, r.has_judgment) for r in rows.collect()} == {"v1": (600, True), "v2": (0, False)}
    once = corpus.replace_versions(rows.limit(0), rows)
    assert sorted(map(tuple, corpus.replace_versions(once, rows).collect())) == sorted(map(tuple, rows.collect()))
    bench = spark.createDataFrame([(2, ["A", "B", "C"]), (5, ["A"]), (None, None)], "b int, c array<string>").select(corpus.corrected_bench(F.col("b"), F.col("c")).alias("x"))
    assert [r.x for r in bench.collect()] == [3, 5, 0]


def test_dissents_and_pairs(spark):
    p = spark.createDataFrame([("v", 1, "The notice was good."), ("v", 5, "I dissent. The tenancy notice was never served on the tenant."), ("v", 6, "Rain.")], "version string, seq int, body string")
    o = spark.createDataFrame([("v", "majority", 1, 4), ("v", "dissenting", 5, 6)], "version string, kind string, seq_start int, seq_end int")
    (row,) = contrary.dissents(p, o, "A tenancy notice must be served on the tenant").collect()
    assert row.seq == 5 and row.sentence.startswith("The tenancy notice") and row.overlap == 4
    out = spark.createDataFrame([("k", "1", "opposed", True), ("k", "1", "agreed", False), ("k", "2", "opposed", True)], "key string, label string, kind string, flagged boolean")
    pairs = contrary.pair_outcomes(out)
    assert tuple(verdict.flips(pairs).first()) == (1, 0, 0, 0)


def test_attack_window_and_encoder(spark):
    body = " ".join(f"Sentence number {k} about nothing much at all." for k in range(80)) + " The tenancy notice was bad. " + "More words here. " * 60
    shown = drafting.window(body, "tenancy notice")
    assert "tenancy notice" in shown and len(shown) == drafting.WINDOW_CHARS and drafting.window("short", "x") == "short"
    v = drafting.encode(docs(spark, "aa", "", None), lambda texts: [[len(t), 0.0] for t in texts], "doc_id", "text")
    assert sorted((r.doc_id, r.vector) for r in v.collect()) == [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [0.0, 0.0])]


def test_quotes_meet_every_passage(spark):
    said = "The Learned judge was of  the opinion that the “decree” could not be executed at all by the court below"
    quotes = [(1, 'the learned judge was of the opinion that the "decree" could not be executed at all'), (2, "was of the opinion that the decree"), (3, "a-b-c-d-e-f"), (4, "too short"), (5, "earned judge was of the opinion that the 'decree"), (6, None)]
    passages = [(1000, said, False), (1001, said.replace("opinion", "opinlon").replace("“decree”", '"decree"'), True), (1002, said.replace("opinion", "opinlon"), False), (1003, "xa-b-c-d-e-fx", None), (1004, "Nothing of it.", True), (1005, None, True), (1006, said.upper(), False)]
    want = set()
    for i, q in quotes:
        for d, t, ocr in passages:
            found = find_quote(q, t, bool(ocr)) if q and t else None
            if found and found.start is not None:
                want.add((i, d, found.kind, found.start, found.end))
    got = contrary.quote_matches(spark.createDataFrame(quotes, "item_id long, quote string"), spark.createDataFrame(passages, "doc_id long, text string, ocr boolean")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert {(1, 1000), (1, 1001), (1, 1006), (3, 1003)} <= {x[:2] for x in want}


def test_contained_finds_quotations_of_any_length(spark):
    from veritext.operators import contrary

    texts = [(1, "alpha beta  Gamma delta epsilon"), (2, "nothing here"), (3, "x" + " one two three four five six seven eight nine ten" + "y"), (4, None), (5, "")]
    quotes = [(1, "beta gamma delta"), (2, "gamma"), (3, "amma del"), (4, "ne two three four five six seven eight nine te"), (5, "beta delta"), (6, "one two three four five six seven nine"), (7, None), (8, "HERE")]
    got = {(r.doc_id, r.item_id) for r in contrary.contained(spark.createDataFrame(quotes, "item_id long, quote string"), spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    fold = lambda s: " ".join(s.lower().split())
    assert got == {(d, q) for d, t in texts for q, s in quotes if t is not None and s is not None and fold(s) in fold(t)}
    assert contrary.contained(spark.createDataFrame([], "item_id long, quote string"), spark.createDataFrame(texts, "doc_id long, text string")).count() == 0


def test_contained_reads_a_long_text_once(spark):
    """One text of 40,000 words; a text split again at each of its words takes minutes."""
    said = " ".join(f"w{k}" for k in range(40000))
    quotes = [(1, said[-60:]), (2, "w5 w6 w7"), (3, "w1 w2 w3 w4 w5 w6 w7 w9")]
    contrary.contained(spark.createDataFrame(quotes, "item_id long, quote string"), spark.createDataFrame([(2, "w5")], "doc_id long, text string")).collect()  # compiles
    began = time.monotonic()
    got = contrary.contained(spark.createDataFrame(quotes, "item_id long, quote string"), spark.createDataFrame([(1, said)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (1, 2)}
    assert time.monotonic() - began < 25


def test_shared_runs_read_a_long_text_once(spark):
    """As above, where claims meet passages, for all claims that share six words."""
    said = " ".join(f"w{k}" for k in range(40000))
    claims = [(1, "x W39990 w39991 w39992  w39993 w39994 w39995 w39996 y"), (2, "w1 w2 w3 w4 w5 x w6 w7"), (3, "w1 w2 w3 w4 w5 w6"), (4, None)]
    contrary.shared_runs(spark.createDataFrame(claims, "claim_id long, claim string"), spark.createDataFrame([(2, "w1 w2")], "id long, text string")).collect()  # compiles
    began = time.monotonic()
    got = contrary.shared_runs(spark.createDataFrame(claims, "claim_id long, claim string"), spark.createDataFrame([(1, said), (2, "w1 w2"), (3, None)], "id long, text string")).collect()
    assert sorted((r.claim_id, r.id, r.words) for r in got) == [(1, 1, 7), (3, 1, 6)]
    assert time.monotonic() - began < 25


def test_pinpoint_that_points_past_the_words(spark):
    said = "a tenancy ends only where notice is given in writing to the tenant by the landlord"
    p = spark.createDataFrame([("v", 1, "1", f"We hold that {said}."), ("v", 2, "2", "Rain fell on the roof of the house."), ("v", 3, "3", "A tenancy ends only where notice is given in writing."), ("v", 4, None, said)], "version string, seq int, label string, body string")
    claims = [(1, "v", "1", said), (2, "v", "2", said), (3, "v", "3", said), (4, "v", "1-2", said), (5, "v", "9", said), (6, "v", None, said), (7, "v", "2", None)]
    got = {r.claim_id: r.result for r in corpus.check_pinpoint(spark.createDataFrame(claims, "claim_id int, version string, pinpoint string, claim string"), p).collect()}
    assert got == {1: "ok", 2: "wrong_paragraph", 3: "ok", 4: "ok", 5: "out_of_range", 6: "none_claimed", 7: "ok"}


def test_contrary_search_passes_over_questions_records_and_quotations(spark):
    from veritext.functions.reading import asks, of_the_record
    from veritext.plans import search

    filler = [(k, f"Rain fell on field number {k} and the farmers went home.") for k in range(60)]
    own = spark.createDataFrame(search._VOICES + filler, "doc_id long, text string")
    got = contrary.find_contrary(own, search._OPPOSED).collect()
    assert [(r.id, r.kind, r.place) for r in got] == [(-1, "negation", 1)]
    assert contrary.find_contrary(own, search._OPPOSED, exclude=spark.createDataFrame([(-1,)], "id long")).count() == 0
    assert asks("The question that arises is whether it lies.") and asks("It falls for our consideration.") and not asks("The rule is that it lies.")
    assert of_the_record("By order dated 12.02.2021 it ended.") and of_the_record("Rs. 500 was paid.") and of_the_record("In the present case it lies.") and not of_the_record("The plaintiff is master of the suit.")


def test_call_log_takes_the_upper_median(spark):
    rows = [("a", 200, k) for k in (5, 1, 9, 7)] + [("b", 500, k) for k in (3, 1, 2)] + [("c", None, None)]
    got = {r.model: (r.calls, r.failed, r.median_prompt) for r in readers.call_log(spark.createDataFrame(rows, "model string, status int, prompt_tokens long")).collect()}
    assert got == {"a": (4, 0, 7), "b": (3, 3, 2), "c": (1, 1, None)}


def test_vectors_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(k, [float(k % 3), float(k)]) for k in range(20)], "vec_id int, embedding array<double>")
    q = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(9)], "query_id int, vector array<double>")
    want = sorted(map(tuple, retrieval.dense(v, q, 3).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, retrieval.dense(v, q, 3).collect())) == want


def test_fragments():
    words = [f"word{chr(97 + k)}" for k in range(26)]
    assert contrary.fragment(" ".join(words[:15])) is None
    assert contrary.fragment(" ".join(words[:20])) == " ".join(words[4:16])
    labels = words[:3] + ["(A2,", "A4,"] * 6 + words[3:15]
    assert contrary.fragment(" ".join(labels)).split().count("A4,") <= 2
    assert contrary.fragment(" ".join(["A1,"] * 30)) is None


def test_years_and_done_cases(spark, tmp_path):
    from veritext.operators import citator

    spark.createDataFrame([(1, 2019), (2, 2021)], "x int, year int").write.partitionBy("year").parquet(str(tmp_path / "m"))
    assert [r.year for r in readers.years(spark, str(tmp_path / "m")).collect()] == [2019, 2021]
    body = spark.createDataFrame([("Z9", 1, "See AIR 1973 SC 1461."), ("Z8", 1, "See AIR 1973 SC 1461.")], "citing string, seq int, body string")
    aliases = spark.createDataFrame([("AIR:SC:1973:1461", "B2")], "normalized string, case string")
    assert {r.citing for r in citator.citation_edges(body, aliases).collect()} == {"Z8", "Z9"}
    assert {r.citing for r in citator.citation_edges(body, aliases, spark.createDataFrame([("Z8",)], "citing string")).collect()} == {"Z9"}

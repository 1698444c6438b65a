"""The query API on a corpus of three cases."""

import datetime

import pytest

from veritext.plans import tools


@pytest.fixture(scope="module")
def corpus(spark):
    day = datetime.date
    p = "case string, version string, seq int, label string, body string"
    return {
        "judgments": spark.createDataFrame([("K1", "Kasturi v. Iyyamperumal", "Delhi High Court", 2, day(2005, 1, 1)), ("B2", "State of Kerala v. Rao", "Supreme Court of India", 5, day(1973, 1, 1)), ("C3", "Union v. Sharma", None, 3, None)], "case string, title string, court string, bench int, decided_on date"),
        "aliases": spark.createDataFrame([("K1", "SCC", "(2005) 6 SCC 733", "SCC:2005:6:733"), ("B2", "AIR", "AIR 1973 SC 1461", "AIR:SC:1973:1461")], "case string, reporter string, citation string, normalized string"),
        "paragraphs": spark.createDataFrame([
            ("K1", "v", 1, "1", "We hold that a tenancy notice served on the tenant is mandatory before any suit for eviction."), ("K1", "v", 2, "2", "Costs follow."),
            ("B2", "v", 1, "1", "In our view the tenancy notice served on the tenant is not mandatory for a suit of eviction."), ("C3", "v", 1, "1", "Rain fell."),
        ], p),
        "edges": spark.createDataFrame([(1, "C3", "B2", "overruled", day(2020, 1, 1))], "edge_id int, citing string, cited string, treatment string, citing_date date"),
    }


SAID = "A tenancy notice served on the tenant is mandatory in a suit of eviction"


def test_status_and_treatment(corpus):
    assert {r.court: r.judgments for r in tools.corpus_status(corpus).collect()} == {"Delhi High Court": 1, "Supreme Court of India": 1, "unrecorded": 1}
    assert tools.check_treatment(corpus, "B2").first().status == "overruled"
    assert tools.check_treatment(corpus, "K1").first().is_unchecked


def test_resolution(corpus):
    rows = tools.resolve_citation(corpus, "State of Kerala v. Rao, (1973) 9 SCC 9; Quite Another Person v. Somebody Else, (2005) 6 SCC 733; (1950) 1 SCC 1").orderBy("citation_id").collect()
    assert [(r.status, r.method, r.case, r.mismatch) for r in rows] == [("found", "party_name", "B2", False), ("found", "exact", "K1", True), ("not_found", None, None, False)]


def test_location(corpus):
    rows = tools.locate_paragraph(corpus, "K1", SAID, "2").collect()
    assert [(r.label, r.claimed) for r in rows] == [("1", False), ("2", True)]


def test_search(corpus):
    assert [(r.case, r.is_doubtful) for r in tools.find_authority(corpus, SAID).collect()] == [("K1", False), ("B2", True)]
    assert [(r.case, r.kind) for r in tools.find_contrary_authority(corpus, SAID).collect()] == [("B2", "negation")]


def test_binding(corpus, spark):
    assert tuple(tools.bind_proposition(corpus, SAID).first()) == ("K1", "unchecked")
    read = spark.createDataFrame([("K1", "full", None)], "case string, support string, narrowed string")
    assert tuple(tools.bind_proposition(corpus, SAID, read).first()) == ("K1", "bound")


def test_versions_and_keys(corpus, spark):
    p = "case string, version string, seq int, label string, body string, preferred boolean"
    two = corpus | {"paragraphs": spark.createDataFrame([("K/1", "a", 1, "1", "The tenancy notice was served.", False), ("K/1", "b", 1, "1", "The appeal is dismissed with costs.", True), ("K/1", "b", 2, "2", "A tenancy notice served on the tenant is not mandatory in a suit of eviction.", True)], p)}
    (row,) = tools.locate_paragraph(two, "K/1", "the appeal is dismissed with costs").collect()
    assert (row.version, row.seq) == ("b", 1)
    assert [(r.case, r.version, r.seq) for r in tools.find_contrary_authority(two, SAID).collect()] == [("K/1", "b", 2)]
    assert tools.find_contrary_authority(two, SAID, exclude=spark.createDataFrame([("K/1",)], "case string")).count() == 0


def test_words_that_are_not_the_courts_do_not_bind(corpus, spark):
    p = "case string, version string, seq int, label string, body string"
    said = corpus | {
        "paragraphs": spark.createDataFrame([("K1", "v", 1, "1", "Learned counsel for the tenant submitted that a tenancy notice served on the tenant is mandatory in a suit of eviction."), ("B2", "w", 3, "3", "A tenancy notice served on the tenant is mandatory in a suit of eviction.")], p),
        "opinions": spark.createDataFrame([("w", "dissenting", 2, 5)], "version string, kind string, seq_start int, seq_end int"),
    }
    assert tools.find_authority(said, SAID).count() == 0 and tools.bind_proposition(said, SAID).count() == 0
    best = tools.find_authority(corpus, SAID).first()
    assert best.line == "We hold that a tenancy notice served on the tenant is mandatory before any suit for eviction." and best.voice == "court_majority"


def test_verification(corpus):
    rows = tools.verify_brief(corpus, "The Supreme Court has held so in Kasturi v. Iyyamperumal, (2005) 6 SCC 733. See AIR 1973 SC 1461. And (1950) 1 SCC 1.").orderBy("citation_id").collect()
    assert [(r.grade, r.modes) for r in rows] == [("D", "3"), ("D", "10"), ("F", "1")]

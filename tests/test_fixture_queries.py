"""Queries over literal rows, against results written out by hand."""

import pytest

from veritext.plans import catalogue

RESULTS = {
    "metadata_projection": ('canonical_key title judges bench_strength decided_on court', [
        ('INSC:2019:770', 'A', 'Xavier|Y Rao', 2, '2019-02-01', 'Supreme Court of India'),
        ('SCP:2020:p2', 'P vs Q', 'Zed', 1, '2020-03-04', 'Unknown'),
        ('SCP:2021:p3', 'M versus N', '', 0, '2021-06-05', 'Delhi High Court'),
    ]),
    "out_of_sequence": ('version seq resumes', [
        ('v1', 3, True),
        ('v1', 4, True),
        ('v1', 6, True),
    ]),
    "verdict_rubric": ('citation_id grade modes needs_review support', [
        (1, 'F', '1', True, 'not_assessed'),
        (2, 'C', '', True, 'not_assessed'),
        (3, 'A', '', False, 'not_assessed'),
        (4, 'C', '2', False, 'full'),
        (5, 'E', '2,3,5,10', True, 'not_assessed'),
        (6, 'F', '12,9,6,11,7,12', True, 'partial'),
        (7, 'F', '10,8', False, 'partial'),
        (8, 'F', '5,4', False, 'contradicted'),
        (9, 'E', '5,12', False, 'full'),
    ]),
    "grade_board": ('grade n d_or_worse in_review', [
        ('F', 4, 6, 4),
        ('C', 2, 6, 4),
        ('A', 1, 6, 4),
        ('E', 2, 6, 4),
    ]),
    "brief_markers": ('citation_id marker', [
        (1, '[!F 1]'),
        (2, '[?C]'),
        (3, '[ok]'),
        (4, '[!C 2]'),
        (5, '[!E 2,3,5,10]'),
        (6, '[!F 12,9,6,11,7]'),
        (7, '[!F 10,8]'),
        (8, '[!F 5,4]'),
        (9, '[!E 5,12]'),
    ]),
    "hierarchy_check": ('id status', [
        (1, 'not_assessed'),
        (2, 'wrong_court'),
        (3, 'not_assessed'),
        (4, 'overstated_bench'),
        (5, 'not_assessed'),
        (6, 'not_assessed'),
    ]),
    "citation_extract": ('id reporter raw start end normalized year pinpoint_kind pinpoint parties', [
        (1, 'SCC', '(2005) 6 SCC 733', 40, 56, 'SCC:2005:6:733', 2005, 'para', '8.2', 'Kasturi v. Iyyamperumal'),
        (1, 'AIR', 'AIR 2019 SUPREME COURT 1234', 72, 99, 'AIR:SC:2019:1234', 2019, None, None, None),
        (2, 'NC', '2023:DHC:2073-DB', 55, 71, 'NC:DHC:2023:2073-DB', 2023, None, None, None),
        (4, 'SCCONLINE', '2026 SCC OnLine SC 1258', 39, 62, 'SCCONLINE:SC:2026:1258', 2026, None, None, None),
    ]),
    "treatment_classify": ('id normalized treatment', [
        (1, 'SCC:2005:6:733', 'relied_on'),
        (1, 'AIR:SC:2019:1234', 'relied_on'),
        (2, 'NC:DHC:2023:2073-DB', 'referred'),
        (4, 'SCCONLINE:SC:2026:1258', 'overruled'),
    ]),
    "polarity_opposes": ('id kind cue', [
        (1, 'antonym', 'directory'),
        (2, 'negation', 'not'),
        (3, None, None),
    ]),
    "truncation_scan": ('claim_id label kept dropped qualifier', [
        (1, '1', 'a tenancy ends only where notice is given in writing to the tenant by the', 'landlord, unless the tenant waives it by conduct known to both parties.', 'unless'),
    ]),
    "separate_opinions": ('version kind seq_start seq_end', [
        ('v1', 'majority', 1, 9),
        ('v1', 'dissenting', 10, 11),
    ]),
    "strip_signoffs": ('version seq body', [
        ('v1', 1, 'Reasons.'),
        ('v1', 2, 'The appeal is allowed.'),
    ]),
    "planted_errors": ('id mode claim citation', [
        (1, 0, 'A tenancy ends only where notice is given in writing to the tenant by the landlord, unless the tenant waives it by conduct known to both parties: (2019) 4 SCC 1.', '(2019) 4 SCC 1'),
        (1, 1, 'A tenancy ends only where notice is given in writing to the tenant by the landlord, unless the tenant waives it by conduct known to both parties: (2019) 4 SCC 8.', '(2019) 4 SCC 8'),
        (1, 2, 'A tenancy ends only where notice is given in writing to the tenant by the landlord, unless the tenant waives it by conduct known to both parties: AIR 1973 SC 1461.', 'AIR 1973 SC 1461'),
        (1, 9, 'A tenancy ends only where notice is given in writing to the tenant by the landlord: (2019) 4 SCC 1.', '(2019) 4 SCC 1'),
        (1, 12, 'A tenancy ends only where notice is given in writing to the tenant by the landlord, unless the tenant waives it by conduct known to both parties: (2019) 4 SCC 1, para 999.', '(2019) 4 SCC 1'),
    ]),
    "negate_sentences": ('id denied', [
        (1, 'The notice is not mandatory.'),
        (2, 'It can be waived.'),
        (3, None),
    ]),
    "plan_parse": ('issue title place proposition', [
        (1, 'Whether notice was good', 1, 'The notice was not served on the tenant at all'),
        (1, 'Whether notice was good', 2, 'A notice must be in writing to be good'),
    ]),
    "verify_brief": ('citation_id raw grade modes needs_review support', [
        (1, '(2005) 6 SCC 733', 'D', '3', False, 'not_assessed'),
        (2, 'AIR 1973 SC 1461', 'D', '10', False, 'not_assessed'),
        (3, '(1999) 1 SCC 1', 'F', '1', True, 'not_assessed'),
    ]),
    "court_prefixes": ('prefix court seat', [
        ('DHC', 'Delhi High Court', None),
        ('KHC-D', 'Karnataka High Court', 'Dharwad'),
        ('XYZ', None, None),
    ]),
    "self_attack": ('point kind against place', [
        (1, 'unsupported', None, 1),
        (2, 'distinguished', 'C3', 1),
        (2, 'contrary', 'C3', 2),
        (2, 'outranked', 'B2', 3),
        (3, 'narrowed', 'B2', 1),
    ]),
    "supra_resolve": ('citing seq name cited', [
        ('d1', 3, 'Kasturi', 'A1'),
    ]),
    "edges_from_text": ('citing cited treatment seq', [
        ('Z9', 'A1', 'followed', 1),
        ('Z9', 'B2', 'overruled', 2),
        ('Z9', 'B2', 'referred', 3),
    ]),
}


@pytest.mark.parametrize("name", sorted(RESULTS))
def test_fixture(spark, name):
    columns, want = RESULTS[name]
    got = [tuple(r) for r in catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").select(*columns.split()).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)

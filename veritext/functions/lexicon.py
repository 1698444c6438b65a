"""Fixed values of the analytics: word lists, cue phrases, thresholds and scales.

A phrase is a regular expression in which a single space stands for one or more
white-space characters; `cue` turns a list of phrases into one pattern that
Python and the JVM read alike.
"""

from __future__ import annotations

# Words without weight in retrieval.
STOPWORDS = tuple(
    """
    a an the and or but if of in on at to for with without by from as is are was were be been being
    that this these those it its it's he she they them his her their we us our you your i
    not no nor so than then there here which who whom whose what when where why how
    have has had do does did shall will would should could may might must can
    said such other same any all each both few more most some only own very
    """.split()
)

# Words too common in judgments to show what a sentence is about.
COMMONPLACE = tuple(
    """
    court courts judgment judgments judgement case cases law laws legal held hold holding
    learned counsel submitted submission submissions contention contended appeal appeals appellant
    appellants respondent respondents petitioner petitioners hon ble supreme india indian
    view matter matters question questions issue issues fact facts present instant
    para paragraph paragraphs decision decisions bench judge judges justice
    before after under over upon into within during against between among through above below
    where when whether while since because therefore thus hence merely even still already further
    cannot never nor neither nothing unable without
    """.split()
)

# Ranking.
K1, B, RRF_K = 1.5, 0.75, 60
FTS_K1, FTS_B, FTS_FLOOR = 1.2, 0.75, 1e-6
CANDIDATES, NEAR_TERMS, NEAR_WINDOW, NEAR_QUERIES, NEAR_LIMIT = 120, 5, 12, 6, 40
FUSION_SCALE, BENCH_WEIGHT, RECENCY_WEIGHT, FIRST_YEAR = 1000.0, 0.06, 0.02, 1950
MAX_IDF, MIN_WEIGHT_SHARE, MIN_TERMS, MIN_TERM_SHARE, MIN_SUBSTANCE = 8.0, 0.45, 4, 0.3, 2

# Quotation.
QUOTE_WORDS, DISTINCTIVE_WORDS, OCR_SCORE = 6, 10, 97.0
KEPT_WORDS, DROPPED_WORDS = 8, 4

# Matching of party names.
PARTY_SCORE, PARTY_MARGIN, NAME_FLOOR, NAME_CHARS = 88.0, 4.0, 55.0, 12
LEARN_SCORE, LEARN_MARGIN, SURE_SCORE, SIGHTINGS = 92.0, 6.0, 96.0, 2
SUPRA_SCORE, SUPRA_MARGIN = 82.0, 8.0

# Treatments by what they do to a case, worst first.
SEVERITY = ("overruled", "reversed", "partly_overruled", "referred_to_larger_bench", "doubted")
NEGATIVE = ("overruled", "partly_overruled", "reversed", "doubted", "referred_to_larger_bench")
NEEDS_LARGER_BENCH = ("overruled", "partly_overruled")
RELIANCE = ("relied_on", "followed")
KILLING = ("overruled", "partly_overruled", "reversed")

# Grades and failure modes.
GRADES = ("A", "B", "C", "D", "E", "F")
MODES = {1: "phantom", 2: "mis-cite", 3: "wrong court or bench", 4: "not there", 5: "wrong voice", 6: "minority opinion", 7: "obiter as ratio", 8: "overstatement", 9: "selective quotation", 10: "dead or wounded law", 11: "distinguishable", 12: "wrong pinpoint"}
MODEL_MODES = (4, 7, 8, 11)

# Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = ("v", "vs", "No", "Nos", "Anr", "Ors", "Ltd", "Pvt", "Smt", "Sri", "Shri", "Mr", "Mrs", "Dr", "Hon", "Sec", "Art", "para", "Para")

# Cue phrases of the rhetorical roles, in the order in which roles are tried.
ROLES = {
    "disposition": (
        r"(?:the )?(?:appeals?|(?:writ )?petitions?|applications?) (?:is|are|stands?|shall stand) (?:accordingly |hereby )?(?:allowed|dismissed|disposed)",
        r"(?:the )?appeals? (?:succeeds?|fails?)",
        r"(?:we )?(?:allow|dismiss) the (?:appeals?|petitions?)",
        r"(?:is|are) hereby (?:allowed|dismissed)",
        r"result of the case ?:",
        r"the impugned (?:judgment|order)[^.]{0,60}? (?:is|stands?) (?:accordingly |hereby )?(?:set aside|upheld|affirmed|quashed|restored)",
        r"no interference (?:of this Court )?is called for",
        r"we (?:see no reason to interfere|are in complete agreement)",
        r"the reference is answered",
        r"we accordingly pass the following order",
    ),
    "issues": (
        r"questions? (?:of law )?(?:that arise|arise|arising|for consideration|for determination|involved)",
        r"the (?:following )?(?:substantial )?questions? (?:of law )?(?:arise|are)",
        r"the (?:following )?issues? (?:arise|for|that arise|are framed)",
        r"(?:issues?|points?) (?:framed )?for (?:consideration|determination)",
        r"following questions",
        r"the short question",
        r"the point (?:that )?(?:falls|arises|for)",
        r"what (?:falls|is) for (?:consideration|decision)",
    ),
    "argument_petitioner": (
        r"(?:learned )?(?:counsel|senior counsel|asc?|asg|sg|ag|advocate) (?:for|appearing for|on behalf of) the (?:petitioners?|appellants?|accused|complainant|writ petitioners?|applicants?)",
        r"(?:counsel|mr\.?|ms\.?|learned counsel) for the (?:petitioners?|appellants?)",
        r"it is contended by the (?:petitioners?|appellants?|learned)",
        r"the (?:petitioners?|appellants?)'?s? (?:submission|contention|case) is",
        r"submission of (?:mr\.?|ms\.?|the )?(?:learned )?(?:counsel|asg|sg|asc)[^.]{0,40}(?:for|appearing for) the (?:petitioners?|appellants?|accused)",
        r"(?:the )?(?:petitioners?|appellants?) (?:submit|contend|argue)",
    ),
    "argument_respondent": (
        r"(?:learned )?(?:counsel|senior counsel|asc?|asg|sg|ag|advocate) (?:for|appearing for|on behalf of) the (?:respondents?|state|defendant|union of india|uoi|complainant|authorities?|commission|board|bank|corporation)",
        r"(?:counsel|mr\.?|ms\.?|learned counsel) for the (?:respondents?|state|defendant|uoi)",
        r"the (?:respondents?)?'?s? (?:submission|contention|case) is",
        r"(?:the )?respondents? (?:submit|contend|argue|support)",
        r"it is contended by the (?:respondents?|state|learned (?:asg|sg|ag|counsel))",
    ),
    "lower_court": (
        r"(?:the )?(?:high court|trial court|sessions? (?:court|judge)|tribunal|division bench|single judge|learned single judge|labour court|consumer (?:commission|forum)|district (?:court|judge|forum)|motor accidents? tribunal)[^.]{0,80}? (?:held|observed|was of the view|convicted|acquitted|dismissed|allowed|set aside|quashed|remanded|answered|concurred|took the view|upheld|refused)",
        r"the (?:high court|trial court|tribunal) (?:came to (?:hold|conclude)|proceeded)",
        r"(?:conviction|sentence|order|judgment|decree|award) (?:of|by) the (?:high court|trial court|sessions? (?:court|judge)|tribunal|single judge)",
    ),
    "statute": (
        r"(?:reads?|provides?) as (?:under|follows)",
        r"extract of (?:section|article|rule|provision)",
        r"(?:section|article|rule) [0-9ivxlc]+\b[^.]{0,60}? (?:of the \S+ act )?(?:reads|provides|runs) (?:as )?(?:under|follows)",
        r"the (?:relevant )?provisions? of (?:section|article|rule) [0-9ivxlc]+\b[^.]{0,60}? (?:are|is) (?:extracted|reproduced|quoted)",
        r"for convenience.{0,40}(?:extract|reproduc)",
    ),
    "facts": (
        r"(?:brief |short |relevant )?facts (?:of the case|in brief|leading|giving rise)",
        r"the facts (?:are|as follows|relate|disclosed)",
        r"briefly (?:stated|put),? the facts",
        r"the (?:prosecution |complainant'?s )?case, in (?:brief|short|nutshell)",
        r"the prosecution (?:case|story|version)",
        r"shorn of (?:details|unnecessary)",
        r"facts of the (?:case|present case|matter)",
        r"(?:undisputed|admitted|broad) facts (?:are|of)",
        r"to (?:briefly )?narrate the facts",
        r"the case of the (?:complainant|prosecution|petitioner|appellant) in (?:brief|short)",
    ),
    "ratio": (
        r"we are of the (?:clear |considered |firm )?view",
        r"(?:in|as per) our (?:considered )?(?:opinion|view)",
        r"it is (?:well )?settled (?:law|position|that)",
        r"(?:it is |we )?held that",
        r"we hold that",
        r"the proposition (?:that )?(?:emerges|follows|is)",
        r"the law (?:is|can be stated) (?:well )?settled",
        r"we are clearly of the opinion",
        r"our answer to (?:the )?question",
        r"the position, therefore, is",
        r"to sum up",
        r"from the (?:above|aforesaid) (?:discussion|analysis|enunciation)",
    ),
    "analysis": (
        r"having heard (?:the )?learned (?:counsel|counsels?|asc?s?|asg|sg|ag)",
        r"we have (?:carefully )?(?:perused|heard|examined|considered)",
        r"on a (?:careful |anxious |close |duly )?(?:consideration|perusal|reading|analysis|examination)",
        r"(?:after|upon|on) (?:giving )?(?:our |anxious |careful )+(?:consideration|thought)",
        r"a (?:careful |close |plain )?(?:perusal|reading) of",
        r"from a (?:careful |perusal|conjunctive reading)",
        r"(?:this court|we) (?:has |have )?(?:had occasion|examined|considered) (?:the )?(?:question|issue|contention)",
    ),
    "precedent_not_relied": (
        r"distinguish(?:es|ed|ing)", r"does not (?:apply|lay down|support|advance|help|assist)", r"no assistance", r"cannot be pressed into service", r"not applicable", r"has no (?:application|bearing|relevance)",
        r"is of no (?:avail|assistance|help)", r"inapplicable", r"does not appear to be apposite", r"not apposite", r"does not apply to the facts",
    ),
    "precedent_relied": (
        r"relied (?:on|upon)", r"placed (?:reliance|dependence) (?:on|upon)", r"in reliance (?:on|upon)", r"laid down in", r"laid down by (?:this court|the constitution bench)", r"is (?:squarely )?applicable",
        r"squarely covers", r"supports the (?:case|contention|submission)", r"follows from", r"binding (?:on|precedent)", r"it is settled by",
    ),
}
PREAMBLE = (
    r"leave granted", r"special leave (?:to )?appeal", r"petition(?:\(s\))? for special leave", r"civil (?:appeal|writ) no\.?\s*(?:of|s?l\.p)", r"writ petition\s*\(?(?:c|cr)\)?\s*(?:no|of)", r"transfer petition", r"review petition", r"contempt petition", r"under article 32", r"judgment reserved",
)

# Cues of whose words follow, and of the court taking the text back.
_CASE = r"[A-Z][\w.'-]*(?: [\w.'-]+){0,6} vs?\.? [A-Z][\w.'-]*(?: [\w.'-]+){0,6}"
_BENCH = r"(?:this|the|a) (?:(?:two|three|five|seven|nine|eleven|thirteen)[-\s]?Judge )?(?:Constitution Bench|coordinate Bench|larger Bench|Division Bench|Bench|Court)"
VOICES = {
    "counsel_argument": (
        r"\blearned (?:senior )?(?:counsel|advocate|ASG|Additional Solicitor General|Solicitor General|Attorney General|Government Advocate|Amicus Curiae)\b",
        r"\bit (?:was|is) (?:strenuously |vehemently |further )?(?:contended|submitted|urged|argued|canvassed|pleaded)\b",
        r"\bthe (?:appellant|respondent|petitioner|plaintiff|defendant|State)s? (?:has |have |had )?(?:contended|submitted|urged|argued|would contend|contends|submits)\b",
        r"\bon behalf of the (?:appellant|respondent|petitioner|plaintiff|defendant)\b",
        r"\bsubmissions? (?:of|made by) (?:the )?learned\b",
    ),
    "lower_court": (
        r"\bthe (?:High Court|Trial Court|District Judge|Sessions Judge|learned Single Judge|Division Bench|Tribunal|National Commission|Commission|Appellate Authority|first appellate court|courts? below)[^.]{0,45}? (?:held|observed|found|concluded|took the view|was of the view|dismissed|allowed|recorded|reasoned|directed)\b",
        r"\bimpugned (?:judgment|judgement|order) (?:holds|held|records|proceeds)\b",
    ),
    "quoted_precedent": (
        rf"\b(?:in|see) {_CASE}(?:\s*\(supra\))?(?:\s*\[[^\]]{{0,180}}\])?[\s,():;\[\]\d.A-Z-]{{0,40}}?(?:{_BENCH}[^.]{{0,60}}?)?\s*(?:has |had )?(?:observed|held|laid down|stated|ruled|opined|explained)\b",
        r"\bit was (?:held|observed|laid down) in [A-Z]",
        r"\bin paragraph \d{1,3} of the (?:said )?(?:judgment|decision|report)\b",
        r"\bthe following (?:passage|observations?) (?:from|in) ",
    ),
}
RESUMES = (
    r"\b(?:we|this Court) (?:are |is |am )?(?:of the (?:considered )?(?:view|opinion)|unable to (?:accept|agree|persuade)|not (?:in agreement|persuaded)|hold|find|satisfied|agree|disagree|have no hesitation)\b",
    r"\bin our (?:considered )?(?:view|opinion|judgment)\b",
    r"\bhaving (?:heard|considered|examined|bestowed)\b",
    r"\bwe are afraid\b",
    r"\bthe (?:submission|contention|argument)s? (?:is|are|was|were) (?:without merit|misconceived|liable to be rejected|not acceptable|untenable)\b",
    r"\bthis contention (?:cannot|does not|must)\b",
    r"\bwe (?:respectfully )?(?:approve|endorse|reiterate|follow) ",
)
ADOPTS = (r"\bwe (?:respectfully )?(?:agree|approve|endorse|concur|reiterate|follow|adopt)\b", r"\bquoted with approval\b", r"\bapproved in\b", r"\bwe are in respectful agreement\b")
REJECTS = (r"\bwe (?:respectfully )?(?:disagree|dissent|are unable to agree|do not approve)\b", r"\bno longer good law\b", r"\bstands? overruled\b", r"\bwe overrule\b", r"\bis hereby overruled\b")
OPINION_VOICES = {"majority": "court_majority", "concurring": "court_concurring", "dissenting": "court_dissent", "headnote": "headnote"}

# Cues that the court declines to decide.
DECLINES = (
    r"it is (?:not necessary|unnecessary) (?:for us )?to (?:decide|express|go into)",
    r"we (?:need not|do not propose to|refrain from|express no|leave (?:the|this) question open|are not called upon to)",
    r"(?:this )?question (?:is|does not) (?:left open|arise for consideration)",
    r"assuming (?:but )?without deciding",
    r"(?:we may|it may be) (?:only )?(?:observe|add|mention|note) (?:in passing|by way of (?:abundant caution|clarification))",
    r"by the way",
    r"in passing(?! (?:the|a|an|this|that|these|those|any)\b)",
    r"obiter(?: dicta)?",
    r"en passant",
    r"without expressing any (?:final )?opinion",
)

# What a later court does with a case, tried in this order.
TREATMENTS = {
    "overruled": (r"(?:is|are|stands?|hereby) (?:hereby )?overruled", r"we (?:hereby )?overrule", r"(?:is|are) no longer good law", r"(?:does|do) not lay down the correct (?:law|position)", r"(?:is|are) not good law", r"overrule[ds]? the (?:decision|judgment|view)", r"[-–—:]\s*overruled\b"),
    "partly_overruled": (r"partly overruled", r"overruled in part", r"to th(?:at|e) extent[^.]{0,40}overruled", r"[-–—:]\s*partly overruled\b"),
    "referred_to_larger_bench": (r"referred? to a (?:larger|bigger) Bench", r"placed? before (?:the )?(?:Hon(?:'|’)?ble )?(?:the )?Chief Justice", r"requires? (?:re-?consideration|to be reconsidered)", r"refer (?:the )?(?:matter|question|issue) to a larger Bench"),
    "doubted": (r"we (?:respectfully )?(?:doubt|are unable to (?:agree|subscribe))(?! (?:with )?(?:to )?the (?:submission|contention|argument|plea))", r"(?:with respect|respectfully)\s*,?\s*we (?:differ|disagree)", r"we are not in agreement with(?! the view taken by)", r"cannot be said to lay down", r"has been doubted"),
    "reversed": (r"(?:is|was|stands?) reversed", r"we reverse the (?:decision|judgment)"),
    "distinguished": (r"(?:is|are) (?:clearly )?distinguishable", r"(?:has|have) no application to the facts", r"(?:is|are) distinguished", r"turn(?:s|ed)? on (?:its|their) own facts", r"(?:does|do) not (?:apply|assist) (?:to|the)"),
    "affirmed": (r"(?:is|was|stands?) affirmed", r"we affirm the (?:decision|judgment|view)"),
    "followed": (r"(?:we|this Court) (?:respectfully )?(?:follow|are bound by)", r"(?:is|are) (?:squarely )?(?:covered|governed) by", r"following the (?:decision|judgment|ratio)", r"(?:in line|accord) with the (?:decision|ratio)"),
    "relied_on": (r"(?:relied|reliance) (?:(?:was|is|has been) )?(?:placed )?(?:up)?on", r"(?:we may )?(?:usefully )?refer to the (?:decision|judgment)", r"(?:as )?(?:held|observed) by this Court in"),
}
CUE_WINDOW, AFTER_WINDOW, BEFORE_WINDOW = 160, 40, 120

# Words that attach a condition to a rule.
QUALIFIERS = (
    r"only (?:where|when|if|in|upon|after|to the extent)", r"unless", r"provided that", r"subject to", r"except (?:where|when|in)", r"so long as", r"as long as", r"in the facts (?:and circumstances )?of",
    r"having regard to", r"save (?:where|in)", r"but only", r"and not otherwise", r"if and only if", r"on condition that", r"in cases where",
)

# Polarity of clauses.
NEGATORS = (r"not", r"never", r"cannot", r"can not", r"none", r"nor", r"neither", r"no(?!\s*\.?\s*\d)", r"unable to", r"fails? to", r"failed to", r"far from", r"devoid of", r"without")
REJECTIONS = (r"rejected?", r"repelled", r"refuse[ds]?", r"declined?", r"did not accept", r"negatived")
CLAIM_WORDS = (r"contentions?", r"submissions?", r"arguments?", r"pleas?", r"propositions?", r"claims?", r"grounds?", r"views?", r"stand", r"case", r"contended", r"argued", r"urged", r"submitted", r"suggestion", r"request", r"prayer")
SAYING = (
    "held holds hold said says say stated states state observed observes submitted submits contended contends urged argued argues found finds concluded concludes accepted accepts agreed agree means meant shows show "
    "indicates indicate persuaded satisfied clear settled established contention contentions submission submissions argument arguments proposition principle plea ground opinion conclusion finding doctrine view so"
).split()
JOINTS = "but however whereas although though because since unless until while where when if once provided except save before after".split()
ANTONYMS = (
    ("mandatory", "directory"), ("mandatory", "optional"), ("valid", "void"), ("valid", "invalid"), ("legal", "illegal"), ("admissible", "inadmissible"), ("maintainable", "unmaintainable"), ("retrospective", "prospective"),
    ("bailable", "nonbailable"), ("justiciable", "nonjusticiable"), ("arbitrable", "nonarbitrable"), ("permissible", "impermissible"), ("necessary", "unnecessary"), ("sufficient", "insufficient"), ("binding", "persuasive"),
)
PREFIXES, STEM = ("non", "in", "un", "im", "ir", "il", "dis"), 4

# Courts and benches.
HOLDING_VERB = r"(?:has |have |had |was |were )?(?:held|observed|laid down|ruled|settled|decided|declared|opined|reiterated|clarified|stated|concluded|expressed|took (?:a|the) [\w-]+ view|of the view)\b"
COURTS = {"supreme_court": r"\b(?:Supreme Court(?: of India)?|Apex Court)[^.]{0,40}? ", "high_court": r"\b(?:[A-Z][\w&.]+ )?High Court[^.]{0,40}? "}
BENCHES = {"two": 2, "three": 3, "four": 4, "five": 5, "seven": 7, "nine": 9, "eleven": 11, "thirteen": 13}
RECITALS = ("reject", "allow", "dismiss", "set aside", "setting aside", "quash", "remand", "accept", "accede", "concur", "differ", "modify", "uphold")


def cue(phrases, word: bool = False) -> str:
    """One case-blind pattern of phrases; word: whole words only."""
    body = "|".join(p.replace(" ", r"\s+") for p in phrases)
    return rf"(?i)\b(?:{body})\b" if word else f"(?i)(?:{body})"

# Prefixes of High Court neutral citations, their court and seat. Prefixes that are not here still parse.
HIGH_COURTS = """
DHC: Delhi High Court
KHC: Karnataka High Court, Bengaluru
KHC-D: Karnataka High Court, Dharwad
KHC-K: Karnataka High Court, Kalaburagi
MHC: Madras High Court
AHC: Allahabad High Court, Allahabad
AHC-LKO: Allahabad High Court, Lucknow
APHC: Andhra Pradesh High Court
BHC-AS: Bombay High Court, Appellate Side
BHC-OS: Bombay High Court, Original Side
BHC-NAG: Bombay High Court, Nagpur
BHC-AUG: Bombay High Court, Aurangabad
BHC-GOA: Bombay High Court, Goa
CGHC: Chhattisgarh High Court
CHC: Calcutta High Court
GAHC: Gauhati High Court
GUJHC: Gujarat High Court
HHC: Himachal Pradesh High Court
JHHC: Jharkhand High Court
JKLHC: High Court of Jammu and Kashmir and Ladakh
KER: Kerala High Court
MPHC-JBP: Madhya Pradesh High Court, Jabalpur
MPHC-IND: Madhya Pradesh High Court, Indore
MPHC-GWL: Madhya Pradesh High Court, Gwalior
MEGHC: Meghalaya High Court
MNHC: Manipur High Court
OHC: Orissa High Court
PHHC: Punjab and Haryana High Court
PHC: Patna High Court
RJ-JD: Rajasthan High Court, Jodhpur
RJ-JP: Rajasthan High Court, Jaipur
SHC: Sikkim High Court
TSHC: Telangana High Court
TRHC: Tripura High Court
UHC: Uttarakhand High Court
"""

# Kinds of attack on a draft, gravest first, and the share of cited cases from which silence tells something.
ATTACKS = ("unsupported", "distinguished", "contrary", "outranked", "narrowed", "thin")
MIN_CITED_SHARE = 0.5

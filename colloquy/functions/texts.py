"""Text functions as Column builders; none is a Python UDF.

Java and RE2 classes are kept to ASCII, so that both engines see the same matches.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names, words and patterns that the results depend on.
BAD_DISEASE_NAMES = (
    "patient", "patients", "male", "female", "adult", "child", "children",
    "infant", "pregnancy", "infection", "pain", "fever", "cough",
    "rash", "fatigue", "nausea", "vomiting", "diarrhea", "headache",
)
GROUP_STOPWORDS = (
    "acute", "chronic", "severe", "mild", "moderate", "primary",
    "secondary", "familial", "congenital", "acquired", "idiopathic",
    "type", "types", "stage", "grade", "syndrome", "disease",
    "disorder", "deficiency", "i", "ii", "iii", "iv", "v",
)
# Label -> patterns; the first label with a match wins.
SYMPTOM_TYPES: dict[str, tuple[str, ...]] = {
    "outcome": (
        r"\bdeath\b", r"\bmortality\b", r"\bsurvival\b", r"\blethal\b", r"\bfatal\b", r"\bmorbidity\b", r"\bprognosis\b",
        r"\bcomplication\b", r"\bcomplications\b", r"\bsequelae\b", r"\blegal blindness\b", r"\bprogression\b", r"\birreversible\b",
        r"\badverse outcome\b", r"\borgan failure\b", r"\bremission\b", r"\bprolonged course\b",
        r"\bmetastasis\b", r"\bmetastases\b", r"\bmetastatic\b", r"\brelapse\b", r"\bspread\b",
    ),
    "epidemiology": (r"\bincidence\b", r"\bprevalence\b", r"\bepidemi", r"\bcohort\b", r"\bpopulation\b", r"\brisk factor\b", r"\bmean age\b"),
    "treatment": (
        r"\btreatment\b", r"\btherapy\b", r"\btherapies\b", r"\bmanagement\b", r"\bsurgery\b", r"\bsurgical\b", r"\boperation\b",
        r"\bmedication\b", r"\bdrug\b", r"\bresponse to\b",
    ),
    "lab_imaging_test": (
        r"\bimaging\b", r"\bradiograph", r"\bx ray\b", r"\bx-ray\b", r"\bct\b", r"\bmri\b", r"\bultrasound\b", r"\bbiopsy\b",
        r"\bassay\b", r"\btest\b", r"\bresult\b", r"\blevel\b", r"\bcount\b", r"\bconcentration\b", r"\bserum\b", r"\bplasma\b",
        r"\burine\b", r"\bantibody\b", r"\bantibodies\b", r"\bbcva\b", r"\bvisual acuity score\b", r"\bt2wi\b", r"\bt1wi\b",
        r"\bhyperintense\b", r"\bhypointense\b", r"\bsignal\b", r"\breferable\b", r"\belectroretinogram\b", r"\bflicker response\b",
        r"\bresponse\b", r"\bultrasonography\b", r"\bultrasound\b", r"\bdetection\b", r"\belevated\b", r"\bpth\b",
    ),
    "molecular_pathology": (
        r"\bmutation\b", r"\bgene\b", r"\bgenetic\b", r"\bchromosom", r"\bprotein\b", r"\bcell\b", r"\bcellular\b", r"\bapoptosis\b",
        r"\bactivation\b", r"\bexpression\b", r"\bpathway\b", r"\bmyeloid\b", r"\bkeratinocyte\b", r"\batrophy\b", r"\bdeposit\b",
        r"\bdeposits\b", r"\bscarring\b", r"\bneovascularization\b", r"\btubulation\b", r"\bepithelium\b", r"\bchoriocapillaris\b",
        r"\bchorioretinal\b", r"\bretinal pigment\b", r"\bretinal\b.*\batrophy\b", r"\bdystrophy\b", r"\bcortical\b", r"\blayer\b",
        r"\bmucosa\b", r"\bfibrotic changes\b", r"\bbiologically active substances\b", r"\bmalignancy\b", r"\bmalignant\b",
        r"\btumors\b", r"\btumours\b", r"\bbrain tumors\b", r"\bsubtypes\b", r"\bbronchus\b", r"\blobe\b", r"\bpatholog",
        r"\bpathophysiology\b", r"\bproteinopathy\b", r"\btdp\b", r"\baggregation\b", r"\baggregations\b", r"\bimmunoglobulin\b",
        r"\bo-methyltransferase\b", r"\bactivity\b", r"\btissue\b", r"\bcells\b", r"\bglomeruli\b", r"\bcorpuscles\b", r"\btufts\b",
        r"\bfoot-process\b", r"\beffacement\b",
    ),
    "administrative_research": (
        r"\bstudy\b", r"\bstudies\b", r"\breport\b", r"\breports\b", r"\binitial report\b", r"\bcriteria\b", r"\bdiagnosis\b",
        r"\bdisease\b", r"\bpresentation\b", r"\bfinding\b", r"\bfindings\b", r"\bsymptom onset\b", r"\bonset\b",
        r"\bsigns and symptoms\b", r"\bmanifestation\b", r"\bclinical progression\b", r"\brecurrence\b", r"\btumou?r\b",
        r"\bmass appearance\b", r"\bage-related changes\b", r"\bclinical manifestations\b", r"\bmanifestations\b", r"\bdisorders\b",
        r"\bclinical features\b", r"\btypical clinical features\b", r"\bspecial face\b",
    ),
    "demographic_state": (r"\bpregnancy\b", r"\bpediatric\b", r"\bneonatal\b", r"\bmale\b", r"\bfemale\b"),
}
# Patterns of what is no symptom.
BAD_SYMPTOMS_V1 = (
    r"\b\d+[\.\-]year\b", r"\bsurvival\b", r"\bmortality\b", r"\bincidence\b", r"\bprevalence\b", r"\bprognosis\b", r"\bepidemi",
    r"^symptom\b", r"\bpresentation\b", r"\bdiagnosis\b", r"\bmanagement\b", r"\btreatment\b", r"\btherapy\b", r"\bhistory\b",
    r"\bstudy\b|\bstudies\b", r"\bimaging\b", r"\bradiograph", r"\bfinding[s]?\b", r"\bresult[s]?\b", r"\bbiopsy\b", r"\bcriteria\b",
    r"\bpatholog", r"^\d+[%\.]", r"^[\(\[]",
)
# Patterns of hedges and of several diagnoses.
UNCERTAIN = (r"\bpossible\b", r"\bprobable\b", r"\bsuspected\b", r"\blikely\b", r"\bdifferential\b", r"\brule\s*out\b", r"\bversus\b", r"\bvs\b", r"\be\.g\.", r"\bsuch\s+as\b")
SEVERAL = (r"\band\s*/\s*or\b", r"\band\s+or\b", r"\bor\b", r"\bwith\s+possible\b", r"\bcomplicated\s+by\b", r"\bsecondary\s+to\b", r"\bdue\s+to\b", r"\bcaused\s+by\b", r"[,;/]")
#: intent -> keywords, in order of priority.
INTENTS: dict[str, tuple[str, ...]] = {
    "diagnosis": (
        "most likely diagnosis", "likely diagnosis", "most likely cause", "which diagnosis", "the diagnosis", "what is the diagnosis",
        "most likely responsible", "most probable diagnosis", "best diagnosis", "likely cause of", "most likely finding", "condition is",
        "condition best described", "condition described", "her condition", "his condition", "the condition", "diagnosis is",
        "most likely suffered", "most likely have", "suffering from",
    ),
    "treatment": (
        "treatment", "management", "therapy", "treat", "drug of choice", "next step", "best initial", "first line", "best course",
        "most appropriate management", "most appropriate treatment", "best treatment", "should be treated", "should receive", "given to",
        "administered", "prophylaxis", "intervention",
    ),
    "mechanism": (
        "mechanism", "pathophysiology", "mode of action", "mechanism of action", "most likely due to", "most likely responsible for",
        "most likely result of", "caused by", "reason for", "why does", "explain",
    ),
    "pharmacology": (
        "which drug", "which medication", "which antibiotic", "pharmacology", "blocks", "inhibit", "receptor", "side effect of",
        "adverse effect", "drug used", "used in treatment",
    ),
    "procedure": (
        "procedure", "investigation", "imaging", "lab test", "biopsy", "next test", "investigation of choice", "test of choice",
        "gold standard", "diagnostic test",
    ),
    "ethics": ("ethical", "consent", "legal", "disclose", "report", "obligation"),
    "prognosis": ("prognosis", "complication", "sequelae", "outcome", "expected finding"),
}

# The cascade that keeps diagnostic questions.
DIAGNOSTIC_QUESTIONS = (
    "most likely diagnosis", "what is the diagnosis", "most likely cause", "what is the cause", "most likely etiology",
    "most likely underlying", "most likely responsible", "most likely condition", "most likely disorder", "most likely disease",
    "most likely syndrome", "what type of", "which condition", "which disease", "which disorder", "which syndrome", "which diagnosis",
    "which of the following is the cause", "which of the following is the diagnosis", "which of the following best describes",
    "consistent with", "most likely explanation",
)
NO_DISEASE_STARTS = (
    "administer", "give", "start", "begin", "prescribe", "order", "perform", "obtain", "schedule", "refer", "discontinue", "stop",
    "reassure", "counsel", "observe", "monitor", "measure", "check", "tell", "report", "inform", "notify", "disclose",
    "inhibition", "activation", "stimulation", "generation", "cross-linking", "hyperstabilization",
    "surgical", "incision", "biopsy", "aspiration",
)
NO_DISEASE = (
    r"^[0-9]", r"\b(mg|mcg|ml|mmol|ng|iu)\b", r"\bagar\b|\bculture\b|\bstain\b|\bpcr\b", r"\bsurgery\b|\boperation\b|\brepair\b",
    r"\btherapy\b|\btreatment\b|\bmanagement\b", r"\btest\b|\bexam\b|\bstudy\b|\bimaging\b", r"\binhibitor\b|\bagonist\b|\bantagonist\b",
    r"\bplasmid\b|\bvector\b|\bprimer\b",
)
SYMPTOM_MARKERS = (
    r"\b(has|have|presents?|complains?|reports?|shows?|exhibits?|develops?)\b",
    r"\b(pain|fever|nausea|vomit|cough|dyspn|fatigue|weakness|swelling)\b",
    r"\b(weight loss|appetite|discharge|bleeding|rash|redness|edema)\b",
    r"\b(history of|diagnosed|positive|negative|elevated|decreased|low|high)\b",
    r"\b(temperature|blood pressure|pulse|heart rate|oxygen)\b",
    r"\b(laboratory|labs?|serum|level|count|result)\b",
)


#: Whatever is not a-z, 0-9, space, - or ', as ranges of code points: Java looks for these about ten times as fast as for the class negated.
OTHER = r"[\x00-\x1f!-&(-,./:-`{-\x{10ffff}]"


def normalized(x: Column) -> Column:
    """Lower case, other than a-z, 0-9, space, - and ' to spaces, trimmed; inner spaces stay."""
    return F.trim(F.regexp_replace(F.lower(x), OTHER, " "))


def collapsed(x: Column) -> Column:
    """:func:`normalized` with runs of spaces as one. The two are not interchangeable."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), OTHER, " "), r"\s+", " "))


def words(x: Column) -> Column:
    """Tokens between spaces, none empty."""
    return F.array_remove(F.split(x, r"\s+"), "")


def group_key(disease: Column) -> Column:
    """The first three telling words of a disease's name."""
    toks = words(collapsed(F.regexp_replace(disease, r"\([^)]*\)", " ")))
    kept = F.filter(toks, lambda t: ~t.isin(*GROUP_STOPWORDS) & ~t.rlike("^[0-9]+$"))
    return F.array_join(F.slice(F.when(F.size(kept) > 0, kept).otherwise(toks), 1, 3), " ")


def any_of(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _at_words(patterns: tuple[str, ...]) -> str:
    """:func:`any_of` with the word boundary that all begin with, and the first letters, tried once a place, not once a pattern."""
    rest = [p.removeprefix(r"\b") for p in patterns]
    if any(len(r) == len(p) or not r[0].isalnum() or r[1] in "?*{|" for p, r in zip(patterns, rest, strict=True)):
        return any_of(patterns)
    by_letter = {c: "|".join(f"(?:{r[1:]})" for r in rest if r[0] == c) for c in sorted({r[0] for r in rest})}
    return r"\b(?:" + "|".join(f"{c}(?:{rs})" for c, rs in by_letter.items()) + ")"


def symptom_type(x: Column) -> Column:
    """The first label of SYMPTOM_TYPES with a match in the collapsed text, which is made once (an array's only element), not once a label."""

    def label(s: Column) -> Column:
        out = None
        for name, patterns in SYMPTOM_TYPES.items():
            hit = s.rlike(_at_words(patterns))
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out.otherwise("patient_reportable")

    return F.transform(F.array(collapsed(x)), label)[0]


def clean_symptom(x: Column) -> Column:
    """3 to 80 characters, at most 8 words, no comma, no lab unit, of the reportable type."""
    s = collapsed(x)
    units = s.rlike(r"[0-9]+\s*(mg|g|dl|mmol|iu|ml|kg|cm|mm|%)\b")
    return F.length(s).between(3, 80) & ~x.contains(",") & (F.size(words(s)) <= 8) & ~units & (symptom_type(x) == "patient_reportable")


def clean_symptom_v1(x: Column) -> Column:
    """3 to 120 characters, none of the older patterns, no lab unit."""
    return F.length(x).between(3, 120) & ~x.rlike("(?i)" + any_of(BAD_SYMPTOMS_V1)) & ~x.rlike(r"(?i)[0-9]+\s*(mg|g|dl|mmol|iu|ml|kg|cm|mm)\b")


def clean_disease(x: Column) -> Column:
    d = collapsed(x)
    return (F.length(d) >= 4) & ~d.isin(*BAD_DISEASE_NAMES) & (F.size(words(d)) <= 8) & ~d.rlike(r"\b(patient|patients|male|female|adult|child|children)\b")


def intent(question: Column) -> Column:
    q = F.lower(question)
    out = None
    for label, keys in INTENTS.items():
        hit = q.rlike("|".join(keys))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("other")


def cascade_failure(question: Column, answer: Column, facts: Column) -> Column:
    """The first stage that a case fails, or null: a diagnostic question, an answer that looks like a disease, a fact (of an array) with a symptom."""
    a = F.lower(F.trim(answer))
    named = (a != "") & ~a.rlike("^(" + "|".join(NO_DISEASE_STARTS) + ")") & ~a.rlike(any_of(NO_DISEASE))
    shown = F.exists(facts, lambda f: F.lower(f).rlike(any_of(SYMPTOM_MARKERS)))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return F.when(no(F.lower(question).rlike("|".join(DIAGNOSTIC_QUESTIONS))), "fail_diag_keyword").when(no(named), "fail_answer_type").when(no(shown), "fail_no_symptoms")


def single_diagnosis(x: Column) -> Column:
    """One name, at most with one abbreviation in parentheses: no hedge, no list, at most 8 words."""
    low, norm = F.lower(F.trim(x)), normalized(x)
    inside = F.regexp_extract_all(low, F.lit(r"\(([^)]*)\)"), F.lit(1))
    without = F.trim(F.regexp_replace(low, r"\([^)]*\)", ""))
    return (norm != "") & ~low.rlike(any_of(UNCERTAIN + SEVERAL)) & ((F.size(inside) == 0) | ((F.size(inside) == 1) & (without != ""))) & (F.size(words(norm)) <= 8)


def diagnosis_match(predicted: Column, truth: Column) -> Column:
    """A single diagnosis that equals the truth, holds it or is held by it."""
    p, t = normalized(predicted), normalized(truth)
    return ((p == t) | p.contains(t) | t.contains(p)) & single_diagnosis(predicted)


def atomic_fact(x: Column) -> Column:
    """Without bullet or number, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"^(?:[-*]|[0-9]+[.)])\s*", ""), r"\s+", " "))


def stable_uid(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("||", *parts)), 1, 16)


def fact_ids(facts: Column) -> Column:
    """F000, F001, ... wider past F999."""
    return F.transform(facts, lambda x, i: F.struct(F.concat(F.lit("F"), F.when(i < 1000, F.lpad(i.cast("string"), 3, "0")).otherwise(i.cast("string"))).alias("fact_id"), x.alias("text")))


def without_think(x: Column) -> Column:
    return F.regexp_replace(x, r"(?is)<think>.*?</think>", "")


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, as the row of a generator: the optimizer doesn't move their expressions into a lambda, which would evaluate them once an element."""
    return df.select(*df.columns, F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def ngrams(w: Column, sizes: Iterable[int] = (1, 2, 3, 4)) -> Column:
    """Word n-grams of an array of words, repeats included. The array must be a column (see :func:`held`), not an expression."""

    def of(n: int) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, F.lit(n)), " ")))

    none = F.array().cast("array<string>")
    return F.concat(none, *(F.coalesce(of(n), none) for n in sizes))

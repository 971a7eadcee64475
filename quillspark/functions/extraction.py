"""Extraction of designs, sizes, effects and claims from text by deterministic expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .doi import none_if_empty
from .scores import any_of, how_many
from .text import CLAIM_STOP_WORDS, collapse, sentences, words

#: Patterns of effect sizes, p values, confidence intervals and sample sizes.
EFFECT = r"(?i)\b(?:OR|RR|HR|SMD|MD|IRR|beta|β|Cohen'?s?\s*d|d)\s*(?:=|:)\s*[-+]?\d+(?:\.\d+)?(?:\s*\([^)]*\))?"
P_VALUE = r"(?i)\bp\s*(?:=|<|>|<=|>=)\s*0?\.\d+"
INTERVAL = r"(?i)\b(?:95%\s*CI|CI\s*95%|confidence\s*interval)\b[^.;]*"
SAMPLE_SIZES = [r"(?i)\bn\s*=\s*(\d{2,7})\b", r"(?i)\b(\d{2,7})\s+(?:participants|patients|subjects|adults|children|individuals)\b"]
POPULATION = r"(?i)\b(participants|patients|subjects|adults|children|pregnant|volunteers|individuals)\b"
#: Designs in the order in which they are looked for, in texts and publication types.
DESIGNS = [
    ("review", r"\b(meta-analysis|meta analysis|systematic review|scoping review|literature review|review)\b", r"\b(review|meta-analysis|systematic)\b"),
    ("RCT", r"\b(randomized|randomised|randomly assigned|rct|controlled trial|clinical trial)\b", r"\b(randomized controlled trial|clinical trial)\b"),
    ("cohort", r"\b(cohort|prospective|retrospective|follow-up|longitudinal)\b", None),
    ("cross-sectional", r"\b(cross-sectional|cross sectional|prevalence survey|survey)\b", None),
]
#: Two shapes of a comparison: what is compared, and with what.
COMPARISONS = [
    r"(?i)\b([^.;,]{2,80}?)\s+(?:vs\.?|versus|compared\s+with|compared\s+to|against)\s+([^.;,]{2,80})",
    r"(?i)\brandomi[sz]ed\s+to\s+([^.;,]{2,80}?)\s+(?:or|versus|vs\.?|compared\s+with)\s+([^.;,]{2,80})",
]
#: Two shapes of a measured outcome.
OUTCOMES = [
    r"(?i)(?:improv(?:ed|ement)?\s+in|increase(?:d)?\s+in|decrease(?:d)?\s+in|reduction\s+in|associated\s+with|effect\s+on)\s+([a-z0-9\s-]{3,80})",
    r"(?i)([a-z0-9\s-]{3,80})\s+(?:improved|increased|decreased|reduced|was\s+associated)",
]
#: Markers of result sentences; of claims; of a claim's direction.
RESULT_MARKERS = ["significant", "associated", "increase", "decrease", "improv", "reduc", "odds ratio", "hazard ratio", "risk ratio", "confidence interval", "p=", "p <", "p>", "versus", "vs", "compared"]
EFFECT_TERMS = ["increase", "increased", "decrease", "decreased", "improve", "improved", "reduce", "reduced", "associated", "effect", "significant"]
POSITIVE_TERMS = ["increase", "increased", "improve", "improved", "higher", "benefit", "effective"]
NEGATIVE_TERMS = ["decrease", "decreased", "reduce", "reduced", "lower", "worse", "adverse"]
NULL_TERMS = ["no significant", "non-significant", "no effect", "null effect"]
#: Patterns of a result's direction.
POSITIVE_RESULTS = [
    r"\bimprov(ed|ement|ing)\b", r"\benhanced?\b", r"\bbeneficial\b", r"\bprotective\b", r"\breduced?\s+(symptoms?|risk|pain|anxiety|depression|mortality)\b",
    r"\bsignificant\s+decrease\s+in\b", r"\bsignificant\s+improvement\b", r"\bsignificant\s+reduction\b", r"\bpositive\s+(effect|outcome|impact|association)\b",
    r"\bhigher\s+(efficacy|effectiveness)\b", r"\blower\s+(risk|mortality|incidence)\b",
]
NEGATIVE_RESULTS = [
    r"\bworsen(ed|ing)?\b", r"\bincreased?\s+risk\b", r"\badverse\b", r"\bharmful\b", r"\bdeclined?\b", r"\bdeteriorate[ds]?\b",
    r"\bnegative\s+(effect|outcome|impact|association)\b", r"\bhigher\s+(risk|mortality|incidence)\b", r"\bexacerbat(ed|ing)\b",
]


def study_design(text: Column, types: Column | None = None) -> Column:
    """The first design that the text or the publication types name, else ``unknown``."""
    low, pub = F.lower(text), F.lower(F.array_join(types, " ")) if types is not None else None
    out = F.when(F.lit(False), "")
    for name, in_text, in_types in DESIGNS:
        hit = low.rlike(in_text)
        if in_types and pub is not None:
            hit = hit | F.coalesce(pub.rlike(in_types), F.lit(False))
        out = out.when(hit, name)
    return out.otherwise("unknown")


def review_type(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("meta-analysis") | low.contains("meta analysis"), "Meta-analysis").when(low.contains("systematic review"), "Systematic review").otherwise("None")


def sample_size(text: Column) -> Column:
    """The first size from 2 to 10,000,000 that a pattern finds, by the patterns' order."""
    found = [none_if_empty(F.regexp_extract(text, p, 1)).cast("int") for p in SAMPLE_SIZES]
    return F.coalesce(*[F.when(n.between(2, 10_000_000), n) for n in found])


def population(text: Column) -> Column:
    """The first sentence that names people, 220 characters at most."""
    return F.substring(F.try_element_at(F.filter(sentences(collapse(text)), lambda s: s.rlike(POPULATION)), F.lit(1)), 1, 220)


def comparison(sentence: Column) -> Column:
    """Struct (intervention, comparator) of the first shape that fits, or null."""
    tries = []
    for p in COMPARISONS:
        a, b = (F.regexp_replace(collapse(F.regexp_extract(sentence, p, i)), r"(?i)^the\s+", "") for i in (1, 2))
        tries.append(F.when((a != "") & (b != ""), F.struct(a.alias("intervention"), b.alias("comparator"))))
    return F.coalesce(*tries)


def effect_size(sentence: Column) -> Column:
    return none_if_empty(collapse(F.regexp_extract(sentence, EFFECT, 0)))


def p_value_or_interval(sentence: Column) -> Column:
    return F.coalesce(none_if_empty(collapse(F.regexp_extract(sentence, P_VALUE, 0))), none_if_empty(collapse(F.regexp_extract(sentence, INTERVAL, 0))))


def outcome_measured(sentence: Column) -> Column:
    """What a shape of an outcome names, 120 characters at most; else the first eight words."""
    tries = []
    for p in OUTCOMES:
        named = F.trim(F.regexp_replace(collapse(F.regexp_extract(sentence, p, 1)), r"(?i)\b(the|a|an)\b", ""))
        tries.append(F.when(F.length(named) >= 3, F.substring(named, 1, 120)))
    rest = none_if_empty(F.array_join(F.slice(words(F.regexp_replace(F.lower(sentence), r"[^a-z0-9\s]", " "), r"\s+", 2), 1, 8), " "))
    return F.coalesce(*tries, rest, F.lit("reported outcome"))


def is_result(sentence: Column) -> Column:
    return any_of(F.lower(sentence), RESULT_MARKERS)


def outcome_confidence(key_result: Column, effect: Column, p_value: Column, intervention: Column, comparator: Column, snippet: Column) -> Column:
    """0.2 and a share for each part that is there, at most 1, two decimals."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    parts = [(has(key_result), 0.2), (has(effect), 0.25), (has(p_value), 0.2), (has(intervention), 0.15), (has(comparator), 0.15), (F.length(F.coalesce(snippet, F.lit(""))) >= 20, 0.1)]
    total = F.lit(0.2)
    for there, share in parts:
        total = total + F.when(there, share).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), total), 2)


def is_claim(sentence: Column) -> Column:
    return any_of(F.lower(sentence), EFFECT_TERMS)


def claim_direction(sentence: Column) -> Column:
    """``neutral`` where no effect is stated, else by which kind of terms there are more of."""
    low = F.lower(sentence)
    up, down = how_many(low, POSITIVE_TERMS), how_many(low, NEGATIVE_TERMS)
    return F.when(any_of(low, NULL_TERMS), "neutral").when(up > down, "positive").when(down > up, "negative").otherwise("neutral")


def claim_outcome(sentence: Column) -> Column:
    """The first six content words of a claim, or ``outcome``."""
    cleaned = F.regexp_replace(F.lower(sentence), r"[^a-z0-9\s]", " ")
    return F.coalesce(none_if_empty(F.array_join(F.slice(words(cleaned, r"\s+", 2, CLAIM_STOP_WORDS + EFFECT_TERMS), 1, 6), " ")), F.lit("outcome"))


def result_direction(result: Column) -> Column:
    """positive, negative, mixed or neutral by the patterns that a result fits."""
    fits = lambda patterns: F.coalesce(result.rlike("(?i)" + "|".join(patterns)), F.lit(False))
    up, down = fits(POSITIVE_RESULTS), fits(NEGATIVE_RESULTS)
    return F.when(up & down, "mixed").when(up, "positive").when(down, "negative").otherwise("neutral")

"""Scores.  The current year and the time of a run are parameters, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of a Julian year; weights of a record's quality; of a paper's quality.
YEAR_SECONDS = 31557600
RECORD_WEIGHTS = {"completeness": "0.40", "trust": "0.30", "recency": "0.20", "citations": "0.10"}
PAPER_WEIGHTS = {"source_authority": 0.3, "study_design_strength": 0.25, "methods_transparency": 0.2, "citation_impact": 0.15, "recency_fit": 0.1}
#: How far a provider's metadata is trusted; 0.75 for others.
PROVIDER_CONFIDENCE = {"pubmed": 0.98, "openalex": 0.92, "semantic_scholar": 0.9, "crossref": 0.89, "arxiv": 0.84}
#: Words that signal methods, in two lists, and empirical work.
METHOD_SIGNALS = ["method", "methods", "participants", "sample", "dataset", "randomized", "protocol"]
METHODS_PRESENT = ["method", "methods", "participants", "dataset", "protocol", "randomized", "randomised"]
EMPIRICAL_SIGNALS = ["study", "trial", "cohort", "experiment", "participants", "dataset", "evaluation"]


def filled(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) != ""


def any_of(text: Column, terms: list[str]) -> Column:
    """Whether a text contains one of the terms."""
    found = F.lit(False)
    for t in terms:
        found = found | text.contains(t)
    return found


def how_many(text: Column, terms: list[str]) -> Column:
    """How many of the terms a text contains."""
    total = F.lit(0)
    for t in terms:
        total = total + text.contains(t).cast("int")
    return total


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def metadata_completeness(title: Column, authors: Column, year: Column, raw_doi: Column, citations: Column) -> Column:
    """The share of five fields that are filled, as decimal(6,5)."""
    parts = [filled(title), F.coalesce(F.size(authors) > 0, F.lit(False)), year.isNotNull(), filled(raw_doi), F.coalesce(citations, F.lit(0)) > 0]
    total = sum((p.cast("int") for p in parts[1:]), parts[0].cast("int"))
    return (total / 5).cast("decimal(6,5)")


def citation_signal(citations: Column, aux: Column) -> Column:
    """Log of citations relative to 500, plus an auxiliary signal, at most 1, as decimal(6,5)."""
    base = F.log(1.0 + F.greatest(F.coalesce(citations, F.lit(0)), F.lit(0))) / F.log(F.lit(501.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), base) + F.greatest(F.coalesce(aux, F.lit(0.0)), F.lit(0.0))).cast("decimal(6,5)")


def recency(updated: Column, anchor: Column) -> Column:
    """Exponential decay over a year since the update, as decimal(6,5); null gives 0."""
    age = (F.unix_micros(anchor.cast("timestamp")) - F.unix_micros(updated.cast("timestamp"))) / 1_000_000.0
    return F.coalesce(clamp(F.exp(-age / YEAR_SECONDS)), F.lit(0.0)).cast("decimal(6,5)")


def record_quality(completeness: Column, trust: Column, recent: Column, citations: Column) -> Column:
    """Weighted sum of four shares, out of 100, in decimal arithmetic, two decimals."""
    part = lambda c, w: F.lit(w).cast("decimal(3,2)") * F.greatest(F.lit(0).cast("decimal(6,5)"), F.least(F.lit(1).cast("decimal(6,5)"), F.coalesce(c.cast("decimal(6,5)"), F.lit(0).cast("decimal(6,5)"))))
    w = RECORD_WEIGHTS
    total = part(completeness, w["completeness"]) + part(trust, w["trust"]) + part(recent, w["recency"]) + part(citations, w["citations"])
    return F.round(total * 100, 2).cast("decimal(5,2)")


def provider_confidence(source: Column) -> Column:
    pairs = [x for k, v in PROVIDER_CONFIDENCE.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), source), F.lit(0.75))


def design_hint(title: Column, abstract: Column, types: Column, source: Column) -> Column:
    """A design named in a paper's texts; the first that fits."""
    text = F.lower(F.concat_ws(" ", title, abstract, F.array_join(types, " ")))
    has = text.contains
    return (
        F.when(has("meta-analysis"), "meta-analysis")
        .when(has("systematic review"), "systematic review")
        .when(has("randomized") | has("randomised"), "rct")
        .when(has("cohort"), "cohort")
        .when(has("cross-sectional"), "cross-sectional")
        .when(has("review"), "review")
        .when(source == "arxiv", "preprint")
        .otherwise("unknown")
    )


def design_strength(hint: Column, is_preprint: Column) -> Column:
    has = F.lower(F.coalesce(hint, F.lit(""))).contains
    return (
        F.when(has("meta-analysis") | has("systematic"), 0.9)
        .when(has("rct") | has("randomized") | has("randomised"), 0.86)
        .when(has("cohort"), 0.72)
        .when(has("cross"), 0.64)
        .when(has("review"), 0.62)
        .when(is_preprint, 0.45)
        .otherwise(0.55)
    )


def methods_transparency(abstract: Column) -> Column:
    text = F.lower(F.coalesce(abstract, F.lit("")))
    numbers = text.rlike(r"\b\d{2,}\b").cast("int")
    return F.when(text == "", 0.2).otherwise(clamp(how_many(text, METHOD_SIGNALS) / len(METHOD_SIGNALS) * 0.75 + numbers * 0.25))


def has_year(year: Column) -> Column:
    return F.coalesce(year, F.lit(0)) != 0


def citation_impact(citations: Column, year: Column, current_year: int) -> Column:
    n = F.coalesce(citations, F.lit(0))
    age = F.when(has_year(year), F.greatest(F.lit(1), F.lit(current_year) - year + 1)).otherwise(5)
    return F.when(n <= 0, 0.0).otherwise(clamp(F.log1p(n / (age * 10.0)) / F.log1p(F.lit(20.0))))


def recency_fit(year: Column, current_year: int, timeframe: tuple[int, int] | None = None) -> Column:
    score = F.exp(-F.greatest(F.lit(0), F.lit(current_year) - year) / 8.0)
    if timeframe:
        score = score + F.when(year.between(*timeframe), 0.15).otherwise(0.0)
    return F.when(has_year(year), clamp(score)).otherwise(0.35)


def candidate_score(title: Column, abstract: Column, citations: Column, keywords: list[str]) -> Column:
    """Three for each keyword met, up to one for length, up to one for citations."""
    text = F.lower(F.concat_ws(" ", title, abstract))
    size = F.least(F.length(F.coalesce(abstract, F.lit(""))) / 2000.0, F.lit(1.0))
    return 3.0 * how_many(text, keywords) + size + F.least(F.log10(1.0 + F.coalesce(citations, F.lit(0))) / 3.0, F.lit(1.0))


def enrichment_outcome(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "accepted").when(confidence >= 0.75, "deferred").otherwise("rejected")


def backoff_seconds(attempt: Column) -> Column:
    """Doubling from one second, 60 at most; attempts beyond the seventh count as it."""
    return F.least(F.lit(60.0), F.pow(F.lit(2.0), F.least(attempt, F.lit(7)) - 1))

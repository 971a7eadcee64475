"""The report: relevance, filters, pages, context, warnings, themes, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scores import how_many
from .studies import has

#: How many studies of each tier a context aims at, and how many it holds.
STRICT_TARGET, PARTIAL_TARGET, CONTEXT = 10, 5, 15
#: Opening of a theme by design.
THEMES = {
    "randomized controlled trial": "Experimental evidence from randomized trials",
    "cohort study": "Longitudinal cohort evidence",
    "cross-sectional": "Cross-sectional evidence",
    "meta-analysis": "Meta-analytic evidence",
    "case-control": "Case-control evidence",
    "observational": "Observational evidence",
}


def outcome_text() -> Column:
    return F.lower(F.concat_ws(" ", "outcome_measured", F.coalesce("key_result", F.lit(""))))


def relevance(studies: DataFrame, keywords: list[str]) -> DataFrame:
    """Parts and total of each study's relevance to a query's keywords.

    Studies have outcome_measured ('' for none) and key_result, design, review_type, title and
    sample_size.
    """
    none = F.col("outcome_measured") == ""
    met = how_many(outcome_text(), keywords)
    parts = {
        "keyword_match": F.when(none, 0.0).when(met >= 2, 2.0).when(met >= 1, 1.0).otherwise(0.0),
        "design_weight": F.when(F.col("review_type").isin("Meta-analysis", "Systematic review"), 1.0).when(has(F.col("study_design")) & (F.col("study_design") != "unknown"), 0.5).otherwise(0.0),
        "penalty": F.when(none | outcome_text().contains("no outcomes reported"), -2.0).otherwise(0.0),
        "title_match": F.when(how_many(F.lower("title"), keywords) > 0, 0.5).otherwise(0.0),
        "sample_bonus": F.when(F.coalesce("sample_size", F.lit(0)) != 0, 0.5).otherwise(0.0),
    }
    scored = studies.withColumns(parts)
    scored = scored.withColumn("relevance", sum((F.col(c) for c in parts), F.lit(0.0)))
    return scored.withColumn("low_value", (F.col("relevance") < 0) | outcome_text().contains("no outcomes reported"))


def of_design(mode: str) -> Column:
    """Whether a study passes one of the report's design filters."""
    design, kind = F.col("study_design"), F.col("review_type")
    modes = {
        "all": F.lit(True),
        "meta": kind == "Meta-analysis",
        "review": (design == "review") | (kind == "Systematic review"),
        "rct": F.lower(design).contains("rct"),
        "cohort": design == "cohort",
        "cross-sectional": design == "cross-sectional",
        "unknown": design == "unknown",
    }
    return F.coalesce(modes[mode], F.lit(False))


def page(scored: DataFrame, number: int, size: int = 25, text: str | None = None, design: str | None = None) -> DataFrame:
    """One page of the studies worth showing, most relevant first; ``text`` and ``design`` (a mode of
    ``of_design``) filter.

    The first pages are a top-k; no more than page rows reach one task.
    """
    kept = scored.where("not low_value")
    if design:
        kept = kept.where(of_design(design))
    if text:
        kept = kept.where(F.lower(F.concat_ws(" ", "title", "abstract", "outcome_measured", "key_result")).contains(text.lower()))
    top = kept.orderBy(F.desc("relevance"), F.desc("year"), "study_id").limit(number * size)
    place = F.row_number().over(Window.orderBy(F.desc("relevance"), F.desc("year"), "study_id"))
    return top.withColumn("place", place).where(F.col("place") > (number - 1) * size)


def page_numbers(current: int, total: int, size: int = 5) -> list[int]:
    """The page numbers that a pager shows around the current one."""
    first = max(1, min(current - size // 2, total - size + 1))
    return list(range(first, min(total, first + size - 1) + 1))


def context_score(keywords: list[str]) -> Column:
    met = how_many(outcome_text(), keywords)
    base = F.when((met >= 2) & F.lit(len(keywords) >= 2), 2.0).when(met >= 1, 1.0).otherwise(0.0)
    review = F.when(F.col("review_type").isin("Meta-analysis", "Systematic review"), 1.0).otherwise(0.0)
    cited = F.when(F.coalesce("citation_count", F.lit(0)) > 0, F.least(F.lit(3.0), F.log2(F.greatest(F.col("citation_count"), F.lit(1)).cast("double")))).otherwise(0.0)
    return F.round(base + review + cited, 6)


def select_context(strict: DataFrame, partial: DataFrame, keywords: list[str]) -> DataFrame:
    """At most 15 studies for a prompt: 10 strict and 5 partial, backfilled from the tier with more
    left.  Closed form: of S strict and P partial studies the first min(S, max(10, 15 - P)) and
    min(P, max(5, 15 - S)).  A study in both tiers is strict; repeats of an id count once."""
    rest = partial.join(strict.select("study_id"), "study_id", "left_anti")
    tiered = strict.withColumn("tier", F.lit("strict")).unionByName(rest.withColumn("tier", F.lit("partial"))).dropDuplicates(["tier", "study_id"])
    scored = tiered.withColumn("score", context_score(keywords))
    order = Window.partitionBy("tier").orderBy(F.desc("score"), "study_id")
    top = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= CONTEXT)
    # Fifteen of each tier are enough to tell how the two fill up.
    n = {t: F.sum((F.col("tier") == t).cast("int")).over(Window.partitionBy(F.lit(0))) for t in ("strict", "partial")}
    allowed = F.when(F.col("tier") == "strict", F.greatest(F.lit(STRICT_TARGET), CONTEXT - n["partial"])).otherwise(F.greatest(F.lit(PARTIAL_TARGET), CONTEXT - n["strict"]))
    return top.withColumn("allowed", allowed).where(F.col("place") <= F.col("allowed")).drop("allowed")


def warnings(studies: DataFrame) -> DataFrame:
    """Rows (position, type, text) of what a reader should know about the studies as a whole."""
    s = studies.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("preprint_status") == "Preprint").alias("pre"), F.count_if(F.col("study_design") == "RCT").alias("rct"),
        F.count_if(F.col("study_design") == "review").alias("rev"), F.count_distinct("source").alias("sources"), F.min("source").alias("source"),
        F.count_if((F.coalesce("sample_size", F.lit(0)) != 0) & (F.col("sample_size") < 50)).alias("small"),
    )
    text = lambda c: c.cast("string")
    n = F.col("n")
    share = F.floor(F.col("pre") / F.nullif(n, F.lit(0)) * 100 + 0.5)
    items = [
        (F.col("pre") > 0, "quality", F.concat(text(F.col("pre")), F.lit(" of "), text(n), F.lit(" studies ("), text(share), F.lit("%) are preprints without peer review"))),
        (F.col("rct") == 0, "gap", F.lit("No randomized controlled trials (RCTs) found in this evidence corpus")),
        ((F.col("rev") == 0) & (n > 3), "gap", F.lit("No systematic reviews or meta-analyses found")),
        (F.col("sources") == 1, "quality", F.concat(F.lit("All studies sourced from a single database ("), F.col("source"), F.lit(")"))),
        (F.col("small") > n / 2, "quality", F.concat(text(F.col("small")), F.lit(" of "), text(n), F.lit(" studies have small sample sizes (<50)"))),
    ]
    rows = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("position"), F.lit(kind).alias("type"), t.alias("text"))) for k, (c, kind, t) in enumerate(items)]))
    return s.select(F.explode(rows).alias("w")).select("w.*")


def merge_warnings(computed: DataFrame, suggested: DataFrame) -> DataFrame:
    """Both lists, one warning for each first 40 lower-cased characters, computed ones first."""
    both = computed.withColumn("list", F.lit(0)).unionByName(suggested.withColumn("list", F.lit(1)))
    order = Window.partitionBy(F.substring(F.lower("text"), 1, 40)).orderBy("list", "position")
    return both.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def themes(studies: DataFrame) -> DataFrame:
    """Studies by design and kind of population: opening, number, combined size."""
    design = F.coalesce(F.nullif("study_design", F.lit("")), F.lit("observational"))
    opening = F.lit("Evidence")
    for name, text in THEMES.items():
        opening = F.when(F.lower(design) == name, text).otherwise(opening)
    keyed = studies.select(design.alias("design"), T.population_type(F.col("population")).alias("population_type"), opening.alias("theme"), "sample_size")
    grouped = keyed.groupBy("design", "population_type", "theme").agg(F.count(F.lit(1)).alias("studies"), F.coalesce(F.sum("sample_size"), F.lit(0)).alias("combined_n"))
    many = F.when(F.col("combined_n") > 0, F.format_string("%s across %d studies (combined n=%d)", "theme", "studies", "combined_n")).otherwise(F.format_string("%s from %d studies", "theme", "studies"))
    return grouped.withColumn("lead", many)


def findings(studies: DataFrame) -> DataFrame:
    """Results by outcome group: how many studies and results, in correlational wording."""
    held = studies.where(has(F.col("key_result"))).select(T.outcome_group(F.col("outcome_measured")).alias("outcome"), T.without_causality(F.col("key_result")).alias("result"), "study_id")
    return held.groupBy("outcome").agg(F.count(F.lit(1)).alias("results"), F.count_distinct("result").alias("wordings"), F.min("result").alias("first_result"), F.min("study_id").alias("first_study"))


def opening(studies: DataFrame, query: str) -> DataFrame:
    """One row: the opening sentence of a narrative."""
    s = studies.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("preprint_status") == "Peer-reviewed").alias("peer"), F.count_if(F.col("preprint_status") == "Preprint").alias("pre"))
    status = F.when((F.col("pre") > 0) & (F.col("peer") > 0), F.format_string(" (%d peer-reviewed, %d %s)", "peer", "pre", F.when(F.col("pre") == 1, "preprint").otherwise("preprints"))).when(F.col("pre") > 0, F.concat(F.lit(", all of which "), F.when(F.col("pre") == 1, "is a preprint").otherwise("are preprints"))).otherwise("")
    return s.select(F.concat(F.format_string("This synthesis draws from %d %s", "n", F.when(F.col("n") == 1, "study").otherwise("studies")), status, F.lit(f" examining {query.lower()}.")).alias("text"))


def reference_numbers(claims: DataFrame) -> DataFrame:
    """Papers of each report numbered by their first appearance in its ``claims`` (report_id,
    position, paper_ids)."""
    return first_references(claims.select("report_id", "position", F.posexplode("paper_ids").alias("at", "paper_id")))


def first_references(each: DataFrame) -> DataFrame:
    """``reference_numbers`` of claims given as rows (report_id, position, at, paper_id), one for each
    paper of a claim; papers at one place are taken by their ids."""
    first = each.groupBy("report_id", "paper_id").agg(F.min(F.struct("position", "at")).alias("seen"))
    order = Window.partitionBy("report_id").orderBy("seen.position", "seen.at", "paper_id")
    return first.select("report_id", "paper_id", F.row_number().over(order).alias("number"))


# --- exports ----------------------------------------------------------------------------------


#: Headers of the two CSV exports.
OUTCOME_HEADER = "Title,Authors,Year,DOI,Study Design,Sample Size,Population,Intervention,Comparator,Outcome,Effect Size,P-value,Key Result,Review Type,Preprint Status,OpenAlex ID"
PAPER_HEADER = "Title,Authors,Year,DOI,Citation Count,Study Design,Sample Size,Population,Outcomes,Results,Effect Sizes,P-values,Review Type,Preprint Status,PDF URL,Landing Page URL,OpenAlex ID"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _number(c: Column) -> Column:
    """A number's text; none for 0."""
    return F.when(F.coalesce(c, F.lit(0)) != 0, c.cast("string")).otherwise("")


def cited_authors(formatted: Column) -> Column:
    """What a formatted citation names before its bracketed year; all of it without one."""
    before = F.trim(F.regexp_extract(formatted, r"^(.+?)\s*\(", 1))
    return F.when(_text(formatted) == "", "Unknown").otherwise(F.coalesce(F.nullif(before, F.lit("")), formatted))


def outcome_csv(studies: DataFrame) -> DataFrame:
    """Lines (study_id, place, line) of the CSV export below ``OUTCOME_HEADER``, one for each
    outcome of a study, and one with empty cells for a study without any.

    Studies have title, formatted, year, doi, study_design, sample_size, population, outcomes
    (structs), review_type, preprint_status and openalex_id.
    """
    f = T.csv_field
    each = studies.select("*", F.posexplode_outer("outcomes").alias("at", "o"))
    cells = [f(F.col("title")), f(cited_authors(F.col("formatted"))), _number(F.col("year")), _text(F.col("doi")), _text(F.col("study_design")), _number(F.col("sample_size")), f(F.col("population"))]
    cells += [f(F.col("o")[name]) for name in ("intervention", "comparator", "outcome_measured", "effect_size", "p_value", "key_result")]
    cells += [_text(F.col(c)) for c in ("review_type", "preprint_status", "openalex_id")]
    return each.select("study_id", F.coalesce("at", F.lit(0)).alias("place"), F.concat_ws(",", *cells).alias("line"))


def paper_csv(studies: DataFrame) -> DataFrame:
    """Lines (study_id, line) of the CSV export below ``PAPER_HEADER``, one for each study.

    Studies have the columns of ``outcome_csv`` and citation_count, source, pdf_url and
    landing_page_url; one of arXiv without a link gets that of its id.
    """
    f = T.csv_field
    listed = lambda name: F.filter(F.transform("outcomes", lambda o: _text(o[name])), lambda x: x != "")
    arxiv = F.concat(F.lit("https://arxiv.org/pdf/"), F.regexp_replace(F.col("study_id").cast("string"), "^arxiv-", ""))
    pdf = F.when(_text(F.col("pdf_url")) != "", F.col("pdf_url")).when(F.col("source") == "arxiv", arxiv).otherwise("")
    cells = [f(F.col("title")), f(cited_authors(F.col("formatted"))), _number(F.col("year")), _text(F.col("doi")), _text(F.col("citation_count")), _text(F.col("study_design")), _number(F.col("sample_size")), f(F.col("population"))]
    cells += [f(F.array_join(F.transform("outcomes", lambda o: _text(o["outcome_measured"])), "; ")), *[f(F.array_join(listed(name), "; ")) for name in ("key_result", "effect_size", "p_value")]]
    cells += [_text(F.col("review_type")), _text(F.col("preprint_status")), pdf, _text(F.col("landing_page_url")), _text(F.col("openalex_id"))]
    return studies.select("study_id", F.concat_ws(",", *cells).alias("line"))


def ris(studies: DataFrame) -> DataFrame:
    """RIS entries (study_id, entry): tagged lines from TY to ER, empty fields left out.

    Studies have the columns of ``outcome_csv`` and pubmed_id and abstract_excerpt.
    """
    tagged = lambda tag, c: F.concat(F.lit(f"{tag}  - "), c.cast("string"))
    line = lambda tag, c: F.filter(F.array(c.cast("string")), lambda x: _text(x) != "")
    tags = lambda tag, c: F.transform(line(tag, c), lambda x: tagged(tag, x))
    before = F.trim(F.regexp_extract("formatted", r"^([^(]+)\(", 1))
    names = F.filter(F.transform(F.split(F.coalesce(before, F.lit("")), r",|\set al\."), lambda n: F.trim(n)), lambda n: (n != "") & (n != "et al."))
    outcomes = F.transform("outcomes", lambda o, i: F.concat(F.lit("KW  - Outcome "), (i + 1).cast("string"), F.lit(": "), _text(o["outcome_measured"])))
    lines = F.concat(
        F.array(F.lit("TY  - JOUR")), tags("TI", F.col("title")), F.transform(names, lambda n: tagged("AU", n)), tags("PY", _number(F.col("year"))), tags("DO", F.col("doi")), tags("UR", F.col("openalex_id")),
        tags("PM", F.col("pubmed_id")), tags("AB", F.col("abstract_excerpt")), F.array(tagged("KW", F.concat(F.lit("Study Design: "), _text(F.col("study_design"))))),
        F.transform(line("KW", _number(F.col("sample_size"))), lambda n: F.concat(F.lit("KW  - Sample Size: "), n)), outcomes, F.array(F.lit("ER  - ")),
    )
    return studies.select("study_id", F.array_join(lines, "\n").alias("entry"))


# --- progress -----------------------------------------------------------------------------------

#: Seconds that the stages of a search are expected to take.
STAGES = {"searching": 10, "extracting": 20, "synthesising": 20}


def progress(jobs: DataFrame, now: Column) -> DataFrame:
    """``jobs`` (created_at) with stage, percent (95 at most before the end) and seconds_left."""
    elapsed = (F.unix_millis(now) - F.unix_millis("created_at")) / 1000
    total, upto, stage = sum(STAGES.values()), 0, F
    for name, seconds in STAGES.items():
        upto += seconds
        stage = stage.when(elapsed < upto, name)
    percent = F.least(elapsed / total * 95, F.lit(95.0))
    return jobs.withColumns({"stage": stage.otherwise([*STAGES][-1]), "percent": F.round(percent, 4), "seconds_left": F.greatest(F.lit(0), F.ceil(total - elapsed)).cast("long")})

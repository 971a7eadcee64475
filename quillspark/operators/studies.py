"""Structured studies from abstracts, their tiers and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import doi as D
from ..functions import extraction as X
from ..functions import text as T


def outcomes(papers: DataFrame, key: str = "study_id") -> DataFrame:
    """Every result sentence of the abstracts as an outcome with its confidence."""
    each = papers.select(key, F.posexplode(T.sentences(T.collapse(F.col("abstract")))).alias("at", "sentence")).where(X.is_result(F.col("sentence")))
    pair = X.comparison(F.col("sentence"))
    each = each.withColumns(
        {"outcome_measured": X.outcome_measured(F.col("sentence")), "effect_size": X.effect_size(F.col("sentence")), "p_value": X.p_value_or_interval(F.col("sentence")), "intervention": pair["intervention"], "comparator": pair["comparator"]}
    )
    return each.withColumn("confidence", X.outcome_confidence(F.col("sentence"), F.col("effect_size"), F.col("p_value"), F.col("intervention"), F.col("comparator"), F.col("sentence")))


def inverted_index(papers: DataFrame, key: str = "study_id") -> DataFrame:
    """Rows (key, index): each abstract as a map of its words to their positions, from 0."""
    each = papers.select(key, F.posexplode(F.split(T.collapse(F.col("abstract")), " ")).alias("at", "word"))
    words = each.groupBy(key, "word").agg(F.array_sort(F.collect_list("at")).alias("places"))
    return words.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("index"))


def best_outcomes(found: DataFrame, least: float = 0.35, key: str = "study_id") -> DataFrame:
    """Of outcomes with one name in a study the most confident; of a study those of at least
    ``least``, or the best one alone."""
    name = F.lower(F.trim("outcome_measured"))
    same = Window.partitionBy(key, name).orderBy(F.desc("confidence"), "at")
    order = Window.partitionBy(key).orderBy(F.desc("confidence"), "at")
    one = found.withColumn("_n", F.row_number().over(same)).where("_n = 1").withColumn("place", F.row_number().over(order))
    return one.where((F.col("confidence") >= least) | (F.col("place") == 1)).drop("_n")


def first_sentences(papers: DataFrame, found: DataFrame, key: str = "study_id") -> DataFrame:
    """For papers without any outcome in ``found`` the opening of the abstract, 280 characters of
    its first sentence, as an outcome without sides."""
    first = F.substring(F.get(T.sentences(T.collapse(F.col("abstract"))), 0), 1, 280)
    rest = papers.join(found.select(key).distinct(), key, "left_anti").select(key, F.lit(0).alias("at"), first.alias("sentence")).where("sentence <> ''")
    none = F.lit(None).cast("string")
    made = rest.withColumns({"outcome_measured": X.outcome_measured(F.col("sentence")), "effect_size": X.effect_size(F.col("sentence")), "p_value": X.p_value_or_interval(F.col("sentence")), "intervention": none, "comparator": none})
    scored = X.outcome_confidence(F.col("sentence"), F.col("effect_size"), F.col("p_value"), none, none, F.col("sentence"))
    return made.withColumn("confidence", scored).withColumn("place", F.lit(1))


def studies(papers: DataFrame, key: str = "study_id") -> DataFrame:
    """One row per paper: design, review type, size, population, and its best outcomes, or its
    first sentence for one that reports none."""
    text = F.concat_ws(" ", "title", "abstract")
    head = papers.select(key, "title", "year", "source", F.substring("abstract", 1, 420).alias("abstract_excerpt"), X.study_design(text).alias("study_design"), X.review_type(text).alias("review_type"), X.sample_size(F.col("abstract")).alias("sample_size"), X.population(F.col("abstract")).alias("population"))
    item = F.struct("place", "outcome_measured", "effect_size", "p_value", "intervention", "comparator", "confidence")
    found = outcomes(papers, key)
    best = best_outcomes(found, key=key)
    held = best.unionByName(first_sentences(papers, found, key).select(best.columns)).groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("outcomes"))
    return head.join(held, key, "left").withColumn("outcomes", F.coalesce("outcomes", F.array().cast(held.schema["outcomes"].dataType)))


def has(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def tier(found: DataFrame) -> DataFrame:
    """``strict``: title, year, a known design, an excerpt of 50 characters and an outcome with a
    measure; ``partial``: title, year and an outcome; else ``incomplete``."""
    measured = F.exists("outcomes", lambda o: has(o["outcome_measured"]) & (has(o["effect_size"]) | has(o["p_value"]) | has(o["intervention"]) | has(o["comparator"])))
    named = has(F.col("title")) & (F.coalesce("year", F.lit(0)) != 0)
    strict = named & (F.col("study_design") != "unknown") & (F.length(F.trim("abstract_excerpt")) >= 50) & measured
    return found.withColumn("tier", F.when(strict, "strict").when(named & (F.size("outcomes") > 0), "partial").otherwise("incomplete"))


def fallback_studies(papers: DataFrame, current_year: int, key: str = "study_id") -> DataFrame:
    """Studies of papers that nothing was extracted from: the abstract's first sentence as a
    reported outcome, the design from its hint."""
    sentence = F.get(T.sentences(F.coalesce("abstract", F.lit(""))), 0)
    hint = F.lower(F.coalesce("study_design_hint", F.lit("")))
    design = F.when(hint.rlike("rct|randomi[sz]ed"), "RCT").when(hint.contains("cohort"), "cohort").when(hint.contains("cross"), "cross-sectional").when(hint.contains("review"), "review").otherwise("unknown")
    kind = F.when(hint.contains("meta-analysis"), "Meta-analysis").when(hint.contains("systematic review"), "Systematic review").otherwise("None")
    filled = lambda c: F.nullif(c, F.lit(""))
    return papers.select(
        key,
        "title",
        F.coalesce(F.nullif("year", F.lit(0)), F.lit(current_year)).alias("year"),
        design.alias("study_design"),
        kind.alias("review_type"),
        F.lit("Reported outcome").alias("outcome_measured"),
        sentence.alias("key_result"),
        F.coalesce(sentence, "title").alias("citation_snippet"),
        F.coalesce(sentence, filled(F.col("abstract")), F.col("title")).alias("abstract_excerpt"),
        F.when(F.col("is_preprint"), "Preprint").otherwise("Peer-reviewed").alias("preprint_status"),
        F.coalesce("citation_count", F.lit(0)).alias("citation_count"),
    )


def with_links(papers: DataFrame, sources: DataFrame) -> DataFrame:
    """``papers`` (paper_id, doi) with the pdf_url and landing_page_url of their source record:
    that of their id, else the first by ``position`` of their identifier."""
    links = F.struct("pdf_url", "landing_page_url")
    by_id = sources.groupBy("paper_id").agg(F.max_by(links, "position").alias("_own"))
    doi = D.retrieval_doi(F.col("doi"))
    by_doi = sources.withColumn("_doi", doi).where("_doi <> ''").groupBy("_doi").agg(F.min_by(links, "position").alias("_other"))
    found = papers.withColumn("_doi", doi).join(by_id, "paper_id", "left").join(by_doi, "_doi", "left")
    return found.select(*papers.columns, F.coalesce("_own", "_other").alias("_l")).select(*papers.columns, "_l.pdf_url", "_l.landing_page_url")


def extraction_summary(results: DataFrame, inputs: int) -> DataFrame:
    """One row about an extraction's ``results`` (tier, used_pdf, fallback_reason): how many of the
    ``inputs`` were read, from what, how completely, and a map of the reasons for falling back."""
    whole = results.agg(
        F.count(F.lit(1)).alias("extracted_total"),
        F.count_if(F.col("tier") == "strict").alias("complete_total"),
        F.count_if(F.col("tier") == "partial").alias("partial_total"),
        F.count_if("used_pdf").alias("used_pdf"),
        F.count_if(~F.col("used_pdf")).alias("used_abstract_fallback"),
    )
    reasons = results.where(has(F.col("fallback_reason"))).groupBy("fallback_reason").agg(F.count(F.lit(1)).alias("n"))
    # The reasons are a short fixed list; one row of them meets one row of counts.
    named = reasons.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("fallback_reason", "n")))).alias("fallback_reasons"))
    joined = whole.withColumn("_k", F.lit(1)).join(named.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return joined.withColumns({"total_inputs": F.lit(inputs).cast("long"), "failures": F.greatest(F.lit(0).cast("long"), F.lit(inputs) - F.col("extracted_total"))})


def extraction_stats(tiered: DataFrame) -> DataFrame:
    """Studies by tier and design."""
    return tiered.groupBy("tier", "study_design").agg(F.count(F.lit(1)).alias("studies"), F.count("sample_size").alias("with_sample_size"), F.sum(F.size("outcomes")).alias("outcomes"))


def _distinct_outcomes(outcomes: Column) -> Column:
    """Outcomes without those whose measure, snippet and result an earlier one has; in order."""
    text = lambda o, c: F.coalesce(o[c], F.lit(""))
    name = lambda o: F.concat_ws("|", text(o, "outcome_measured"), text(o, "citation_snippet"), text(o, "key_result"))
    named = F.transform(outcomes, lambda o: F.struct(name(o).alias("name"), o.alias("o")))
    names = F.transform(named, lambda x: x["name"])
    first = F.filter(named, lambda x, i: F.array_position(names, x["name"]) == i + 1)
    return F.transform(first, lambda x: x["o"])


def merge_studies(parts: DataFrame, key: str = "study_id") -> DataFrame:
    """Studies that several extractions hold: every scalar of the last, the longest
    ``abstract_excerpt`` (the first of several), the most citations (null for none), and the
    ``outcomes`` of all, one of each measure, snippet and result.

    ``parts`` has an ``ordinal`` that says which came last, and one row a study and extraction.
    Studies of one extraction stay as they are; rows without a key go.
    """
    scalars = [c for c in parts.columns if c not in (key, "ordinal", "outcomes", "abstract_excerpt", "citation_count")]
    longest = F.max_by("abstract_excerpt", F.struct(F.length(F.coalesce("abstract_excerpt", F.lit(""))), -F.col("ordinal"))).alias("abstract_excerpt")
    held = F.array_sort(F.collect_list(F.struct("ordinal", F.coalesce("outcomes", F.array().cast(parts.schema["outcomes"].dataType)).alias("o"))))
    merged = parts.where(has(F.col(key).cast("string"))).groupBy(key).agg(
        *[F.max_by(c, "ordinal").alias(c) for c in scalars],
        longest,
        F.nullif(F.max("citation_count"), F.lit(0)).alias("citation_count"),
        F.flatten(F.transform(held, lambda x: x["o"])).alias("outcomes"),
        F.count(F.lit(1)).alias("n"),
    )
    return merged.withColumn("outcomes", F.when(F.col("n") > 1, _distinct_outcomes(F.col("outcomes"))).otherwise(F.col("outcomes"))).drop("n")

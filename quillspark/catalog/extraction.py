"""Queries of extraction from abstracts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extraction as X
from ..functions import text as T
from ..operators import studies as S
from ..sources import readers
from ..views import CURRENT_YEAR, duck, table, view


def extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design, review type, sample size and population of every study."""
    text = F.concat_ws(" ", "title", "abstract")
    return view(spark, sf_dir, "studies").select("study_id", X.study_design(text).alias("design"), X.review_type(text).alias("review_type"), X.sample_size(F.col("abstract")).alias("sample_size"), X.population(F.col("abstract")).alias("population"))


def extract_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every result sentence with what it compares, measures and finds."""
    found = S.outcomes(view(spark, sf_dir, "studies"))
    return found.select("study_id", F.col("at").cast("long").alias("at"), "outcome_measured", "effect_size", "p_value", "intervention", "comparator", "confidence")


def extract_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured studies and their tier."""
    tiered = S.tier(S.studies(view(spark, sf_dir, "studies")))
    return tiered.select("study_id", "study_design", "sample_size", F.size("outcomes").cast("long").alias("outcomes"), "tier")


def extraction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies by tier and design."""
    return S.extraction_stats(S.tier(S.studies(view(spark, sf_dir, "studies"))))


def extraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row about the extraction of all studies, with its reasons for falling back."""
    papers = view(spark, sf_dir, "studies")
    i = F.col("study_id")
    reason = F.when(i % 3 == 1, "no_pdf_url").when(i % 6 == 2, "pdf_timeout")
    results = S.tier(S.studies(papers.where("study_id % 13 > 0"))).withColumns({"used_pdf": i % 3 == 0, "fallback_reason": reason})
    found = S.extraction_summary(results, papers.count())
    reasons = F.array_join(F.transform(F.array_sort(F.map_entries("fallback_reasons")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|")
    return found.withColumn("fallback_reasons", reasons)


def fallback_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies of papers without an extraction, of which some lack abstract or year."""
    i = F.col("study_id")
    hint = F.when(i % 5 == 0, "Randomised trial").when(i % 5 == 1, "systematic review").when(i % 5 == 2, "cross-sectional meta-analysis").when(i % 5 == 3, "COHORT")
    papers = view(spark, sf_dir, "studies").withColumns({"abstract": F.when(i % 4 > 0, F.col("abstract")), "year": F.when(i % 3 > 0, F.col("year")), "study_design_hint": hint, "is_preprint": F.col("preprint_status") == "Preprint"})
    return S.fallback_studies(papers, CURRENT_YEAR)


def paper_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of source records by id, else by identifier, the first of equal ones."""
    s, i = view(spark, sf_dir, "studies"), F.col("study_id")
    papers = s.select(i.alias("paper_id"), F.when(i % 3 > 0, F.concat(F.lit("https://doi.org/10.5555/K"), F.floor(i / 4).cast("string"))).alias("doi"))
    sources = s.where("study_id % 5 > 0").select((i + F.when(i % 2 == 0, 0).otherwise(1_000_000)).alias("paper_id"), F.concat(F.lit("10.5555/k"), F.floor(i / 4).cast("string")).alias("doi"), i.alias("position"), F.concat(F.lit("https://e.org/p/"), i.cast("string")).alias("pdf_url"), F.concat(F.lit("https://e.org/l/"), i.cast("string")).alias("landing_page_url"))
    return S.with_links(papers, sources).select("paper_id", "pdf_url", "landing_page_url")


def merged_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: studies that two extractions hold, with their outcomes as structs."""
    outcome = lambda measured, result: F.struct(measured.alias("outcome_measured"), F.col("title").alias("citation_snippet"), result.alias("key_result"), F.col("effect_size"))
    own = outcome(F.col("outcome_measured"), F.col("key_result"))
    s = view(spark, sf_dir, "studies")
    parts = s.select("study_id", "title", F.col("abstract").alias("abstract_excerpt"), "study_design", (F.col("citation_count") % 4).alias("citation_count"), F.array(own, own).alias("outcomes"), F.lit(0).alias("ordinal"))
    again = s.where("study_id % 2 = 0").select("study_id", F.upper("title").alias("title"), F.substring("abstract", 1, 40).alias("abstract_excerpt"), F.lit("RCT").alias("study_design"), (F.col("citation_count") % 3).alias("citation_count"), F.array(own, outcome(F.lit("mood"), F.lit(None).cast("string"))).alias("outcomes"), F.lit(1).alias("ordinal"))
    merged = S.merge_studies(parts.unionByName(again))
    shown = F.transform("outcomes", lambda o: F.concat_ws("|", F.coalesce(o["outcome_measured"], F.lit("")), o["citation_snippet"], F.coalesce(o["key_result"], F.lit("")), F.coalesce(o["effect_size"], F.lit(""))))
    return merged.select("study_id", "study_design", "title", F.length("abstract_excerpt").cast("long").alias("chars"), F.col("citation_count").cast("int").alias("citation_count"), F.array_join(shown, ";").alias("outcomes"))


def result_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by direction."""
    return view(spark, sf_dir, "studies").groupBy(X.result_direction(F.col("key_result")).alias("direction")).agg(F.count(F.lit(1)).alias("results"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF links of pages (a link is appended to two pages of three)."""
    p = table(spark, sf_dir, "pages")
    extra = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<iframe src="//host/'), F.col("page_id").cast("string"), F.lit('.pdf#view"></iframe>'))).when(F.col("page_id") % 3 == 1, F.concat(F.lit('<a class=x href="/d/'), F.col("page_id").cast("string"), F.lit('.pdf">get</a>'))).otherwise("")
    return p.select("page_id", T.pdf_link(F.concat("html", extra)).alias("pdf"), F.length(T.without_tags(F.col("html"))).cast("long").alias("text_chars"))


def text_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted citations, authors, groups and fields."""
    authors = F.array(F.lit("Lee A"), F.concat(F.lit("Kim "), F.col("study_id").cast("string")), F.lit("Ng C"), F.lit("Roe D"))
    named = F.slice(authors, 1, (F.col("study_id") % 5).cast("int"))
    cited = T.citation(named, F.col("year"), F.col("title"), F.col("source"))
    s = view(spark, sf_dir, "studies").withColumn("cited", cited)
    return s.select("study_id", "cited", T.first_author(F.col("cited")).alias("lead"), T.shortened(F.col("abstract"), 60).alias("short"), T.without_causality(F.col("key_result")).alias("result"), T.population_type(F.col("population")).alias("population_type"), T.outcome_group(F.col("outcome_measured")).alias("outcome"), T.csv_field(F.concat(F.col("title"), F.lit(', "x"'))).alias("field"))


def conversation_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's answers put together from their stream events in order."""
    return readers.joined_stream(readers.as_stream_events(table(spark, sf_dir, "conversations"))).select("conv_id", F.length("answer").cast("long").alias("chars"), F.md5("answer").alias("digest"))


def inverted_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstracts through their inverted index and back."""
    index = S.inverted_index(view(spark, sf_dir, "studies"))
    return index.select("study_id", T.abstract_of(F.col("index")).alias("abstract"))


STUDIES = duck("studies")


def _outcomes_sql() -> str:
    effect, p_value, interval = X.EFFECT.replace("(?i)", ""), X.P_VALUE.replace("(?i)", ""), X.INTERVAL.replace("(?i)", "")
    effect = effect.replace("'", "''")
    c1, c2 = (c.replace("(?i)", "") for c in X.COMPARISONS)
    o1, o2 = (o.replace("(?i)", "") for o in X.OUTCOMES)
    clean = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    side = lambda p, i: f"regexp_replace({clean(f'regexp_extract(sentence, $re${p}$re$, {i}, $q$i$q$)')}, '^the\\s+', '', 'i')"
    named = lambda p: f"trim(regexp_replace({clean(f'regexp_extract(sentence, $re${p}$re$, 1, $q$i$q$)')}, '\\b(the|a|an)\\b', '', 'gi'))"
    marks = " OR ".join(f"contains(lower(sentence), '{m}')" for m in X.RESULT_MARKERS)
    parts = "list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(abstract, '\\s+', ' ', 'g')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
    return STUDIES + f""",
cut AS (SELECT study_id, unnest({parts}) AS sentence, generate_subscripts({parts}, 1) - 1 AS at_ FROM studies),
raw AS (SELECT study_id, at_, sentence, nullif({clean(f"regexp_extract(sentence, $re${effect.replace("''", "'")}$re$, 0, 'i')")}, '') AS effect_size,
  coalesce(nullif({clean(f"regexp_extract(sentence, $re${p_value}$re$, 0, 'i')")}, ''), nullif({clean(f"regexp_extract(sentence, $re${interval}$re$, 0, 'i')")}, '')) AS p_value,
  {side(c1, 1)} AS i1, {side(c1, 2)} AS k1, {side(c2, 1)} AS i2, {side(c2, 2)} AS k2, {named(o1)} AS n1, {named(o2)} AS n2,
  nullif(array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(sentence), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2)[1:8], ' '), '') AS n3 FROM cut WHERE {marks}),
outcomes AS (SELECT study_id, at_, sentence, effect_size, p_value, CASE WHEN i1 <> '' AND k1 <> '' THEN i1 WHEN i2 <> '' AND k2 <> '' THEN i2 END AS intervention, CASE WHEN i1 <> '' AND k1 <> '' THEN k1 WHEN i2 <> '' AND k2 <> '' THEN k2 END AS comparator,
  CASE WHEN length(n1) >= 3 THEN substr(n1, 1, 120) WHEN length(n2) >= 3 THEN substr(n2, 1, 120) ELSE coalesce(n3, 'reported outcome') END AS outcome_measured FROM raw),
judged AS (SELECT *, round(least(1, 0.2::double + 0.2::double + CASE WHEN effect_size <> '' THEN 0.25::double ELSE 0 END + CASE WHEN p_value <> '' THEN 0.2::double ELSE 0 END + CASE WHEN intervention <> '' THEN 0.15::double ELSE 0 END + CASE WHEN comparator <> '' THEN 0.15::double ELSE 0 END + CASE WHEN length(sentence) >= 20 THEN 0.1::double ELSE 0 END), 2) AS confidence FROM outcomes)"""


def _fields_sql() -> str:
    design = "CASE"
    for name, pattern, _ in X.DESIGNS:
        design += f" WHEN regexp_matches(lower(t), $re${pattern}$re$) THEN '{name}'"
    design += " ELSE 'unknown' END"
    sizes = ", ".join(f"try_cast(nullif(regexp_extract(abstract, $re${p.replace('(?i)', '')}$re$, 1, 'i'), '') AS int)" for p in X.SAMPLE_SIZES)
    return STUDIES + f""", f AS (SELECT *, concat(title, ' ', abstract) AS t FROM studies)
SELECT study_id, {design} AS design, CASE WHEN contains(lower(t), 'meta-analysis') OR contains(lower(t), 'meta analysis') THEN 'Meta-analysis' WHEN contains(lower(t), 'systematic review') THEN 'Systematic review' ELSE 'None' END AS review_type,
  coalesce({sizes}) AS sample_size,
  substr(list_filter(string_split(regexp_replace(trim(regexp_replace(abstract, '\\s+', ' ', 'g')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, $re${X.POPULATION.replace('(?i)', '')}$re$, 'i'))[1], 1, 220) AS population FROM f"""


def _tiers_sql() -> str:
    design = "CASE"
    for name, pattern, _ in X.DESIGNS:
        design += f" WHEN regexp_matches(lower(concat(title, ' ', abstract)), $re${pattern}$re$) THEN '{name}'"
    sizes = ", ".join(f"try_cast(nullif(regexp_extract(abstract, $re${p.replace('(?i)', '')}$re$, 1, 'i'), '') AS int)" for p in X.SAMPLE_SIZES)
    return _outcomes_sql() + f""",
one AS (SELECT *, row_number() OVER (PARTITION BY study_id, lower(trim(outcome_measured)) ORDER BY confidence DESC, at_) AS k FROM judged),
placed AS (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY confidence DESC, at_) AS place FROM one WHERE k = 1),
held AS (SELECT study_id, count(*) AS outcomes, bool_or(outcome_measured <> '' AND (coalesce(effect_size, '') <> '' OR coalesce(p_value, '') <> '' OR coalesce(intervention, '') <> '' OR coalesce(comparator, '') <> '')) AS measured FROM placed WHERE confidence >= 0.35 OR place = 1 GROUP BY study_id),
opened AS (SELECT study_id FROM cut WHERE at_ = 0 AND study_id NOT IN (SELECT study_id FROM judged)),
d AS (SELECT study_id, title, year, abstract, {design} ELSE 'unknown' END AS study_design, coalesce({sizes}) AS sample_size FROM studies),
tiered AS (SELECT d.study_id, d.study_design, d.sample_size, coalesce(h.outcomes, CASE WHEN o.study_id IS NOT NULL THEN 1 ELSE 0 END) AS outcomes, o.study_id IS NOT NULL AS opening, CASE WHEN d.title <> '' AND d.year <> 0 AND d.study_design <> 'unknown' AND length(trim(substr(d.abstract, 1, 420))) >= 50 AND coalesce(h.measured, false) THEN 'strict' WHEN d.title <> '' AND d.year <> 0 AND (coalesce(h.outcomes, 0) > 0 OR o.study_id IS NOT NULL) THEN 'partial' ELSE 'incomplete' END AS tier FROM d LEFT JOIN held h ON d.study_id = h.study_id LEFT JOIN opened o ON d.study_id = o.study_id)"""


def _formats_sql() -> str:
    causal = "key_result"
    for old, new in T.CAUSAL:
        causal = f"regexp_replace({causal}, '\\b{old}\\b', '{new}', 'gi')"
    return STUDIES + f""", a AS (SELECT *, (['Lee A', concat('Kim ', study_id), 'Ng C', 'Roe D'])[1:study_id % 5] AS names FROM studies),
b AS (SELECT *, trim(concat(CASE WHEN len(names) = 0 THEN 'Unknown' ELSE concat(array_to_string(names[1:3], ', '), CASE WHEN len(names) > 3 THEN ' et al.' ELSE '' END) END, ' (', year, '). ', title, '. ', source)) AS cited, trim(regexp_replace(abstract, '\\s+', ' ', 'g')) AS flat FROM a)
SELECT study_id, cited, trim(regexp_replace(regexp_extract(cited, '^([^,(]+)', 1), '\\set al\\.?$', '', 'i')) AS lead, CASE WHEN length(flat) <= 60 THEN flat ELSE concat(substr(flat, 1, 59), '...') END AS short, {causal} AS result,
  CASE WHEN regexp_matches(lower(population), 'child|adolescent') THEN 'pediatric' WHEN regexp_matches(lower(population), 'adult|elderly') THEN 'adult' WHEN regexp_matches(lower(population), 'patient|clinical') THEN 'clinical' ELSE 'general' END AS population_type,
  trim(regexp_replace(lower(outcome_measured), '\\b(symptoms?|levels?|scores?|measures?|rates?)\\b', '', 'g')) AS outcome, concat('"', replace(concat(title, ', "x"'), '"', '""'), '"') AS field FROM b"""


def _directions_sql() -> str:
    up, down = "|".join(X.POSITIVE_RESULTS), "|".join(X.NEGATIVE_RESULTS)
    return STUDIES + f""", m AS (SELECT regexp_matches(key_result, $re${up}$re$, 'i') AS up, regexp_matches(key_result, $re${down}$re$, 'i') AS down FROM studies)
SELECT CASE WHEN up AND down THEN 'mixed' WHEN up THEN 'positive' WHEN down THEN 'negative' ELSE 'neutral' END AS direction, count(*) AS results FROM m GROUP BY 1"""


QUERIES = {f.__name__: f for f in (extract_fields, extract_outcomes, extract_studies, extraction_stats, extraction_summary, fallback_studies, paper_links, merged_studies, result_directions, page_links, text_formats, conversation_answers, inverted_abstracts)}
ORACLE_SQL = {
    "extract_fields": _fields_sql(),
    "extract_outcomes": _outcomes_sql() + ' SELECT study_id, at_::bigint AS "at", outcome_measured, effect_size, p_value, intervention, comparator, confidence FROM judged',
    "extract_studies": _tiers_sql() + " SELECT * EXCLUDE (opening) FROM tiered",
    "extraction_stats": _tiers_sql() + " SELECT tier, study_design, count(*) AS studies, count(sample_size) AS with_sample_size, sum(outcomes)::bigint AS outcomes FROM tiered GROUP BY ALL",
    "extraction_summary": _tiers_sql() + """, r AS (SELECT *, CASE WHEN study_id % 3 = 1 THEN 'no_pdf_url' WHEN study_id % 6 = 2 THEN 'pdf_timeout' END AS reason FROM tiered WHERE study_id % 13 > 0), g AS (SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1)
SELECT count(*) AS extracted_total, count(*) FILTER (tier = 'strict') AS complete_total, count(*) FILTER (tier = 'partial') AS partial_total, count(*) FILTER (study_id % 3 = 0) AS used_pdf, count(*) FILTER (study_id % 3 <> 0) AS used_abstract_fallback,
  (SELECT string_agg(reason || '=' || n, '|' ORDER BY reason) FROM g) AS fallback_reasons, (SELECT count(*) FROM studies) AS total_inputs, (SELECT count(*) FROM studies) - count(*) AS failures FROM r""",
    "fallback_studies": STUDIES + f""", p AS (SELECT *, CASE WHEN study_id % 4 > 0 THEN regexp_extract(abstract, '^(.*?[.!?])(\\s|$)', 1) END AS s FROM studies)
SELECT study_id, title, CASE WHEN study_id % 3 > 0 THEN year ELSE {CURRENT_YEAR} END AS year, CASE study_id % 5 WHEN 0 THEN 'RCT' WHEN 1 THEN 'review' WHEN 2 THEN 'cross-sectional' WHEN 3 THEN 'cohort' ELSE 'unknown' END AS study_design,
  CASE study_id % 5 WHEN 1 THEN 'Systematic review' WHEN 2 THEN 'Meta-analysis' ELSE 'None' END AS review_type, 'Reported outcome' AS outcome_measured, s AS key_result, coalesce(s, title) AS citation_snippet, coalesce(s, title) AS abstract_excerpt, preprint_status, citation_count FROM p""",
    "paper_links": STUDIES + """, src AS (SELECT study_id + CASE WHEN study_id % 2 = 0 THEN 0 ELSE 1000000 END AS paper_id, study_id // 4 AS k, study_id AS position FROM studies WHERE study_id % 5 > 0),
f AS (SELECT k, min(position) AS position FROM src GROUP BY k)
SELECT s.study_id AS paper_id, 'https://e.org/p/' || coalesce(a.position, f.position) AS pdf_url, 'https://e.org/l/' || coalesce(a.position, f.position) AS landing_page_url
FROM (SELECT study_id, CASE WHEN study_id % 3 > 0 THEN study_id // 4 END AS k FROM studies) s LEFT JOIN src a ON a.paper_id = s.study_id LEFT JOIN f ON f.k = s.k""",
    "merged_studies": STUDIES + """, o AS (SELECT *, concat_ws('|', coalesce(outcome_measured, ''), title, key_result, coalesce(effect_size, '')) AS own, concat_ws('|', 'mood', title, '', coalesce(effect_size, '')) AS other FROM studies)
SELECT study_id, CASE WHEN study_id % 2 = 0 THEN 'RCT' ELSE study_design END AS study_design, CASE WHEN study_id % 2 = 0 THEN upper(title) ELSE title END AS title, length(abstract) AS chars,
  nullif(CASE WHEN study_id % 2 = 0 THEN greatest(citation_count % 4, citation_count % 3) ELSE citation_count % 4 END, 0)::integer AS citation_count, CASE WHEN study_id % 2 = 0 THEN concat(own, ';', other) ELSE concat(own, ';', own) END AS outcomes FROM o""",
    "result_directions": _directions_sql(),
    "page_links": """WITH p AS (SELECT page_id, html, concat(html, CASE page_id % 3 WHEN 0 THEN concat('<iframe src="//host/', page_id, '.pdf#view"></iframe>') WHEN 1 THEN concat('<a class=x href="/d/', page_id, '.pdf">get</a>') ELSE '' END) AS h FROM pages)
SELECT page_id, coalesce(nullif(regexp_extract(h, '<iframe[^>]+src=["'']([^"'']+\\.pdf[^"'']*)["'']', 1, 'i'), ''), nullif(regexp_extract(h, '<a[^>]+href=["'']([^"'']+\\.pdf[^"'']*)["'']', 1, 'i'), '')) AS pdf, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS text_chars FROM p""",
    "text_formats": _formats_sql(),
    "conversation_answers": "WITH a AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id) SELECT conv_id, length(answer) AS chars, md5(answer) AS digest FROM a",
    "inverted_abstracts": STUDIES + " SELECT study_id, trim(regexp_replace(abstract, '\\s+', ' ', 'g')) AS abstract FROM studies",
}

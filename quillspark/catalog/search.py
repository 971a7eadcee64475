"""Queries of query understanding, retrieval, canonical papers, quality and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import canonical, search, slices
from ..storage import materialise
from ..views import CURRENT_YEAR, duck, spread, table, view

#: The research question that ranking is measured against.
KEYWORDS = ["placebo", "sleep", "quality", "small", "ring"]
#: Questions are put together from these parts by part key.
_QUESTIONS = """
SELECT p_partkey AS query_id, concat(
  CASE p_partkey % 4 WHEN 0 THEN 'What are the effects of ' WHEN 1 THEN 'how does ' WHEN 2 THEN 'Please show ' ELSE '' END,
  CASE p_partkey % 5 WHEN 0 THEN 'sleep restriction ' WHEN 1 THEN 'Melatonin 10mg ' WHEN 2 THEN 'hypertension, anxiety ' WHEN 3 THEN concat(p_name, ' without stress ') ELSE 'BMI ' END,
  CASE p_partkey % 3 WHEN 0 THEN 'better than placebo' WHEN 1 THEN 'versus insomnia treatment' ELSE 'on working memory;attention' END) AS query
FROM part
"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_QUESTIONS.replace("FROM part", "FROM {part}"), part=spread(table(spark, sf_dir, "part"), "p_partkey"))


def query_understanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question normalised, expanded and judged."""
    q = search.understand(questions(spark, sf_dir))
    lists = [F.array_join(c, "|").alias(c) for c in ("terms", "added", "reasons")]
    return q.select("query_id", "normalized", *lists, "confidence")


def query_compilation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question in the languages of four sources."""
    return search.understand(questions(spark, sf_dir)).select("query_id", *[f"{s}_query" for s in search.SOURCE_BUDGETS])


def query_first_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first version's normaliser and the keyword extractors."""
    from ..functions import text as T

    q = questions(spark, sf_dir)
    ui = T.ui_keywords(F.col("query"))
    return q.select("query_id", T.normalize_query_first(F.col("query")).alias("normalized"), F.array_join(T.retrieval_terms(F.col("query")), "|").alias("keywords"), F.array_join(ui, "|").alias("marked"))


def query_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and forbidden concepts in what became of every question."""
    q = search.understand(questions(spark, sf_dir))
    corpus = F.concat_ws(" ", "normalized", F.array_join("added", " "))
    answers = q.select("query_id", corpus.alias("corpus"), F.array(F.lit("placebo"), F.lit("sleep")).alias("expected"), F.array(F.lit("sleep quality"), F.lit("better than")).alias("forbidden"))
    return search.benchmark(answers).select("query_id", F.col("matched_expected").cast("long").alias("matched_expected"), F.col("matched_forbidden").cast("long").alias("matched_forbidden"), "passed")


def search_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources one after the other, with reciprocal ranks, eligible alone."""
    papers = view(spark, sf_dir, "studies")
    parts = [papers.where(F.col("source") == s).select("study_id", "source", "abstract") for s in ("semantic_scholar", "openalex", "pubmed", "arxiv")]
    ranked = slices.numbered(search.eligible(search.fan_out(parts)), "source", "study_id")
    return ranked.withColumn("rank_signal", F.round(1.0 / F.col("place"), 6)).select("study_id", "source", "provider_ordinal", "rank_signal")


def search_rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best candidates of the question."""
    return search.rank_candidates(view(spark, sf_dir, "studies"), KEYWORDS).select("study_id", "candidate_score")


def search_expand_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first 20 seeds with references lead to."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"))
    seeds = table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select(F.col("o_orderkey").alias("citing"), F.rank().over(_by_price()).alias("seed_rank"))
    found = view(spark, sf_dir, "studies").where(F.length("abstract") >= 50).select(F.col("study_id").alias("cited"))
    return search.expand_citations(seeds, edges, found, most=60).select("cited", F.col("seed_rank").cast("long").alias("seed_rank"))


def _by_price():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("o_totalprice"), "o_orderkey")


def citation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of every cited work and the distinct works that cite it."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"))
    return edges.groupBy("cited").agg(F.count(F.lit(1)).alias("citations"), F.count_distinct("citing").alias("citing_works"))


def provider_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("call_id"), F.col("event_type").alias("provider"), "ts", (F.col("event_id") % 9 != 0).alias("ok"), (F.col("event_id") % 1000).cast("double").alias("latency_ms"))


def provider_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: which providers failed."""
    return search.coverage_report(provider_log(spark, sf_dir))


def provider_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, errors and latency by provider."""
    return search.provider_health(provider_log(spark, sf_dir))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies twice: as one source has them, and every third as another repeats it."""
    s = view(spark, sf_dir, "studies")
    i, number = F.col("study_id"), F.col("study_id").cast("string")
    own = s.select(
        i, F.concat(F.lit("p"), F.lpad(number, 7, "0")).alias("paper_id"), F.when(i % 2 == 0, F.concat(F.lit("10.5555/"), number)).alias("doi"), F.when(i % 5 == 1, F.concat(F.lit("pm"), number)).alias("pubmed_id"), F.when(i % 5 == 2, number).alias("arxiv_id"),
        "title", F.when(i % 9 == 0, "").otherwise(F.col("abstract")).alias("abstract"), F.when(i % 17 > 0, F.col("year")).alias("year"), F.when(i % 2 == 1, F.lit("Journal")).alias("venue"), "source", "citation_count", "is_retracted",
        F.round(1.0 / (1 + i % 25), 4).alias("rank_signal"), F.array(F.lit("Lee A"), F.concat(F.lit("Kim "), number)).alias("authors"), F.array(F.concat(F.lit("r"), (i % 10).cast("string"))).alias("referenced_ids"),
    )
    again = own.where("study_id % 3 = 0").withColumns(
        {
            "paper_id": F.concat(F.lit("q"), F.substring("paper_id", 2, 7)),
            "doi": F.when(i % 5 != 1, F.concat(F.lit("https://doi.org/"), F.upper("doi"))),
            "title": F.when(i % 5 == 1, "Untitled").otherwise(F.concat(F.upper("title"), F.lit("."))),
            "abstract": F.lit("A later abstract."), "year": F.when(i % 17 != 3, F.coalesce("year", F.lit(2001))), "venue": F.lit("Other"), "source": F.lit("crossref"), "citation_count": F.col("citation_count") + 5, "referenced_ids": F.array(F.concat(F.lit("s"), (i % 10).cast("string"))),
        }
    )
    return own.unionByName(again).drop("study_id")


def search_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers merged in order of arrival, by an identifier or by text."""
    arrival = F.substring("paper_id", 2, 7).cast("long") + F.when(F.col("paper_id").startswith("q"), 10_000_000).otherwise(0)
    merged = search.merge_groups(canonical.arrival_groups(materialise(papers(spark, sf_dir).withColumn("arrival", arrival), "papers")))
    came = F.array_join(F.transform("provenance", lambda p: F.concat(p["paper_id"], F.lit(":"), p["provider"])), ",")
    return merged.select("group_id", "title", "year", F.md5("abstract").alias("abstract"), "venue", "doi", "pubmed_id", "arxiv_id", F.col("citation_count").cast("long").alias("citation_count"), "is_retracted", "sources", "source_authority", came.alias("provenance"), F.array_join("referenced_ids", ",").alias("referenced"), "relevance")


def search_quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every paper and why it is rejected."""
    s = search.score_papers(view(spark, sf_dir, "studies"), CURRENT_YEAR, 1995, 2020, exclude_preprints=True)
    return s.select("study_id", "source_authority", "study_design_strength", "methods_transparency", "citation_impact", "recency_fit", "q_total", "reject_reason")


def search_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept papers, best first."""
    return search.kept_papers(search.score_papers(view(spark, sf_dir, "studies"), CURRENT_YEAR)).select("study_id", F.col("rank").cast("long").alias("rank"), "citation_count")


def claims_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim, its outcome and direction."""
    return search.claims(view(spark, sf_dir, "studies")).select("study_id", F.col("at").cast("long").alias("at"), "sentence", "outcome", "direction")


def searched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The kept papers of each search (50 studies a search), ranked; their claims with clusters;
    and the clusters."""
    i, number = F.col("study_id"), F.col("study_id").cast("string")
    s = view(spark, sf_dir, "studies").withColumns({"search": F.floor(i / 50).cast("string"), "doi": F.when(i % 2 == 0, F.concat(F.lit("10.5555/"), number)), "pubmed_id": F.when(i % 5 == 1, F.concat(F.lit("pm"), number)), "arxiv_id": F.when(i % 5 == 2, number)})
    ranked = materialise(search.kept_by_search(search.score_papers(s, CURRENT_YEAR), "search"), "ranked")
    clustered = materialise(search.clustered_claims(search.anchored_claims(ranked, "search"), "search"), "clustered")
    return ranked, clustered, search.claim_clusters(clustered, "search")


def claims_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every search's clusters of claims and their dispositions."""
    return searched(spark, sf_dir)[2].withColumn("cluster", F.col("cluster").cast("long"))


def claims_propositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paper's stance over the clusters of its claims."""
    _, clustered, clusters = searched(spark, sf_dir)
    return search.propositions(clustered, clusters, "search")


def claims_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent clusters of the claims of each search, 50 papers a search."""
    found = search.claims(view(spark, sf_dir, "studies")).withColumn("batch", F.floor(F.col("study_id") / 50).cast("string"))
    return search.greedy_clusters(found, "batch")


def evidence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every search's evidence table."""
    ranked, clustered, clusters = searched(spark, sf_dir)
    rows = search.evidence_table(ranked, search.propositions(clustered, clusters, "search"), "search")
    came = F.concat_ws(":", "provenance.provider", "provenance.external_id", F.col("provenance.metadata_confidence").cast("string"))
    return rows.withColumn("rank", F.col("rank").cast("long")).withColumn("provenance", came)


def evidence_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: every search's brief, each citation with its place and hash."""
    brief = search.evidence_brief(*searched(spark, sf_dir), "search")
    cited = F.array_join(F.transform("citations", lambda c: F.concat_ws(":", c["paper"], c["char_start"].cast("string"), c["char_end"].cast("string"), c["snippet_hash"])), ",")
    return brief.select("search", F.col("position").cast("long").alias("position"), "text", "stance", cited.alias("citations"))


def search_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many papers each step of a search leaves."""
    scored = search.score_papers(view(spark, sf_dir, "studies"), CURRENT_YEAR)
    return scored.agg(F.count(F.lit(1)).alias("retrieved"), F.count_if(F.length("abstract") > 50).alias("eligible"), F.count_if(F.col("reject_reason").isNull()).alias("kept"), F.count("reject_reason").alias("rejected"))


def request_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search requests within their bounds."""
    raw = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("request_id"), F.concat(F.lit("  "), "p_name").alias("query"), (F.col("p_size") * 60).cast("int").alias("from_year"), F.when(F.col("p_partkey") % 3 > 0, (F.col("p_size") * 50 + 500).cast("int")).alias("to_year"), F.when(F.col("p_partkey") % 2 > 0, (F.col("p_partkey") * 7).cast("int")).alias("max_candidates"), F.col("p_size").cast("int").alias("max_rows"))
    return search.sanitize_requests(raw)


def own_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the reports of one nation's users."""
    users = table(spark, sf_dir, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("user_id"))
    return search.visible_rows(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey"), users)


def claim_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each sentence lies in its abstract."""
    return search.claim_offsets(view(spark, sf_dir, "studies")).select("study_id", *[F.col(c).cast("long").alias(c) for c in ("at", "char_start", "char_end")])


def marked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstracts cut at the question's terms."""
    from ..functions import text as T

    parts = T.highlight_segments(F.col("abstract"), ["placebo", "sleep", "steel"])
    s = view(spark, sf_dir, "studies").select("study_id", "abstract", parts.alias("parts"))
    return s.select("study_id", F.size("parts").cast("long").alias("segments"), F.size(F.filter("parts", lambda p: p["hit"])).cast("long").alias("hits"), (F.array_join(F.transform("parts", lambda p: p["text"]), "") == F.col("abstract")).alias("whole"))


STUDIES = duck("studies")
#: The papers of ``papers``; doi in its plain form, ``given`` as it came.
PAPERS = STUDIES + """,
own AS (SELECT concat('p', lpad(study_id::varchar, 7, '0')) AS paper_id, CASE WHEN study_id % 2 = 0 THEN concat('10.5555/', study_id) END AS doi, CASE WHEN study_id % 5 = 1 THEN concat('pm', study_id) END AS pubmed_id, CASE WHEN study_id % 5 = 2 THEN study_id::varchar END AS arxiv_id, title,
  CASE WHEN study_id % 9 = 0 THEN '' ELSE abstract END AS abstract, CASE WHEN study_id % 17 > 0 THEN year END AS year, CASE WHEN study_id % 2 = 1 THEN 'Journal' END AS venue, source, citation_count, is_retracted, round(1.0::double / (1 + study_id % 25), 4) AS rank_signal, concat('Lee A Kim ', study_id) AS names, concat('r', study_id % 10) AS refs, study_id FROM studies),
papers AS (SELECT * EXCLUDE (study_id), doi AS given FROM own UNION ALL SELECT concat('q', substr(paper_id, 2)), CASE WHEN study_id % 5 <> 1 THEN doi END, pubmed_id, arxiv_id, CASE WHEN study_id % 5 = 1 THEN 'Untitled' ELSE concat(upper(title), '.') END, 'A later abstract.', CASE WHEN study_id % 17 <> 3 THEN coalesce(year, 2001) END, 'Other', 'crossref', citation_count + 5, is_retracted, rank_signal, names, concat('s', study_id % 10),
  CASE WHEN study_id % 5 <> 1 THEN 'https://doi.org/' || upper(doi) END FROM own WHERE study_id % 3 = 0)"""
_LIST = lambda items: "[" + ", ".join(f"'{x}'" for x in items) + "]"


def _stop(name: str) -> list[str]:
    from ..functions import text as T

    return getattr(T, name)


def _concepts(part: str) -> str:
    """DuckDB text for the added terms (part='terms') or the number of concepts met."""
    out = []
    for _, preferred, synonyms, never, most in search.ONTOLOGY:
        hit = "(" + " OR ".join(f"contains(normalized, '{t}')" for t in dict.fromkeys([preferred, *synonyms])) + ")"
        usable = _LIST([t for t in dict.fromkeys([preferred, *synonyms]) if t not in never])
        out.append(f"CASE WHEN {hit} THEN list_filter({usable}, lambda t: NOT list_contains(terms, t))[1:{most}] ELSE []::varchar[] END" if part == "terms" else f"{hit}::int")
    return f"flatten([{', '.join(out)}])" if part == "terms" else "(" + " + ".join(out) + ")"


def _distinct(sql: str) -> str:
    """Distinct elements in order of first place."""
    return f"list_filter({sql}, lambda x, i: list_position({sql}, x) = i)"


def _questions_sql() -> str:
    from ..functions import text as T

    stop = _LIST(T.QUERY_STOP_WORDS)
    strip = "unit"
    for p in T.LOW_SIGNAL_PREFIXES:
        strip = f"trim(regexp_replace({strip}, '{p}', '', 'i'))"
    neutral = "text_"
    for p, r, _ in T.COMPARATIVES:
        neutral = f"regexp_replace({neutral}, '{p}', '{r}', 'gi')"
    meets = lambda held: f"list_has_any(terms, {_LIST(held)})"
    codes = ["CASE WHEN low <> plain THEN 'lowercased' END", "CASE WHEN unit <> low THEN 'dose_unit_normalized' END", "CASE WHEN bare <> unit THEN 'boilerplate_removed' END"]
    codes += [f"CASE WHEN regexp_matches(text_, '{p}') THEN '{r}' END" for p, _, r in T.COMPARATIVES]
    codes += ["CASE WHEN len(added) > 0 THEN 'ontology_expansion_applied' END", "CASE WHEN len(terms) < 2 THEN 'short_query_penalty' END", f"CASE WHEN {meets(search.AMBIGUOUS)} THEN 'ambiguity_penalty' END", f"CASE WHEN {meets(search.NEGATIONS)} THEN 'negation_preserved' END"]
    codes += [f"CASE WHEN {meets(search.COMPARATORS)} THEN 'comparator_preserved' END", "CASE WHEN concepts > 0 THEN 'concept_match_bonus' END", "CASE WHEN len(added) > 6 THEN 'expansion_breadth_penalty' END"]
    conf = f"0.82::double + CASE WHEN len(terms) < 2 THEN -0.20::double ELSE 0 END + CASE WHEN {meets(search.AMBIGUOUS)} THEN -0.14::double ELSE 0 END + CASE WHEN {meets(search.NEGATIONS)} THEN 0.06::double ELSE 0 END + CASE WHEN {meets(search.COMPARATORS)} THEN 0.05::double ELSE 0 END + least(0.12::double, concepts * 0.04::double) + CASE WHEN len(added) > 6 THEN -0.05::double ELSE 0 END"
    return f"""WITH questions AS ({_QUESTIONS}),
a AS (SELECT *, trim(regexp_replace(regexp_replace(query, '\\s*([,;:!?])\\s*', ' \\1 ', 'g'), '\\s+', ' ', 'g')) AS plain FROM questions),
b AS (SELECT *, lower(plain) AS low FROM a),
c AS (SELECT *, regexp_replace(low, '{T.UNITS}', '\\1 \\2', 'gi') AS unit FROM b),
d AS (SELECT *, {strip} AS bare FROM c),
e AS (SELECT *, regexp_replace(bare, '\\b(vs\\.?|versus)\\b', 'vs', 'g') AS text_ FROM d),
f AS (SELECT *, trim(regexp_replace({neutral}, '\\s+', ' ', 'g')) AS normalized FROM e),
g AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(normalized, '[^a-z0-9/%\\-\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 AND NOT list_contains({stop}, w)) AS all_terms FROM f),
h AS (SELECT *, {_distinct('all_terms')}[1:12] AS terms FROM g),
i AS (SELECT *, {_concepts('terms')} AS all_added, {_concepts('count')} AS concepts FROM h),
understood AS (SELECT *, {_distinct('all_added')} AS added FROM i),
judged AS (SELECT *, round(greatest(0.05, least(0.99, {conf})), 3) AS confidence, list_filter([{', '.join(codes)}], lambda x: x IS NOT NULL) AS reasons FROM understood)
"""


def _source_sql(source: str) -> str:
    own, more = search.SOURCE_BUDGETS[source]
    quote = "CASE WHEN contains(t, ' ') THEN concat('\"', t, '\"') ELSE t END"
    if source in ("openalex", "arxiv"):
        both = f"list_concat(terms[1:{own}], added[1:{more}])"
        return f"coalesce(nullif(array_to_string({_distinct(both)}, ' '), ''), normalized)"
    field = "[Title/Abstract]" if source == "pubmed" else ""
    word = " AND " if field else " OR "
    left = f"array_to_string(list_transform(terms[1:{own}], lambda t: concat({quote}, '{field}')), '{word}')"
    right = f"array_to_string(list_transform(added[1:{more}], lambda t: concat({quote}, '{field}')), ' OR ')"
    both = f"concat({left}, ' AND (', {right}, ')')" if field else f"concat('(', {left}, ') OR (', {right}, ')')"
    return f"CASE WHEN len(terms) > 0 AND len(added) > 0 THEN {both} WHEN len(terms) > 0 THEN {left} WHEN len(added) > 0 THEN {right} ELSE normalized END"


def _any(column: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


def _count(column: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"contains({column}, '{t}')::int" for t in terms) + ")"


def _quality_sql(first: int, last: int, preprints: bool) -> str:
    from ..functions import scores as S

    y = CURRENT_YEAR
    return STUDIES + f""",
t AS (SELECT *, lower(abstract) AS low, lower(concat(title, ' ', abstract)) AS both_, preprint_status = 'Preprint' AS is_preprint FROM studies),
h AS (SELECT *, CASE WHEN contains(both_, 'meta-analysis') THEN 'meta-analysis' WHEN contains(both_, 'systematic review') THEN 'systematic' WHEN contains(both_, 'randomized') OR contains(both_, 'randomised') THEN 'rct' WHEN contains(both_, 'cohort') THEN 'cohort' WHEN contains(both_, 'cross-sectional') THEN 'cross' WHEN contains(both_, 'review') THEN 'review' ELSE 'other' END AS hint FROM t),
p AS (SELECT *, CASE source WHEN 'pubmed' THEN 0.98 WHEN 'openalex' THEN 0.92 WHEN 'semantic_scholar' THEN 0.9 WHEN 'crossref' THEN 0.89 WHEN 'arxiv' THEN 0.84 ELSE 0.75 END::double AS source_authority,
  CASE hint WHEN 'meta-analysis' THEN 0.9 WHEN 'systematic' THEN 0.9 WHEN 'rct' THEN 0.86 WHEN 'cohort' THEN 0.72 WHEN 'cross' THEN 0.64 WHEN 'review' THEN 0.62 ELSE CASE WHEN is_preprint THEN 0.45 ELSE 0.55 END END::double AS study_design_strength,
  least(1, {_count('low', S.METHOD_SIGNALS)}::double / 7 * 0.75 + regexp_matches(low, '\\b\\d{{2,}}\\b')::int * 0.25::double) AS mt,
  CASE WHEN citation_count <= 0 THEN 0 ELSE least(1, ln(1 + citation_count / (greatest(1, {y} - year + 1) * 10.0::double)) / ln(21.0::double)) END AS ci,
  least(1, exp(-greatest(0, {y} - year) / 8.0::double) + CASE WHEN year BETWEEN {first} AND {last} THEN 0.15 ELSE 0 END::double) AS rf FROM h),
scored AS (SELECT *, round(mt, 4) AS methods_transparency, round(ci, 4) AS citation_impact, round(rf, 4) AS recency_fit, round(source_authority * 0.3::double + study_design_strength * 0.25::double + mt * 0.2::double + ci * 0.15::double + rf * 0.1::double, 4) AS q_total FROM p),
judged AS (SELECT *, CASE WHEN is_retracted THEN 'retracted_or_invalidated' WHEN {str(preprints).lower()} AND is_preprint THEN 'preprint_excluded' WHEN year < {first} OR year > {last} THEN 'outside_requested_timeframe'
  WHEN {_any('both_', S.EMPIRICAL_SIGNALS)} AND NOT {_any('low', S.METHODS_PRESENT)} AND methods_transparency < 0.35 THEN 'missing_methodological_metadata' WHEN q_total < 0.6 THEN 'quality_below_threshold' END AS reject_reason FROM scored)
"""


def _claims_sql() -> str:
    from ..functions import extraction as X
    from ..functions.text import CLAIM_STOP_WORDS

    return f""",
cut AS (SELECT study_id, unnest(list_filter(list_transform(string_split(regexp_replace(abstract, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')) AS sentence, generate_subscripts(list_filter(list_transform(string_split(regexp_replace(abstract, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> ''), 1) - 1 AS at_ FROM studies),
lowered AS (SELECT *, lower(sentence) AS l FROM cut),
claims AS (SELECT study_id, at_, sentence, coalesce(nullif(array_to_string(list_filter(regexp_split_to_array(regexp_replace(l, '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND NOT list_contains({_LIST(CLAIM_STOP_WORDS + X.EFFECT_TERMS)}, w))[1:6], ' '), ''), 'outcome') AS outcome,
  CASE WHEN {_any('l', X.NULL_TERMS)} THEN 'neutral' WHEN {_count('l', X.POSITIVE_TERMS)} > {_count('l', X.NEGATIVE_TERMS)} THEN 'positive' WHEN {_count('l', X.NEGATIVE_TERMS)} > {_count('l', X.POSITIVE_TERMS)} THEN 'negative' ELSE 'neutral' END AS direction
  FROM lowered WHERE {_any('l', X.EFFECT_TERMS)})"""


#: FNV-1a over the characters of a text, 32 bits in eight hex digits.
_FNV = "lpad(lower(to_hex(list_reduce(list_prepend(2166136261::bigint, list_transform(range(1, length({0}) + 1), lambda i: unicode(substr({0}, i, 1))::bigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295))), 8, '0')"


def _fold(claims: str) -> str:
    """CTEs that put the rows (search, study_id, ord, at_, sentence, outcome) of ``claims`` into
    clusters, one claim after the other: ``picked`` (search, i, study_id, at_, cluster from 1)."""
    return f""",
steps AS (SELECT search, study_id, at_, row_number() OVER (PARTITION BY search ORDER BY ord, at_)::int AS i, list_distinct(list_filter(regexp_split_to_array(lower(concat(outcome, ' ', sentence)), '[^a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains(['a','an','and','are','as','at','by','for','from','in','is','it','of','on','or','that','the','to','with'], w))) AS tokens FROM {claims}),
fold AS (SELECT DISTINCT search, 0 AS i, []::varchar[][] AS sets, []::int[] AS picks FROM steps UNION ALL
  SELECT search, i, CASE WHEN pick > len(sets) THEN list_append(sets, tokens) ELSE list_transform(sets, lambda s, j: CASE WHEN j = pick THEN list_distinct(list_concat(s, tokens)) ELSE s END) END, list_append(picks, pick)
  FROM (SELECT *, CASE WHEN list_max(scores) >= 0.42::double THEN list_position(scores, list_max(scores)) ELSE len(sets) + 1 END::int AS pick
    FROM (SELECT f.search, s.i, s.tokens, f.sets, f.picks, list_transform(f.sets, lambda x: len(list_intersect(x, s.tokens))::double / len(list_distinct(list_concat(x, s.tokens)))) AS scores FROM fold f JOIN steps s ON s.search = f.search AND s.i = f.i + 1))),
picked AS (SELECT s.search, s.i, study_id, at_, f.picks[s.i] AS cluster FROM steps s JOIN (SELECT search, arg_max(picks, i) AS picks FROM fold GROUP BY search) f ON f.search = s.search)"""


def _searched_sql() -> str:
    """Ranked papers, claims in clusters (``clustered``), clusters and stances of each search."""
    return (_quality_sql(1900, 2100, False) + _claims_sql()).replace("WITH", "WITH RECURSIVE", 1) + """,
ranked AS (SELECT *, (study_id // 50)::varchar AS search, row_number() OVER (PARTITION BY study_id // 50 ORDER BY q_total DESC, citation_count DESC, study_id) AS rank FROM judged WHERE reject_reason IS NULL),
kept_claims AS (SELECT r.search, r.rank AS ord, c.*, instr(r.abstract, c.sentence) - 1 AS char_start FROM claims c JOIN ranked r ON r.study_id = c.study_id)""" + _fold("kept_claims") + f""",
clustered AS (SELECT k.*, p.cluster, row_number() OVER (PARTITION BY k.search, p.cluster ORDER BY ord, k.at_) AS nth, concat_ws(':', k.study_id, char_start, char_start + length(sentence), {_FNV.format('sentence')}) AS cited FROM kept_claims k JOIN picked p ON p.search = k.search AND p.study_id = k.study_id AND p.at_ = k.at_),
counted AS (SELECT search, cluster, count(*) AS claims, count(*) FILTER (direction = 'positive') AS positive, count(*) FILTER (direction = 'negative') AS negative, count(*) FILTER (direction = 'neutral') AS neutral, arg_min(outcome, nth) AS label, arg_min(concat(study_id, '|', sentence), nth) AS opening FROM clustered GROUP BY ALL),
clusters AS (SELECT *, concat('cluster_', {_FNV.format('opening')}) AS cluster_id, CASE WHEN positive > 0 AND negative > 0 THEN 'conflicting' WHEN positive > 0 AND neutral = 0 THEN 'consensus_positive' WHEN negative > 0 AND neutral = 0 THEN 'consensus_negative' ELSE 'mixed' END AS disposition FROM counted),
stances AS (SELECT c.search, c.study_id, CASE WHEN min(disposition) = max(disposition) THEN min(disposition) ELSE 'mixed' END AS proposition FROM clustered c JOIN clusters k ON k.search = c.search AND k.cluster = c.cluster GROUP BY ALL)"""


UNDERSTOOD = _questions_sql()
LOG = "WITH log AS (SELECT event_id AS call_id, event_type AS provider, ts, event_id % 9 <> 0 AS ok, (event_id % 1000)::double AS latency_ms FROM events)"
QUERIES = {
    f.__name__: f
    for f in (
        query_understanding, query_compilation, query_first_version, query_benchmark, search_fan_out, search_rank_candidates, search_expand_citations, citation_counts, provider_coverage,
        provider_health, search_canonicalize, search_quality_filter, search_kept, claims_direction, claims_clusters, claims_propositions, claims_greedy, evidence_table, evidence_brief, search_funnel, request_bounds, own_rows, claim_offsets, marked_terms,
    )
}
ORACLE_SQL = {
    "query_understanding": UNDERSTOOD + "SELECT query_id, normalized, array_to_string(terms, '|') AS terms, array_to_string(added, '|') AS added, array_to_string(reasons, '|') AS reasons, confidence FROM judged",
    "query_compilation": UNDERSTOOD + "SELECT query_id, " + ", ".join(f"{_source_sql(s)} AS {s}_query" for s in search.SOURCE_BUDGETS) + " FROM understood",
    "query_benchmark": UNDERSTOOD + """, q AS (SELECT query_id, concat(normalized, ' ', array_to_string(added, ' ')) AS corpus FROM understood),
m AS (SELECT query_id, (contains(corpus, 'placebo')::int + contains(corpus, 'sleep')::int)::bigint AS matched_expected, (contains(corpus, 'sleep quality')::int + contains(corpus, 'better than')::int)::bigint AS matched_forbidden FROM q)
SELECT *, matched_expected = 2 AND matched_forbidden = 0 AS passed FROM m""",
    "search_fan_out": STUDIES + " SELECT study_id, source, CASE source WHEN 'semantic_scholar' THEN 0 WHEN 'openalex' THEN 1 WHEN 'pubmed' THEN 2 ELSE 3 END AS provider_ordinal, round(1.0::double / row_number() OVER (PARTITION BY source ORDER BY study_id), 6) AS rank_signal FROM studies WHERE length(abstract) > 50",
    "search_rank_candidates": STUDIES + f" SELECT study_id, round(3.0::double * {_count('lower(concat(title, chr(32), abstract))', KEYWORDS)} + least(length(abstract) / 2000.0::double, 1) + least(log10(1.0::double + citation_count) / 3, 1), 4) AS candidate_score FROM studies ORDER BY candidate_score DESC, study_id LIMIT 2000",
    "search_expand_citations": STUDIES + """, seeds AS (SELECT o_orderkey AS citing, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS seed_rank FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20),
refs AS (SELECT seed_rank, l_partkey AS cited FROM lineitem JOIN seeds ON citing = l_orderkey ORDER BY seed_rank, cited LIMIT 60)
SELECT cited, min(seed_rank) AS seed_rank FROM refs WHERE cited IN (SELECT study_id FROM studies WHERE length(abstract) >= 50) GROUP BY cited""",
    "citation_counts": "SELECT l_partkey AS cited, count(*) AS citations, count(DISTINCT l_orderkey) AS citing_works FROM lineitem GROUP BY l_partkey",
    "provider_coverage": LOG + " SELECT count(DISTINCT provider) AS queried, count(DISTINCT provider) FILTER (NOT ok) AS failed, array_to_string(list_sort(list(DISTINCT provider) FILTER (NOT ok)), ',') AS failed_providers, count(*) FILTER (NOT ok) > 0 AS degraded FROM log",
    "provider_health": LOG + " SELECT provider, count(*) AS calls, round(avg((NOT ok)::int::double), 4) AS error_rate, round(avg(latency_ms), 2) AS latency_ms, arg_max(ok, (ts, call_id)) AS last_ok FROM log GROUP BY provider",
    "search_canonicalize": PAPERS.replace("WITH", "WITH RECURSIVE", 1) + f""",
sets AS (SELECT paper_id, doi, pubmed_id, arxiv_id, year, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains({_LIST(_stop("CLAIM_STOP_WORDS"))}, w))) AS tk, list_distinct(list_filter(regexp_split_to_array(lower(names), '[^a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains({_LIST(_stop("CLAIM_STOP_WORDS"))}, w))) AS nm FROM papers),
numbered AS (SELECT *, row_number() OVER (ORDER BY paper_id)::int AS k FROM sets),
keyed AS (SELECT k, 0 AS kind, doi AS key FROM numbered UNION ALL SELECT k, 1, pubmed_id FROM numbered UNION ALL SELECT k, 2, arxiv_id FROM numbered),
before AS (SELECT k, kind, lag(k) OVER (PARTITION BY kind, key ORDER BY k) AS prev FROM keyed WHERE key <> ''),
parents AS (SELECT k, arg_min(prev, kind) AS parent FROM before WHERE prev IS NOT NULL GROUP BY k),
pair AS (SELECT a.k AS r, b.k AS t, len(list_intersect(a.tk, b.tk))::double AS s, len(a.tk) + len(b.tk) AS sn, len(list_intersect(a.nm, b.nm))::double AS n, len(a.nm) + len(b.nm) AS nn FROM numbered a JOIN numbered b ON a.k < b.k AND (a.year IS NULL OR b.year IS NULL OR abs(a.year - b.year) <= 1)),
likely AS (SELECT t AS k, list(r ORDER BY r) AS near FROM pair WHERE s / (sn - s) >= 0.78::double AND n / (nn - n) >= 0.2::double GROUP BY t),
steps AS (SELECT k, paper_id, year, parent, coalesce(near, []) AS near FROM numbered LEFT JOIN parents USING (k) LEFT JOIN likely USING (k)),
fold AS (SELECT 0 AS k, []::int[] AS roots, []::int[] AS years UNION ALL
  SELECT k, list_append(roots, root), CASE WHEN root = k THEN list_append(years, year) WHEN years[root] IS NULL AND year IS NOT NULL THEN list_append(list_transform(years, lambda y, i: CASE WHEN i = root THEN year ELSE y END), NULL) ELSE list_append(years, NULL) END
  FROM (SELECT s.k, s.year, f.roots, f.years, coalesce(f.roots[s.parent], list_filter(s.near, lambda r: f.roots[r] = r AND (f.years[r] IS NULL OR s.year IS NULL OR abs(f.years[r] - s.year) <= 1))[1], s.k) AS root FROM fold f JOIN steps s ON s.k = f.k + 1)),
found AS (SELECT unnest(roots) AS root, generate_subscripts(roots, 1) AS k FROM fold WHERE k = (SELECT count(*) FROM papers)),
member AS (SELECT s.paper_id, g.paper_id AS group_id FROM found JOIN steps s USING (k) JOIN steps g ON g.k = found.root)
SELECT group_id, arg_min(title, paper_id) AS title, arg_min(year, paper_id) FILTER (year IS NOT NULL) AS year, md5(arg_min(abstract, paper_id) FILTER (abstract <> '')) AS abstract, arg_min(venue, paper_id) FILTER (venue IS NOT NULL) AS venue, arg_min(given, paper_id) FILTER (given IS NOT NULL) AS doi, arg_min(pubmed_id, paper_id) FILTER (pubmed_id IS NOT NULL) AS pubmed_id,
  arg_min(arxiv_id, paper_id) FILTER (arxiv_id IS NOT NULL) AS arxiv_id, max(citation_count)::bigint AS citation_count, bool_or(is_retracted) AS is_retracted, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, max(conf) AS source_authority, string_agg(concat(paper_id, ':', source), ',' ORDER BY paper_id) AS provenance,
  array_to_string(list_sort(list(DISTINCT refs)), ',') AS referenced, round(sum((rank_signal * conf)::decimal(18,8)), 4)::double AS relevance
FROM (SELECT *, CASE source WHEN 'pubmed' THEN 0.98 WHEN 'openalex' THEN 0.92 WHEN 'semantic_scholar' THEN 0.9 WHEN 'crossref' THEN 0.89 ELSE 0.84 END::double AS conf FROM papers JOIN member USING (paper_id)) GROUP BY group_id""",
    "search_quality_filter": _quality_sql(1995, 2020, True) + "SELECT study_id, source_authority, study_design_strength, methods_transparency, citation_impact, recency_fit, q_total, reject_reason FROM judged",
    "search_kept": _quality_sql(1900, 2100, False) + "SELECT study_id, row_number() OVER (ORDER BY q_total DESC, citation_count DESC, study_id) AS rank, citation_count FROM judged WHERE reject_reason IS NULL QUALIFY rank <= 2000",
    "claims_direction": STUDIES + _claims_sql() + " SELECT study_id, at_::bigint AS at, sentence, outcome, direction FROM claims".replace(" AS at,", ' AS "at",'),
    "claims_clusters": _searched_sql() + " SELECT search, cluster - 1 AS cluster, cluster_id, label, claims, positive, negative, neutral, disposition FROM clusters".replace("cluster - 1", "(cluster - 1)::bigint"),
    "claims_propositions": _searched_sql() + " SELECT * FROM stances",
    "claims_greedy": (STUDIES + _claims_sql()).replace("WITH", "WITH RECURSIVE", 1) + ", all_claims AS (SELECT *, (study_id // 50)::varchar AS search, study_id AS ord FROM claims)" + _fold("all_claims") + ' SELECT search AS batch, study_id, at_::int AS "at", (cluster - 1)::int AS cluster FROM picked',
    "evidence_table": _searched_sql() + """
SELECT r.search, rank, r.study_id, title, year, CASE WHEN r.study_id % 2 = 0 THEN concat('10.5555/', r.study_id) END AS doi, CASE WHEN r.study_id % 5 = 1 THEN concat('pm', r.study_id) END AS pubmed_id, CASE WHEN r.study_id % 5 = 2 THEN r.study_id::varchar END AS arxiv_id,
  source_authority, study_design_strength, methods_transparency, citation_impact, recency_fit, q_total, CASE WHEN length(s) <= 280 THEN s ELSE concat(substr(s, 1, 279), '...') END AS snippet, coalesce(proposition, 'mixed') AS proposition, concat_ws(':', source, r.study_id, source_authority) AS provenance
FROM (SELECT *, trim(regexp_replace(abstract, '\\s+', ' ', 'g')) AS s FROM ranked WHERE rank <= 200) r LEFT JOIN stances t ON t.search = r.search AND t.study_id = r.study_id""",
    "evidence_brief": _searched_sql() + f""",
o AS (SELECT search, count(*) AS n, string_agg(concat_ws(':', study_id, 0, least(160, length(abstract)), {_FNV.format("concat(study_id, '|overview')")}), ',' ORDER BY rank) FILTER (rank <= 3) AS cited FROM ranked GROUP BY search),
heads AS (SELECT search, cluster, string_agg(cited, ',' ORDER BY nth) AS cited, string_agg(cited, ',' ORDER BY nth) FILTER (nth <= 2) AS two FROM clustered WHERE nth <= 3 GROUP BY ALL),
placed AS (SELECT c.*, h.cited, h.two, row_number() OVER (PARTITION BY c.search ORDER BY claims DESC, c.cluster) AS place, row_number() OVER (PARTITION BY c.search, disposition ORDER BY claims DESC, c.cluster) AS torn FROM clusters c JOIN heads h ON h.search = c.search AND h.cluster = c.cluster)
SELECT search, 0::bigint AS position, concat('The search retained ', n, ' quality-screened studies after multi-source retrieval and strict filtering.') AS text, 'neutral' AS stance, cited AS citations FROM o
UNION ALL SELECT search, place, CASE disposition WHEN 'conflicting' THEN concat('Evidence for ', label, ' is conflicting across the retrieved studies, with both positive and negative directions reported.') WHEN 'consensus_positive' THEN concat('Most studies indicate a positive association for ', label, '.')
  WHEN 'consensus_negative' THEN concat('Most studies indicate a negative association for ', label, '.') ELSE concat('Findings related to ', label, ' are mixed and likely context-dependent.') END, CASE disposition WHEN 'conflicting' THEN 'conflicting' WHEN 'consensus_positive' THEN 'positive' WHEN 'consensus_negative' THEN 'negative' ELSE 'mixed' END, cited FROM placed WHERE place <= 3
UNION ALL SELECT search, (SELECT least(3, count(*)) FROM clusters k WHERE k.search = p.search) + 1, 'At least one major proposition remains unresolved, so conclusions should be interpreted with explicit uncertainty.', 'conflicting', array_to_string(string_split(string_agg(two, ',' ORDER BY torn), ',')[1:3], ',') FROM placed p WHERE disposition = 'conflicting' AND torn <= 2 GROUP BY search
UNION ALL SELECT search, 1, 'No high-confidence effect statements were extractable from abstracts, so interpretation remains limited.', 'neutral', cited FROM o WHERE search NOT IN (SELECT search FROM clusters)""",
    "query_first_version": f"""WITH questions AS ({_QUESTIONS}),
n AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(trim(query), '\\b(better|best|worse|worst|superior|inferior)\\b', 'associated with', 'gi'), '\\b(more|less)\\s+(effective|efficient|beneficial)\\b', 'outcomes of', 'gi'), '\\beffects?\\s+of\\b', 'reported outcomes associated with', 'gi') AS q2,
  list_filter(regexp_split_to_array(regexp_replace(lower(query), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '' AND NOT list_contains({_LIST(_stop("RETRIEVAL_STOP_WORDS"))}, w)) AS kw FROM questions)
SELECT query_id, trim(q2) AS normalized, array_to_string({_distinct('kw')}[1:8], '|') AS keywords, array_to_string(list_filter(regexp_split_to_array(lower(query), '[^a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains({_LIST(_stop("UI_STOP_WORDS"))}, w)), '|') AS marked FROM n""",
    "request_bounds": """WITH r AS (SELECT p_partkey AS request_id, p_name, greatest(1900, least(2100, p_size * 60))::int AS f, CASE WHEN p_partkey % 3 > 0 THEN p_size * 50 + 500 ELSE 2100 END AS t, CASE WHEN p_partkey % 2 > 0 THEN p_partkey * 7 ELSE 2000 END AS c, p_size FROM part)
SELECT request_id, trim(p_name) AS query, f AS from_year, greatest(f, greatest(1900, least(2100, t)))::int AS to_year, greatest(100, least(5000, c))::int AS max_candidates, greatest(10, least(500, p_size))::int AS max_rows FROM r""",
    "own_rows": "SELECT o_custkey AS user_id, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)",
    "claim_offsets": STUDIES + _claims_sql() + ", o AS (SELECT c.study_id, c.at_, instr(s.abstract, c.sentence) - 1 AS b, length(c.sentence) AS n FROM cut c JOIN studies s ON s.study_id = c.study_id) SELECT study_id, at_::bigint AS \"at\", b::bigint AS char_start, (b + n)::bigint AS char_end FROM o",
    "marked_terms": STUDIES + " SELECT study_id, len(list_filter(string_split(regexp_replace(abstract, '(placebo|sleep|steel)', chr(1) || '\\1' || chr(1), 'gi'), chr(1)), lambda x: x <> '')) AS segments, len(regexp_extract_all(abstract, '(placebo|sleep|steel)', 0, 'i')) AS hits, true AS whole FROM studies",
    "search_funnel": _quality_sql(1900, 2100, False) + "SELECT count(*) AS retrieved, count(*) FILTER (length(abstract) > 50) AS eligible, count(*) FILTER (reject_reason IS NULL) AS kept, count(reject_reason) AS rejected FROM judged",
}

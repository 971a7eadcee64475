"""Queries of metadata enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, text as T
from ..operators import enrich, titles
from ..views import duck, view
from .search import PAPERS, papers


def records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Studies, and references of two sources that repeat two studies of three, slightly changed,
    one in seven in both; one in five has an identifier on both sides."""
    s = view(spark, sf_dir, "studies")
    doi = F.when(F.col("study_id") % 5 == 0, F.concat(F.lit("10.5555/"), F.col("study_id").cast("string")))
    base = s.select(F.col("study_id").alias("id"), doi.alias("doi"), "title", F.array(F.lit("Lee A"), F.concat(F.lit("Kim "), F.col("study_id").cast("string"))).alias("authors"), "year", F.col("source").alias("venue"), "citation_count", "source", F.when(F.col("study_id") % 4 > 0, "Journal of Sleep").alias("journal"))
    of = F.when(F.col("id") % 7 == 0, F.array(F.lit("crossref"), F.lit("openalex"))).when(F.col("id") % 4 < 2, F.array(F.lit("crossref"))).otherwise(F.array(F.lit("openalex")))
    changed = base.where("id % 3 <> 0").withColumn("provider", F.explode(of)).withColumns(
        {"title": F.when(F.col("id") % 2 == 0, F.upper("title")).otherwise(F.concat("title", F.lit(" revised"))), "year": (F.col("year") + F.col("id") % 3 - 1).cast("int"), "citation_count": F.col("citation_count") + 7, "journal": F.when(F.col("id") % 2 == 0, "JOURNAL OF SLEEP").otherwise("Annals"), "id": F.col("id") * 2 + (F.col("provider") == "openalex").cast("long")}
    )
    return base, changed


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.candidates(*records(spark, sf_dir))


def enrich_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five references of each source whose titles share most with a study's."""
    return enrich.best_titles(*records(spark, sf_dir))


def enrich_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By identifier, else the five best titles; the second source where the first stays below 0.9."""
    return pairs(spark, sf_dir).select("p_id", "r_id", F.col("r_provider").alias("provider"))


def enrich_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidate of each study and what becomes of it."""
    return enrich.best_candidates(pairs(spark, sf_dir)).select("p_id", "r_id", "confidence", "outcome")


def enrich_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many studies each outcome has, not_found where no source has a candidate."""
    best = enrich.best_candidates(pairs(spark, sf_dir)).select(F.col("p_id").alias("id"), "outcome")
    every = records(spark, sf_dir)[0].select("id").join(best, "id", "left")
    return every.groupBy(F.coalesce("outcome", F.lit("not_found")).alias("outcome")).agg(F.count(F.lit(1)).alias("papers"))


def enrich_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What accepted candidates fill or replace."""
    return enrich.merged_fields(enrich.best_candidates(pairs(spark, sf_dir)))


def title_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup keys by title, lead author and year."""
    s = view(spark, sf_dir, "studies")
    return s.select("study_id", hashing.title_fingerprint(T.normalize_ascii(F.col("title")), F.lit("lee a"), F.when(F.col("study_id") % 7 > 0, F.col("year"))).alias("lookup_key"))


def title_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H9: titles of one year within a few edits."""
    s = view(spark, sf_dir, "studies").select(F.col("study_id").alias("id"), F.col("year").alias("block"), "title")
    near = titles.edit_pairs(s, s).where("probe_id <> known_id")
    # The longer title of two decides how many edits are allowed, so each pair is found from it.
    return near.select(F.least("probe_id", "known_id").alias("left_id"), F.greatest("probe_id", "known_id").alias("right_id")).distinct()


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies and their repeats by another source, in order of arrival."""
    held = papers(spark, sf_dir)
    number = F.substring("paper_id", 2, 7).cast("long")
    again = F.col("paper_id").startswith("q")
    return held.select((number * 2 + F.when(again, 1 + number % 3 * 2000).otherwise(0)).alias("arrival"), "paper_id", F.when(number % 4 > 0, F.regexp_replace("doi", "^https://doi.org/", "")).alias("doi"), "title", "abstract", "citation_count", "pubmed_id", F.when(again, F.col("paper_id")).alias("openalex_id"))


def legacy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers merged in order of arrival by identifier, sorted-word title or fewest edits."""
    merged = titles.arrival_merge(arriving(spark, sf_dir))
    return merged.select("arrival", "paper_id", "title", "doi", "pubmed_id", "openalex_id", F.md5("abstract").alias("abstract"), F.col("citation_count").cast("long").alias("citation_count"), "papers")


def legacy_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each paper was merged by, and into which."""
    return titles.arrival_parents(arriving(spark, sf_dir)).where("parent is not null").select("arrival", "parent", "reason")


PAIRS = duck("studies") + """,
base AS (SELECT study_id AS id, CASE WHEN study_id % 5 = 0 THEN concat('10.5555/', study_id) END AS doi, title, ['lee a', concat('kim ', study_id)] AS authors, year, source AS venue, citation_count, source, CASE WHEN study_id % 4 > 0 THEN 'Journal of Sleep' END AS journal FROM studies),
of AS (SELECT *, unnest(CASE WHEN id % 7 = 0 THEN ['crossref', 'openalex'] WHEN id % 4 < 2 THEN ['crossref'] ELSE ['openalex'] END) AS provider FROM base WHERE id % 3 <> 0),
ref AS (SELECT * REPLACE (CASE WHEN id % 2 = 0 THEN 'JOURNAL OF SLEEP' ELSE 'Annals' END AS journal, CASE WHEN id % 2 = 0 THEN upper(title) ELSE concat(title, ' revised') END AS title, (year + id % 3 - 1)::int AS year, citation_count + 7 AS citation_count, id * 2 + (provider = 'openalex')::bigint AS id) FROM of),
rt AS (SELECT id, provider, unnest(list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains(['a','an','and','are','as','at','by','for','from','in','is','it','of','on','or','that','the','to','with'], w)))) AS token FROM ref),
pt AS (SELECT id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains(['a','an','and','are','as','at','by','for','from','in','is','it','of','on','or','that','the','to','with'], w)))) AS token FROM base),
uses AS (SELECT token, count(*) AS n FROM rt GROUP BY token),
weights AS (SELECT pt.id, pt.token, round(ln(1.0::double + (SELECT count(*) FROM ref) / coalesce(n, 1)::double), 6)::decimal(18,6) AS w FROM pt LEFT JOIN uses USING (token)),
whole AS (SELECT id, sum(w) AS total FROM weights GROUP BY id),
sizes AS (SELECT id, count(*) AS size FROM rt GROUP BY id),
met AS (SELECT w.id AS p_id, r.id AS r_id, r.provider, sum(w.w) AS score FROM weights w JOIN rt r USING (token) GROUP BY ALL),
by_title AS (SELECT p_id, r_id, provider FROM met JOIN whole h ON h.id = p_id JOIN sizes z ON z.id = r_id WHERE score >= total * 0.5 QUALIFY row_number() OVER (PARTITION BY p_id, provider ORDER BY score DESC, size, r_id) <= 5)"""
FOUND = """,
by_doi AS (SELECT p.id AS p_id, r.id AS r_id, provider FROM base p JOIN ref r ON p.doi = r.doi),
crossref AS (SELECT * FROM by_doi WHERE provider = 'crossref' UNION ALL SELECT * FROM by_title WHERE provider = 'crossref' AND p_id NOT IN (SELECT p_id FROM by_doi WHERE provider = 'crossref')),
openalex AS (SELECT * FROM by_doi WHERE provider = 'openalex' UNION ALL SELECT * FROM by_title WHERE provider = 'openalex' AND p_id IN (SELECT id FROM base WHERE doi IS NULL)),
all_pairs AS (SELECT p_id, r_id FROM crossref UNION ALL SELECT p_id, r_id FROM openalex)"""
BEST = PAIRS + FOUND + """,
texts AS (SELECT p_id, r_id, p.doi AS pd, r.doi AS rd, p.year AS py, r.year AS ry, p.citation_count AS pc, r.citation_count AS rc, r.provider, p.source AS ps, p.journal AS pj, r.journal AS rj, p.venue = r.venue AS same_venue,
  trim(regexp_replace(regexp_replace(lower(p.title), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS a, trim(regexp_replace(regexp_replace(lower(r.title), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS b,
  len(list_intersect(p.authors, r.authors))::double / 2 AS au, replace(p.venue, '_', ' ') AS va, replace(r.venue, '_', ' ') AS vb FROM all_pairs JOIN base p ON p.id = p_id JOIN ref r ON r.id = r_id),
sets AS (SELECT *, list_distinct(list_filter(string_split(a, ' '), lambda w: length(w) > 1)) AS ta, list_distinct(list_filter(string_split(b, ' '), lambda w: length(w) > 1)) AS tb,
  list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) AS ga, list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) AS gb,
  list_distinct(string_split(va, ' ')) AS wa, list_distinct(string_split(vb, ' ')) AS wb, list_distinct(list_transform(range(1, length(va)), lambda i: substr(va, i, 2))) AS ha, list_distinct(list_transform(range(1, length(vb)), lambda i: substr(vb, i, 2))) AS hb FROM texts),
sims AS (SELECT *, 0.6::double * (len(list_intersect(ta, tb))::double / (len(ta) + len(tb) - len(list_intersect(ta, tb)))) + 0.4::double * (2.0::double * len(list_intersect(ga, gb)) / (len(ga) + len(gb))) AS ts,
  0.6::double * (len(list_intersect(wa, wb))::double / (len(wa) + len(wb) - len(list_intersect(wa, wb)))) + 0.4::double * (2.0::double * len(list_intersect(ha, hb)) / (len(ha) + len(hb))) AS vs FROM sets),
scored AS (SELECT *, round((least(1, 0.55::double * ts + 0.20::double * au + 0.15::double * CASE abs(py - ry) WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0 END::double + 0.10::double * vs + CASE WHEN pd = rd THEN 0.1 ELSE 0 END::double))::decimal(18,10), 4)::double AS confidence, CASE provider WHEN 'crossref' THEN 0.89 ELSE 0.92 END::double AS trust FROM sims),
pairs AS (SELECT * FROM scored WHERE provider = 'crossref' OR p_id NOT IN (SELECT p_id FROM scored WHERE provider = 'crossref' AND confidence >= 0.9)),
best AS (SELECT *, CASE WHEN confidence >= 0.9 THEN 'accepted' WHEN confidence >= 0.75 THEN 'deferred' ELSE 'rejected' END AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY p_id ORDER BY confidence DESC, trust DESC, r_id) AS place FROM pairs) WHERE place = 1)"""
LEGACY = PAPERS.replace("WITH ", "WITH RECURSIVE ", 1) + """,
arriving AS (SELECT substr(paper_id, 2, 7)::bigint * 2 + CASE WHEN paper_id LIKE 'q%' THEN 1 + substr(paper_id, 2, 7)::bigint % 3 * 2000 ELSE 0 END AS arrival, paper_id, CASE WHEN substr(paper_id, 2, 7)::bigint % 4 > 0 THEN doi END AS doi, title, abstract, citation_count, pubmed_id, CASE WHEN paper_id LIKE 'q%' THEN paper_id END AS openalex_id FROM papers),
keys AS (SELECT arrival, nullif(trim(lower(doi)), '') AS doi, array_to_string(list_sort(list_filter(string_split_regex(regexp_replace(lower(title), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')), ' ') AS key FROM arriving),
known AS (SELECT key, min(arrival) AS first FROM keys GROUP BY key),
exact AS (SELECT *, lag(arrival) OVER (PARTITION BY key ORDER BY arrival) AS by_title, CASE WHEN doi IS NOT NULL THEN lag(arrival) OVER (PARTITION BY doi ORDER BY arrival) END AS by_doi FROM keys),
fuzzy AS (SELECT e.arrival, arg_min(k.key, {'d': levenshtein(e.key, k.key), 'first': k.first}) AS key FROM exact e JOIN known k ON k.first < e.arrival WHERE e.by_doi IS NULL AND e.by_title IS NULL AND levenshtein(e.key, k.key) <= CASE WHEN length(e.key) <= 40 THEN 2 ELSE 3 END GROUP BY e.arrival),
edited AS (SELECT f.arrival, max(k.arrival) AS by_edits FROM fuzzy f JOIN keys k ON k.key = f.key AND k.arrival < f.arrival GROUP BY f.arrival),
parents AS (SELECT arrival, coalesce(by_doi, by_title, by_edits) AS parent, CASE WHEN by_doi IS NOT NULL THEN 'doi_match' WHEN by_title IS NOT NULL THEN 'title_exact' WHEN by_edits IS NOT NULL THEN 'title_fuzzy' END AS reason FROM exact LEFT JOIN edited USING (arrival))"""
QUERIES = {f.__name__: f for f in (enrich_titles, enrich_candidates, enrich_best, enrich_outcomes, enrich_merge, title_fingerprints, title_edits, legacy_dedup, legacy_reasons)}
ORACLE_SQL = {
    "enrich_titles": PAIRS + " SELECT * FROM by_title",
    "enrich_candidates": BEST + " SELECT p_id, r_id, provider FROM pairs",
    "enrich_best": BEST + " SELECT p_id, r_id, confidence, outcome FROM best",
    "enrich_outcomes": BEST + " SELECT coalesce(outcome, 'not_found') AS outcome, count(*) AS papers FROM base LEFT JOIN best ON id = p_id GROUP BY ALL",
    "enrich_merge": BEST + """, ev AS (SELECT *, trust * confidence AS e, CASE ps WHEN 'pubmed' THEN 0.98 WHEN 'openalex' THEN 0.92 WHEN 'semantic_scholar' THEN 0.9 WHEN 'arxiv' THEN 0.84 END::double * 0.8::double AS own, outcome = 'accepted' AS ok FROM best),
w AS (SELECT *, CASE WHEN ok AND pd IS NULL AND rd IS NOT NULL THEN 'filled' END AS wd, CASE WHEN ok AND abs(py - ry) = 1 AND e >= own + 0.05::double THEN 'higher_evidence' END AS wy,
  CASE WHEN ok AND pj IS NULL THEN 'filled' WHEN ok AND lower(pj) = lower(rj) AND pj <> rj AND e >= own + 0.03::double THEN 'higher_evidence' END AS wj, CASE WHEN ok AND rc > pc THEN 'max_trusted' END AS wc FROM ev)
SELECT p_id, outcome, CASE WHEN wd IS NOT NULL THEN rd ELSE pd END AS doi, CASE WHEN wy IS NOT NULL THEN ry ELSE py END AS year, CASE WHEN wj IS NOT NULL THEN rj ELSE pj END AS journal, CASE WHEN wc IS NOT NULL THEN greatest(pc, rc) ELSE pc END::integer AS citation_count,
  concat_ws('|', 'doi=' || wd, 'year=' || wy, 'journal=' || wj, 'citation_count=' || wc, CASE WHEN pd <> rd THEN 'doi=doi_conflict' END) AS fields_applied, concat_ws('|', CASE WHEN pd <> rd THEN 'doi_conflict' END, CASE WHEN abs(py - ry) > 1 THEN 'year_out_of_range' END) AS reasons FROM w""",
    "title_fingerprints": duck("studies") + " SELECT study_id, sha1(concat(trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '|lee a|', CASE WHEN study_id % 7 > 0 THEN year::varchar ELSE 'na' END)) AS lookup_key FROM studies",
    "title_edits": duck("studies") + " SELECT a.study_id AS left_id, b.study_id AS right_id FROM studies a JOIN studies b ON a.year = b.year AND a.study_id < b.study_id WHERE levenshtein(a.title, b.title) <= CASE WHEN greatest(length(a.title), length(b.title)) <= 40 THEN 2 ELSE 3 END",
    "legacy_dedup": LEGACY + """,
walk AS (SELECT arrival, parent AS at FROM parents WHERE parent IS NOT NULL UNION ALL SELECT w.arrival, p.parent FROM walk w JOIN parents p ON p.arrival = w.at WHERE p.parent IS NOT NULL),
roots AS (SELECT a.arrival, coalesce(min(w.at), a.arrival) AS root FROM arriving a LEFT JOIN walk w USING (arrival) GROUP BY a.arrival)
SELECT root AS arrival, arg_min(paper_id, arrival) AS paper_id, arg_min(title, arrival) AS title, arg_min(doi, arrival) FILTER (doi <> '') AS doi, arg_min(pubmed_id, arrival) FILTER (pubmed_id <> '') AS pubmed_id, arg_min(openalex_id, arrival) FILTER (openalex_id <> '') AS openalex_id,
  md5(arg_max(abstract, {'n': length(abstract), 'first': -arrival}) FILTER (abstract <> '')) AS abstract, max(citation_count)::bigint AS citation_count, count(*) AS papers FROM arriving JOIN roots USING (arrival) GROUP BY root""",
    "legacy_reasons": LEGACY + " SELECT arrival, parent, reason FROM parents WHERE parent IS NOT NULL",
}

"""Queries of record deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import doi as D
from ..functions import text as T
from ..functions.hashing import fnv1a
from ..operators import dedup, slices
from ..storage import materialise
from ..views import RUN_TS, duck, table, view

#: An earlier state of the corpus: only records updated before this time.
EARLIER = "2024-01-01 00:00:00"


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.normalize_records(view(spark, sf_dir, "publications"), RUN_TS)


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised records with the keys of their groups, written once: several steps read them."""
    rows = materialise(normalized(spark, sf_dir), "normalized")
    links = materialise(dedup.fuzzy_links(rows), "links")
    return materialise(dedup.with_clusters(rows, dedup.fuzzy_groups(rows, links)), "clustered")


def dedup_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers and keys of every record."""
    return normalized(spark, sf_dir).select("record_id", "doi_norm", "doi_is_valid", "authors_norm", "fingerprint", "key_type", "dedup_key", F.col("source_trust").cast("double").alias("source_trust"), F.col("source_rank").cast("long").alias("source_rank"))


def dedup_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 to M4: the parts of each record's quality."""
    doubles = [F.round(c, 4).cast("double").alias(c) for c in ("completeness", "recency", "citation_signal")]
    return normalized(spark, sf_dir).select("record_id", *doubles, F.round("quality", 1).cast("double").alias("quality"))


def dedup_elect_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical record of each key."""
    best = dedup.elect_canonical(normalized(spark, sf_dir))
    return best.select("canonical_id", "key_type", "dedup_key", "record_id", "source")


def dedup_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical record that each duplicate points to."""
    rows = normalized(spark, sf_dir)
    links = dedup.duplicate_links(rows, dedup.elect_canonical(rows))
    return links.select("record_id", "canonical_record_id", "key_type", F.col("confidence").cast("double").alias("confidence"))


def dedup_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed since an earlier state of the corpus."""
    rows = normalized(spark, sf_dir)
    before = dedup.elect_canonical(rows.where(F.col("source_updated_at") < F.lit(EARLIER).cast("timestamp_ntz")))
    # Records whose id ends in 7 have been withdrawn since.
    return dedup.audit(before, dedup.elect_canonical(rows.where("record_id not like '%7'")))


def dedup_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: the share of earlier canonical records that changed."""
    rows = normalized(spark, sf_dir)
    before = dedup.elect_canonical(rows.where(F.col("source_updated_at") < F.lit(EARLIER).cast("timestamp_ntz")))
    return dedup.churn(before, dedup.elect_canonical(rows)).select("canonicals", "changed", F.col("churn_pct").cast("double").alias("churn_pct"))


def dedup_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the incremental window that are still there."""
    pubs = view(spark, sf_dir, "publications")
    fresh = dedup.in_window(pubs, "2024-10-01 00:00:00").where("not is_deleted")
    return dedup.without_orphans(fresh, pubs.where("record_id not like '%3'")).select("record_id", "source")


def dedup_fuzzy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy duplicates among records without a valid identifier."""
    edges = dedup.fuzzy_edges(normalized(spark, sf_dir))
    return edges.select("a", "b", F.col("similarity").cast("double").alias("similarity"), F.col("author_overlap").cast("double").alias("author_overlap"))


def dedup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of fuzzy duplicates, their keys and confidence."""
    rows = materialise(normalized(spark, sf_dir), "normalized")
    links = materialise(dedup.fuzzy_links(rows), "links")
    groups = dedup.fuzzy_groups(rows, links)
    return groups.select("record_id", "root", "group_size", "cluster_key", F.col("confidence").cast("double").alias("confidence"))


def dedup_duplicate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of duplicates by source, over both kinds of key."""
    rows = clustered(spark, sf_dir)
    rates = dedup.duplicate_rate(rows, dedup.duplicate_links(rows, dedup.elect_canonical(rows)))
    return rates.select("source", "records", "duplicates", F.col("rate").cast("double").alias("rate"))


def dedup_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A3: share without identifiers and share matched by fingerprint."""
    rows = clustered(spark, sf_dir)
    found = dedup.coverage(rows, dedup.duplicate_links(rows, dedup.elect_canonical(rows)))
    return found.select("records", F.col("pct_missing_doi").cast("double").alias("pct_missing_doi"), F.col("pct_fallback_matched").cast("double").alias("pct_fallback_matched"))


def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records four apart and each record with the last one before it of the same text, expected
    to be duplicates where their whole texts are equal."""
    name = lambda i: F.concat(F.lit("doc-"), F.lpad(i.cast("string"), 6, "0"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    other = docs.select((F.col("doc_id") - 4).alias("doc_id"), F.col("digest").alias("next_digest"))
    apart = docs.join(other, "doc_id").select(name(F.col("doc_id")).alias("left_id"), name(F.col("doc_id") + 4).alias("right_id"), (F.col("digest") == F.col("next_digest")).alias("expected"))
    before = slices.latest_before(docs.withColumn("own", F.col("doc_id")), "digest", "doc_id", "own").where("latest <> doc_id - 4")
    return apart.unionByName(before.select(name(F.col("latest")).alias("left_id"), name(F.col("doc_id")).alias("right_id"), F.lit(True).alias("expected")))


def dedup_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall on labelled pairs, by identifier and fingerprint keys."""
    found = dedup.precision_recall(labelled_pairs(spark, sf_dir), normalized(spark, sf_dir))
    return found.select("tp", "fp", "fn", "samples", F.col("precision_pct").cast("double").alias("precision_pct"), F.col("recall_pct").cast("double").alias("recall_pct"))


def identifier_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identifier normalisers side by side."""
    raw = F.col("raw_doi")
    return view(spark, sf_dir, "publications").select("record_id", D.retrieval_doi(raw).alias("retrieval"), D.enrichment_doi(raw).alias("enrichment"), D.download_doi(raw).alias("download"), D.is_valid_doi(D.enrichment_doi(raw)).alias("valid"))


def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text keys of every record."""
    title = F.col("title")
    return view(spark, sf_dir, "publications").select("record_id", T.normalize_ascii(title).alias("ascii_key"), T.sorted_title_key(title).alias("sorted_key"), fnv1a(title).alias("fnv"))


NORM = duck("publications") + """,
base AS (SELECT *, regexp_replace(regexp_replace(lower(trim(raw_doi)), '^(https?://(dx\\.)?doi\\.org/)+', ''), '^doi:\\s*', '') AS d0,
  regexp_replace(regexp_replace(lower(trim(title)), '[[:punct:]]+', ' ', 'g'), '\\s+', ' ', 'g') AS t0,
  array_to_string(list_transform(authors[1:3], lambda a: trim(regexp_replace(regexp_replace(lower(trim(a)), '[[:punct:]]+', ' ', 'g'), '\\s+', ' ', 'g'))), '|') AS authors_norm FROM publications),
norm0 AS (SELECT *, nullif(regexp_replace(regexp_replace(regexp_replace(d0, '\\s+', '', 'g'), '^[[:punct:]]+', ''), '[[:punct:]]+$', ''), '') AS doi_norm, nullif(trim(t0), '') AS title_norm FROM base),
norm1 AS (SELECT *, coalesce(regexp_matches(doi_norm, '^10\\.[0-9]{4,9}/[-._;()/:a-z0-9]+$'), false) AS doi_is_valid,
  sha256(concat(coalesce(title_norm, ''), '|', coalesce(authors_norm, ''), '|', coalesce(pub_year::varchar, ''))) AS fingerprint,
  CASE source WHEN 'pubmed' THEN 0.98 WHEN 'openalex' THEN 0.92 WHEN 'semantic_scholar' THEN 0.9 WHEN 'crossref' THEN 0.89 WHEN 'arxiv' THEN 0.84 ELSE 0.5 END::decimal(4,3) AS source_trust,
  CASE source WHEN 'pubmed' THEN 1 WHEN 'openalex' THEN 2 WHEN 'semantic_scholar' THEN 3 WHEN 'crossref' THEN 4 WHEN 'arxiv' THEN 5 ELSE 9999 END AS source_rank,
  ((trim(title) <> '')::int + 1 + 1 + coalesce((trim(raw_doi) <> '')::int, 0) + (citation_count > 0)::int)::decimal(6,5) / 5 AS completeness0,
  greatest(0, least(1, exp(-(epoch_us(timestamp '2024-12-31 00:00:00') - epoch_us(source_updated_at)) / 1000000.0::double / 31557600)))::decimal(6,5) AS recency,
  least(1, ln(1 + citation_count::double) / ln(501.0::double))::decimal(6,5) AS citation_signal FROM norm0),
norm AS (SELECT *, completeness0::decimal(6,5) AS completeness,
  round(100 * (0.40::decimal(3,2) * completeness0::decimal(6,5) + 0.30::decimal(3,2) * source_trust::decimal(6,5) + 0.20::decimal(3,2) * recency + 0.10::decimal(3,2) * citation_signal), 2)::decimal(5,2) AS quality,
  CASE WHEN doi_is_valid THEN 'doi' ELSE 'fingerprint' END AS key_type, CASE WHEN doi_is_valid THEN doi_norm ELSE concat('fp:', fingerprint) END AS dedup_key FROM norm1)"""
ELECT = NORM + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY key_type, dedup_key ORDER BY quality DESC, source_updated_at DESC, source_rank, record_id) AS place FROM norm WHERE NOT is_deleted),
canon AS (SELECT sha256(concat('canon:', key_type, ':', dedup_key)) AS canonical_id, * FROM ranked WHERE place = 1)"""
BEFORE = ELECT + """,
old AS (SELECT sha256(concat('canon:', key_type, ':', dedup_key)) AS canonical_id, record_id AS was FROM
  (SELECT *, row_number() OVER (PARTITION BY key_type, dedup_key ORDER BY quality DESC, source_updated_at DESC, source_rank, record_id) AS place FROM norm WHERE NOT is_deleted AND source_updated_at < timestamp '2024-01-01 00:00:00') WHERE place = 1)"""
EDGES = NORM + """,
held AS (SELECT record_id, pub_year, authors_norm, fingerprint, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(title_norm), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''),
  lambda w: list_transform(range(1, length(w) + 2), lambda i: substr(concat('  ', w, ' '), i, 3))))) AS grams FROM norm WHERE key_type = 'fingerprint' AND NOT is_deleted),
pairs AS (SELECT a.record_id AS a, b.record_id AS b, len(list_intersect(a.grams, b.grams))::double AS shared, len(a.grams) AS na, len(b.grams) AS nb,
  list_distinct(list_filter(string_split(a.authors_norm, '|'), lambda x: x <> '')) AS xa, list_distinct(list_filter(string_split(b.authors_norm, '|'), lambda x: x <> '')) AS xb
  FROM held a JOIN held b ON a.pub_year IS NOT DISTINCT FROM b.pub_year AND a.record_id < b.record_id),
edges AS (SELECT a, b, (shared / (na + nb - shared))::decimal(4,3) AS similarity, round(len(list_intersect(xa, xb))::double / least(len(xa), len(xb)), 3) AS author_overlap FROM pairs
  WHERE na > 0 AND nb > 0 AND shared / (na + nb - shared) >= 0.92::double AND len(list_intersect(xa, xb))::double / least(len(xa), len(xb)) >= 0.5)"""
GROUPS = EDGES.replace("WITH publications", "WITH RECURSIVE publications", 1) + """,
graph AS (SELECT a AS x, b AS y FROM edges UNION ALL SELECT b, a FROM edges),
walk AS (SELECT record_id AS node, record_id AS root FROM held UNION SELECT g.y, w.root FROM walk w JOIN graph g ON g.x = w.node),
member AS (SELECT node AS record_id, min(root) AS root FROM walk GROUP BY node),
summary AS (SELECT m.root, count(*) AS group_size, min(h.fingerprint) AS least_fp FROM member m JOIN held h USING (record_id) GROUP BY m.root),
nearest AS (SELECT x AS record_id, max(similarity) AS s FROM (SELECT a AS x, similarity FROM edges UNION ALL SELECT b, similarity FROM edges) GROUP BY x),
grouped AS (SELECT m.record_id, m.root, s.group_size, concat('fp:', sha256(s.least_fp)) AS cluster_key,
  CASE WHEN s.group_size = 1 THEN 1.000 ELSE greatest(0.920::decimal(4,3), n.s) END::decimal(4,3) AS confidence FROM member m JOIN summary s ON s.root = m.root LEFT JOIN nearest n ON n.record_id = m.record_id)"""
LINKED = GROUPS + """,
keyed AS (SELECT n.* REPLACE (coalesce(g.cluster_key, n.dedup_key) AS dedup_key) FROM norm n LEFT JOIN grouped g ON g.record_id = n.record_id),
places AS (SELECT *, first_value(record_id) OVER (PARTITION BY key_type, dedup_key ORDER BY quality DESC, source_updated_at DESC, source_rank, record_id) AS best FROM keyed WHERE NOT is_deleted)"""

QUERIES = {
    f.__name__: f
    for f in (
        dedup_normalize, dedup_quality, dedup_elect_canonical, dedup_links, dedup_audit, dedup_churn, dedup_incremental, dedup_fuzzy_edges,
        dedup_components, dedup_duplicate_rate, dedup_coverage, dedup_precision_recall, identifier_forms, text_keys,
    )
}
ORACLE_SQL = {
    "dedup_normalize": NORM + " SELECT record_id, doi_norm, doi_is_valid, authors_norm, fingerprint, key_type, dedup_key, source_trust::double AS source_trust, source_rank::bigint AS source_rank FROM norm",
    "dedup_quality": NORM + " SELECT record_id, round(completeness, 4)::double AS completeness, round(recency, 4)::double AS recency, round(citation_signal, 4)::double AS citation_signal, round(quality, 1)::double AS quality FROM norm",
    "dedup_elect_canonical": ELECT + " SELECT canonical_id, key_type, dedup_key, record_id, source FROM canon",
    "dedup_links": ELECT + " SELECT n.record_id, c.record_id AS canonical_record_id, n.key_type, 1.0::double AS confidence FROM norm n JOIN canon c USING (key_type, dedup_key) WHERE NOT n.is_deleted AND n.record_id <> c.record_id",
    "dedup_audit": BEFORE + """, now_ AS (SELECT sha256(concat('canon:', key_type, ':', dedup_key)) AS canonical_id, record_id FROM
  (SELECT *, row_number() OVER (PARTITION BY key_type, dedup_key ORDER BY quality DESC, source_updated_at DESC, source_rank, record_id) AS place FROM norm WHERE NOT is_deleted AND record_id NOT LIKE '%7') WHERE place = 1)
SELECT coalesce(n.canonical_id, o.canonical_id) AS canonical_id, CASE WHEN n.canonical_id IS NULL THEN 'deactivated' WHEN o.was IS NULL THEN 'elected' ELSE 're_elected' END AS decision, o.was AS previous_record_id, n.record_id
FROM now_ n FULL JOIN old o ON n.canonical_id = o.canonical_id WHERE n.record_id IS DISTINCT FROM o.was""",
    "dedup_churn": BEFORE + " SELECT count(*) AS canonicals, count(*) FILTER (c.record_id IS DISTINCT FROM o.was) AS changed, round(100.0::double * count(*) FILTER (c.record_id IS DISTINCT FROM o.was) / count(*), 3) AS churn_pct FROM old o LEFT JOIN canon c ON c.canonical_id = o.canonical_id",
    "dedup_incremental": duck("publications") + " SELECT record_id, source FROM publications WHERE source_updated_at >= timestamp '2024-10-01 00:00:00' AND NOT is_deleted AND record_id NOT LIKE '%3'",
    "dedup_fuzzy_edges": EDGES + " SELECT a, b, similarity::double AS similarity, author_overlap FROM edges",
    "dedup_components": GROUPS + " SELECT record_id, root, group_size, cluster_key, confidence::double AS confidence FROM grouped",
    "dedup_duplicate_rate": LINKED + " SELECT source, count(*) AS records, count(*) FILTER (record_id <> best) AS duplicates, round(100.0::double * count(*) FILTER (record_id <> best) / count(*), 3) AS rate FROM places GROUP BY source",
    "dedup_coverage": LINKED + " SELECT count(*) AS records, round(100.0::double * count(*) FILTER (NOT doi_is_valid) / count(*), 3) AS pct_missing_doi, round(100.0::double * count(*) FILTER (key_type = 'fingerprint' AND record_id <> best) / count(*), 3) AS pct_fallback_matched FROM places",
    "dedup_precision_recall": NORM + """, d AS (SELECT doc_id, text, lag(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS before FROM documents),
near AS (SELECT a.doc_id AS i, b.doc_id AS j, a.text = b.text AS e FROM d a JOIN d b ON b.doc_id = a.doc_id + 4 UNION ALL SELECT before, doc_id, true FROM d WHERE before <> doc_id - 4),
labelled AS (SELECT concat('doc-', lpad(i::varchar, 6, '0')) AS l, concat('doc-', lpad(j::varchar, 6, '0')) AS r, e FROM near),
judged AS (SELECT e, concat(x.key_type, ':', x.dedup_key) = concat(y.key_type, ':', y.dedup_key) AS s FROM labelled JOIN norm x ON x.record_id = l JOIN norm y ON y.record_id = r),
n AS (SELECT count(*) FILTER (s AND e) AS tp, count(*) FILTER (s AND NOT e) AS fp, count(*) FILTER (NOT s AND e) AS fn, count(*) AS samples FROM judged)
SELECT *, round(100.0::double * tp / nullif(tp + fp, 0), 3) AS precision_pct, round(100.0::double * tp / nullif(tp + fn, 0), 3) AS recall_pct FROM n""",
    "identifier_forms": duck("publications") + r""", r AS (SELECT record_id, raw_doi, regexp_replace(lower(trim(raw_doi)), '^https?://(dx\.)?doi\.org/', '') AS retrieval FROM publications),
e AS (SELECT *, nullif(trim(regexp_replace(retrieval, '^doi:\s*', '')), '') AS enrichment FROM r)
SELECT record_id, retrieval, enrichment, trim(regexp_replace(trim(raw_doi), '^https?://(dx\.)?doi\.org/', '', 'i')) AS download, coalesce(regexp_matches(enrichment, '^10\.[0-9]{4,9}/[-._;()/:a-z0-9]+$', 'i'), false) AS valid FROM e""",
    "text_keys": duck("publications") + r""", p AS (SELECT record_id, title AS t FROM publications)
SELECT record_id, trim(regexp_replace(regexp_replace(lower(t), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS ascii_key,
  array_to_string(list_sort(list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{N}]+'), lambda w: w <> '')), ' ') AS sorted_key,
  lpad(lower(to_hex(list_reduce(list_prepend(2166136261::bigint, list_transform(range(1, length(t) + 1), lambda i: unicode(substr(t, i, 1))::bigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295))), 8, '0') AS fnv FROM p""",
}

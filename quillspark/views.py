"""Scholarly views over the given tables, each as Spark SQL and as DuckDB SQL.

The tables hold invented prose; the views derive publications, studies and events from them, so
every query's work grows with the tables it reads.  A publication's title is its text's first
sentence, its identifier, year and second author follow from the whole text, its first author from
the title.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The time that scores are anchored to, and the year that counts as current.
RUN_TS = "2024-12-31 00:00:00"
CURRENT_YEAR = 2024

_PUBLICATIONS = """
SELECT concat('doc-', lpad(cast(d.doc_id AS string), 6, '0')) AS record_id,
  {sources} AS source,
  {updated} AS source_updated_at,
  CASE d.doc_id % 4
    WHEN 0 THEN concat('https://doi.org/10.', cast(1000 + {length} % 97 AS string), '/', upper(substr(d.of_text, 1, 10)))
    WHEN 1 THEN concat('doi: 10.', cast(1000 + {length} % 97 AS string), '/', substr(d.of_text, 1, 10))
    WHEN 2 THEN NULL ELSE 'not-a-doi' END AS raw_doi,
  d.opening AS title,
  {array}(concat('a', substr({sha}(d.opening{bits}), 1, 2)), concat('b', substr(d.of_text, 3, 2))) AS authors,
  cast(1990 + ({code}(substr(d.of_text, 1, 1)) * 31 + {code}(substr(d.of_text, 2, 1)) * 7 + {code}(substr(d.of_text, 3, 1))) % 35 AS int) AS pub_year,
  cast(d.n_chars % 501 AS int) AS citation_count,
  coalesce(l.toxic = 1, false) AS is_deleted
FROM (SELECT {kept}, regexp_extract(text, '^[^.!?\\n]*[.!?]?', 0) AS opening, {sha}(text{bits}) AS of_text FROM documents) d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""

_STUDIES = """
SELECT p_partkey AS study_id, concat(p_name, ' trial ', p_partkey) AS title, cast(1990 + p_size % 35 AS int) AS year,
  concat('Methods: ',
  CASE p_partkey % 5 WHEN 0 THEN concat('n=', 20 + p_size*7, ' adults') WHEN 1 THEN concat(20 + p_size*7, ' participants') ELSE 'patients' END,
  CASE p_partkey % 4 WHEN 0 THEN ' were randomized' WHEN 1 THEN ' were followed in a cohort' WHEN 2 THEN ' answered a cross-sectional survey' ELSE ' were observed' END, '. ',
  p_name, ' versus placebo ', CASE p_partkey % 3 WHEN 0 THEN 'improved' WHEN 1 THEN 'decreased' ELSE 'changed' END, ' sleep quality',
  CASE WHEN p_partkey % 2 = 0 THEN concat(' (OR = ', 1 + p_size % 9, '.', p_partkey % 10, ')') ELSE '' END,
  CASE WHEN p_partkey % 7 < 4 THEN concat(' with p = 0.0', 1 + p_partkey % 9) ELSE '' END, '.') AS abstract,
  CASE p_partkey % 4 WHEN 0 THEN 'pubmed' WHEN 1 THEN 'openalex' WHEN 2 THEN 'semantic_scholar' ELSE 'arxiv' END AS source,
  cast(p_partkey % 300 AS int) AS citation_count, p_partkey % 50 = 0 AS is_retracted,
  CASE WHEN p_partkey % 4 = 3 THEN 'Preprint' ELSE 'Peer-reviewed' END AS preprint_status,
  CASE p_partkey % 6 WHEN 0 THEN 'RCT' WHEN 1 THEN 'cohort' WHEN 2 THEN 'cross-sectional' WHEN 3 THEN 'review' ELSE 'unknown' END AS study_design,
  CASE p_partkey % 3 WHEN 0 THEN cast(10 + p_size * 3 AS int) END AS sample_size,
  CASE p_partkey % 5 WHEN 0 THEN 'Adult volunteers' WHEN 1 THEN 'Clinical patients' WHEN 2 THEN 'Children and adolescents' WHEN 3 THEN 'Residents' END AS population,
  CASE p_partkey % 11 WHEN 0 THEN 'no outcomes reported' WHEN 1 THEN '' ELSE concat('sleep quality scores ', p_type) END AS outcome_measured,
  CASE p_partkey % 3 WHEN 0 THEN concat('improved versus placebo caused by ', p_name) WHEN 1 THEN 'no significant difference was found' ELSE 'higher risk, worsened symptoms' END AS key_result,
  CASE WHEN p_partkey % 2 = 0 THEN concat('OR = ', 1 + p_size % 9) END AS effect_size
FROM part
"""

SPARK = {
    "publications": _PUBLICATIONS.format(
        sources="element_at(array('pubmed','openalex','semantic_scholar','crossref','arxiv','unlisted'), cast(d.doc_id % 6 AS int) + 1)",
        updated="timestampadd(DAY, cast((d.doc_id * 37) % 700 AS int), timestamp_ntz'2023-01-01 00:00:00')",
        sha="sha2", bits=",256", array="array", code="ascii",
        # The join with labels moves these rows, without the whole text.
        kept="doc_id, n_chars, length(text) AS text_length", length="d.text_length",
    ),
    "studies": _STUDIES,
}
DUCK = {
    "publications": _PUBLICATIONS.format(
        sources="(['pubmed','openalex','semantic_scholar','crossref','arxiv','unlisted'])[cast(d.doc_id % 6 AS int) + 1]",
        updated="timestamp '2023-01-01 00:00:00' + to_days(cast((d.doc_id * 37) % 700 AS int))",
        sha="sha256", bits="", array="list_value", code="unicode",
        kept="*", length="length(d.text)",
    ),
    "studies": _STUDIES,
}
_NEEDS = {"publications": ["documents", "labels"], "studies": ["part"]}
#: Narrow tables whose rows become much work each, and their keys.
_SPREAD = {"part": "p_partkey"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt over all cores by ``key``: a narrow table of millions of rows may be one row
    group, which a single task would read and take all the way to the first shuffle."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def parts_of(df: DataFrame, rows: int = 500_000) -> int:
    """The tasks to deal ``df`` to so that each gets about ``rows`` rows: narrow rows are packed so well
    that adaptive execution would give one task many millions of them, to sort in memory."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view; its tables are passed by reference, so sessions keep no names."""
    held = {t: table(spark, sf_dir, t) for t in _NEEDS[name]}
    return spark.sql(_bound(SPARK[name], _NEEDS[name]), **{t: spread(df, _SPREAD[t]) if t in _SPREAD else df for t, df in held.items()})


def _bound(sql: str, tables: list[str]) -> str:
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return sql


def duck(*names: str) -> str:
    """The opening of a DuckDB query that uses these views."""
    return "WITH " + ",\n".join(f"{n} AS ({DUCK[n]})" for n in names)

"""The deduplication run and the search, from end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, search, studies
from ..sources import writers
from ..storage import materialise


def dedup_run(records: DataFrame, base: str, run_id: str, run_ts: str, pairs: DataFrame | None = None, since: str | None = None) -> dict[str, DataFrame]:
    """Normalise, group, elect and link ``records``, then publish below ``base`` if the gate of
    labelled ``pairs`` lets it; the audit log gets the run's start and end either way.

    With ``since`` only records touched since then are normalised anew; the others keep their
    row of the published snapshot, recency included.  Returns the snapshot's tables.
    """
    spark = records.sparkSession

    def log(event: str, detail: str = "") -> None:
        row = spark.createDataFrame([(run_id, event, detail)], "run_id string, event string, detail string")
        writers.append_events(row, f"{base}/audit", by="run_id")

    log("RUN_STARTED")
    try:
        fresh = dedup.normalize_records(dedup.in_window(records, since), run_ts)
        if since is not None:
            kept = writers.published(spark, f"{base}/normalized").join(fresh.select("record_id"), "record_id", "left_anti")
            fresh = dedup.without_orphans(kept.unionByName(fresh), records)
        rows = materialise(fresh, "normalized")
        links = materialise(dedup.fuzzy_links(rows), "links")
        keyed = materialise(dedup.with_clusters(rows, dedup.fuzzy_groups(rows, links)), "keyed")
        canonical = materialise(dedup.elect_canonical(keyed), "canonical")
        out = {"normalized": rows, "canonical": canonical, "links": dedup.duplicate_links(keyed, canonical)}
        if pairs is not None:
            metrics = dedup.precision_recall(pairs, keyed)
            dedup.gate(metrics)
            out["metrics"] = metrics
        for name, df in out.items():
            writers.publish(df, f"{base}/{name}", run_id)
    except Exception as e:
        log("RUN_FAILED", str(e)[:500])
        raise
    log("RUN_COMPLETED")
    return out


def serving_view(spark: SparkSession, base: str, name: str = "records_serving") -> DataFrame:
    """The published canonical records as a temporary view."""
    view = writers.published(spark, f"{base}/canonical").select("canonical_id", "key_type", "dedup_key", "record_id", "source", "title", "authors", "pub_year", "quality")
    view.createOrReplaceTempView(name)
    return view


def answer(papers: DataFrame, question: str, current_year: int, rows: int = 200, candidates: int = 2000) -> dict[str, DataFrame]:
    """From a question to ranked evidence: understand, rank, score, filter, claims, extraction.

    ``papers`` is a studies-like table (study_id, title, abstract, year, source, citation_count,
    is_retracted, preprint_status).
    """
    spark = papers.sparkSession
    plan = search.understand(spark.createDataFrame([(question,)], "query string")).select("normalized", "terms", "confidence").first()
    ranked = search.rank_candidates(search.eligible(papers), list(plan["terms"]), candidates)
    scored = materialise(search.score_papers(ranked, current_year), "scored")
    kept = search.kept_papers(scored).withColumn("search", F.lit("0"))
    clustered = materialise(search.clustered_claims(search.anchored_claims(kept, "search"), "search"), "clustered")
    clusters = search.claim_clusters(clustered, "search")
    evidence = search.evidence_table(kept, search.propositions(clustered, clusters, "search"), "search", rows).drop("search")
    brief = search.evidence_brief(kept, clustered, clusters, "search").drop("search")
    extracted = studies.tier(studies.studies(kept.limit(45)))
    funnel = scored.agg(F.count(F.lit(1)).alias("ranked"), F.count_if(F.col("reject_reason").isNull()).alias("kept"))
    return {"evidence": evidence, "brief": brief, "studies": extracted, "funnel": funnel}

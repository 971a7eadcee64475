import datetime

import pytest

from quillspark.operators import dedup
from quillspark.plans import runs
from quillspark.sources import writers
from quillspark.views import RUN_TS

SCHEMA = "record_id string, source string, source_updated_at timestamp_ntz, raw_doi string, title string, authors array<string>, pub_year int, citation_count int, is_deleted boolean"


def records(spark, deleted=()):
    day = datetime.datetime(2024, 12, 1)
    abc, lkn = ["Smith J", "Jones R", "Lee A"], ["Lee A", "Kim B", "Ng C"]
    rows = [
        ("d-openalex", "openalex", "https://doi.org/10.7777/ALPHA.1", "Primary outcome analysis for chronic pain treatment", abc, 2024, 120),
        ("d-semantic", "semantic_scholar", "10.7777/alpha.1", "Primary outcome analysis for chronic pain treatment", abc, 2024, 15),
        ("d-arxiv", "arxiv", "doi:10.7777/alpha.1", "Primary outcome analysis for chronic pain treatment", abc, 2024, 0),
        ("f-1", "openalex", None, "Effect of Omega-3 on pain in adults", lkn, 2023, 30),
        ("f-2", "semantic_scholar", None, "Effect of omega 3 on pain in adults", lkn, 2023, 10),
        ("f-3", "semantic_scholar", None, "Completely different oncology cohort outcomes", lkn, 2023, 10),
    ]
    return spark.createDataFrame([(r[0], r[1], day, r[2], r[3], r[4], r[5], r[6], r[0] in deleted) for r in rows], SCHEMA)


def test_run_publishes_and_logs(spark, tmp_path):
    base = f"file://{tmp_path}"
    out = runs.dedup_run(records(spark), base, "full_1", RUN_TS)
    best = {r["record_id"] for r in out["canonical"].collect()}
    assert "d-openalex" in best and len(best & {"f-1", "f-2"}) == 1 and "f-3" in best
    links = {(r["record_id"], r["canonical_record_id"]) for r in writers.published(spark, f"{base}/links").collect()}
    assert {("d-semantic", "d-openalex"), ("d-arxiv", "d-openalex")} <= links and len(links) == 3
    assert {r["event"] for r in spark.read.parquet(f"{base}/audit").collect()} == {"RUN_STARTED", "RUN_COMPLETED"}
    assert runs.serving_view(spark, base).count() == 3


def test_deleted_record_loses_its_place(spark):
    rows = dedup.normalize_records(records(spark, {"d-openalex"}), RUN_TS)
    best = {r["record_id"] for r in dedup.elect_canonical(rows).collect()}
    assert "d-semantic" in best and "d-openalex" not in best


def test_gate_keeps_the_earlier_snapshot(spark, tmp_path):
    base = f"file://{tmp_path}"
    runs.dedup_run(records(spark), base, "full_1", RUN_TS)
    wrong = spark.createDataFrame([("f-1", "f-3", True)], "left_id string, right_id string, expected boolean")
    with pytest.raises(ValueError):
        runs.dedup_run(records(spark, {"f-2"}), base, "full_2", RUN_TS, pairs=wrong)
    assert spark.read.text(f"{base}/canonical/current").first()["value"] == "full_1"


def test_components_close_over_chains(spark):
    from quillspark.operators.graph import components

    chain = spark.range(200).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(500, 501)], "a long, b long"))
    rows = components(chain).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["component"], set()).add(r["node"])
    assert sorted(map(len, groups.values())) == [2, 201]
    assert components(chain.where("false")).count() == 0

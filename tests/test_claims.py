"""Clusters, stances, table and brief of small searches, written out."""

from quillspark.functions.hashing import fnv1a
from quillspark.operators import search
from pyspark.sql import functions as F

ROWS = [
    ("a", 1, 1, "First", "We slept. Drug eases pain in adults improved strongly. Drug eases pain in adults reduced strongly."),
    ("a", 2, 2, "Second", "Drug eases pain in adults improved greatly."),
    ("a", 3, 3, "Third", ""),
    ("b", 4, 1, "Alone", "Nothing to say here."),
]


def made(spark):
    ranked = spark.createDataFrame(ROWS, "search string, study_id long, rank int, title string, abstract string").withColumns({"year": F.lit(2001), "source": F.lit("pubmed"), "q_total": F.lit(0.7)})
    clustered = search.clustered_claims(search.anchored_claims(ranked, "search"), "search")
    return ranked, clustered, search.claim_clusters(clustered, "search")


def digest(spark, text):
    return spark.range(1).select(fnv1a(F.lit(text))).first()[0]


def test_brief_and_table_of_searches(spark):
    ranked, clustered, clusters = made(spark)
    found = clusters.collect()
    assert [(r["search"], r["cluster"], r["claims"], r["positive"], r["negative"], r["disposition"]) for r in found] == [("a", 0, 3, 2, 1, "conflicting")]
    assert found[0]["cluster_id"] == "cluster_" + digest(spark, "1|Drug eases pain in adults improved strongly.")
    rows = {(r["search"], r["position"]): r for r in search.evidence_brief(ranked, clustered, clusters, "search").collect()}
    assert sorted(rows) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)]
    assert rows["a", 1]["text"] == search.BRIEF["conflicting"][0] % found[0]["label"] and rows["a", 2]["text"] == search.UNRESOLVED and rows["b", 1]["text"] == search.NOTHING
    places = [(c["paper"], c["char_start"], c["char_end"]) for c in rows["a", 1]["citations"]]
    texts = {str(r[1]): r[4] for r in ROWS}
    assert [texts[p][s:e] for p, s, e in places] == ["Drug eases pain in adults improved strongly.", "Drug eases pain in adults reduced strongly.", "Drug eases pain in adults improved greatly."]
    assert all(c["snippet_hash"] == digest(spark, texts[c["paper"]][c["char_start"] : c["char_end"]]) for c in rows["a", 1]["citations"])
    assert [(c["paper"], c["char_start"], c["char_end"]) for c in rows["a", 0]["citations"]] == [("1", 0, 98), ("2", 0, 43), ("3", 0, 5)]
    assert len(rows["a", 2]["citations"]) == 2 and len(rows["b", 1]["citations"]) == 1
    stances = search.propositions(clustered, clusters, "search")
    table = {r["study_id"]: r for r in search.evidence_table(ranked, stances, "search").collect()}
    assert {k: (r["proposition"], r["snippet"]) for k, r in table.items() if k > 2} == {3: ("mixed", "Third"), 4: ("mixed", "Nothing to say here.")}
    assert table[1]["proposition"] == "conflicting" and table[1]["provenance"]["metadata_confidence"] == 0.98


def test_no_papers(spark):
    ranked, _, _ = made(spark)
    none = ranked.where("false")
    clustered = search.clustered_claims(search.anchored_claims(none, "search"), "search")
    clusters = search.claim_clusters(clustered, "search")
    assert clusters.count() == 0 and search.evidence_brief(none, clustered, clusters, "search").count() == 0


def test_searches_are_clustered_on_all_cores_each_in_its_order(spark):
    claims = [(f"s{b}", k, 0, "pain", t) for b in range(40) for k, t in enumerate(["drug eases pain quickly", "exercise helps sleep", "drug eases pain slowly", "exercise helps deep sleep"])]
    found = spark.createDataFrame(claims, "search string, study_id long, at int, outcome string, sentence string")
    got = search.greedy_clusters(found.orderBy(F.desc("study_id")), "search")
    assert sorted(map(tuple, got.collect())) == sorted((f"s{b}", k, 0, k % 2) for b in range(40) for k in range(4))
    assert sum(n > 0 for n in got.rdd.glom().map(len).collect()) >= spark.sparkContext.defaultParallelism

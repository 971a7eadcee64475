import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import knn, mixing, urlfilter, warc
from quillspark.llm import queries as Q
from quillspark.llm.common import lookup

from ..oracle import assert_same
from .helpers import odd_documents


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_matches_its_sql(spark, sf, name):
    assert_same(Q.QUERIES[name](spark, sf), Q.ORACLE_SQL[name], sf)


def test_url_rules_and_list(spark):
    urls = [
        ("http://a.example.NET/en/x", "example.net/en/", "allow"),
        ("http://a.example.net/fr/x", "net/", "block"),
        ("http://example.net", None, "allow"),  # an empty path starts with no rule's
        ("http://xexample.com/de/", None, "allow"),
        ("https://b.example.com/de/1?x#y", "example.com/de/", "block"),
        ("ftp://u.org/fr/?q", "org/fr/", "allow"),
        ("http://www.bad.io/p/?a=1#z", None, "block"),
        ("no scheme", None, "allow"),
        ("", None, "allow"),
        (None, None, "allow"),
        ("http:///only/path", None, "allow"),
        ("http://net#x/", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(urls)] + [(6, urls[6][0])], "page_id long, url string")
    listed = spark.createDataFrame([("bad.io/p",), ("bad.io/p",), (None,)], "canonical string")
    rows = urlfilter.judge(pages, Q.URL_RULES, listed).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        assert (r["rule"], r["verdict"]) == urls[r["page_id"]][1:], urls[r["page_id"]]
    assert urlfilter.judge(pages, Q.URL_RULES, listed.where("false")).where("listed").count() == 0
    assert urlfilter.judge(pages.where("false"), Q.URL_RULES, listed).count() == 0


def test_bloom_filter_loses_none(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h/"), F.col("id").cast("string")).alias("canonical"))
    pages = spark.range(9000).select(F.col("id").alias("page_id"), F.concat(F.lit("h/"), F.col("id").cast("string")).alias("canonical"))
    assert urlfilter.listed_pages(pages, "canonical", listed).where("listed = (page_id < 3000)").count() == 9000


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 8)) * np.repeat([1.0, 3.0, 0.01], 300)[:, None]
    x[300:600] = x[300]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [float("nan")] * 8), (902, [1.0, None] + [0.0] * 6), (None, [1.0] * 8), (5, x[5].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = table.select("vec_id", knn.quantised(F.col("embedding")).alias("vector"))
    got = {}
    for r in knn.top_k(vectors, F.col("vec_id") % 100 == 0, 10, block=64).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    q = np.floor(1024 * x).astype(np.int64)
    assert sorted(got) == list(range(0, 900, 100))
    for i, rows in got.items():
        order = sorted((j for j in range(900) if j != i), key=lambda j: (-int(q[i] @ q[j]), j))[:10]
        assert sorted(rows) == [(k + 1, j, int(q[i] @ q[j])) for k, j in enumerate(order)]
    assert knn.top_k(vectors.where("vec_id < 3"), F.col("vec_id") == 0, 10).count() == 2
    assert knn.top_k(vectors.where("false"), F.col("vec_id") == 0, 10).count() == 0


def test_mix_meets_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.schedule(mixing.with_sizes(docs))
    by = rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("size").alias("size"), F.max("size").alias("most")).collect()
    total = sum(r["size"] for r in by)
    assert sum(r["taken"] for r in by) == int(1.5 * total + 0.5)  # truncated at the budget
    assert all(abs(r["taken"] - r["target"]) <= mixing.PACKET + 1 and r["target"] <= 2 * r["size"] + 1e-6 for r in by)
    assert abs(sum(r["target"] for r in by) - 1.5 * sum(r["size"] for r in by)) < 1
    assert rows.where("taken > 2 * size").count() == 0
    mixed = mixing.with_sizes(mixing.mix(docs)).groupBy("source").agg(F.sum("size").alias("n")).collect()
    want = {r["source"]: r for r in by}
    assert all(abs(r["n"] - want[r["source"]]["target"]) <= want[r["source"]]["most"] for r in mixed)


def test_mix_is_ranged_by_finish_time(spark, sf):
    """Against a plain queue: packets in order of finish time until the budget is used up."""
    import hashlib

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.schedule(mixing.with_sizes(docs)).collect()
    order = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s))
    packets = []
    for turn, source in enumerate(order):
        at, own = 0, sorted((r for r in rows if r["source"] == source), key=lambda r: (hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["doc_id"]))
        for r in own * 2:
            for k in range(0, r["size"], mixing.PACKET):
                n = min(mixing.PACKET, r["size"] - k)
                packets.append(((at + k + n) / r["target"], turn, at + k + n, n, r["doc_id"]))
            at += r["size"]
    left, taken = int(1.5 * sum(r["size"] for r in rows) + 0.5), {r["doc_id"]: 0 for r in rows}
    for *_, n, doc in sorted(packets):
        taken[doc] += min(n, left)
        left -= min(n, left)
    assert {r["doc_id"]: r["taken"] for r in rows} == taken
    finish = [r["finish_1"] for r in rows]
    assert min(finish) > 0 and max(finish) <= 2


def test_names_of_the_caller_stay(spark):
    docs = spark.createDataFrame([(k, f"some words of text {k} " * 20, "ab"[k % 2], 99 + k, f"t{k}", -k, "end", "turn") for k in range(40)], "doc_id long, text string, source string, size long, target string, taken long, end string, turn string")
    rows = mixing.mix(docs).collect()
    assert len(rows) == 60 and all((r["size"], r["target"], r["taken"], r["end"], r["turn"]) == (99 + r["doc_id"], f"t{r['doc_id']}", -r["doc_id"], "end", "turn") for r in rows)
    planned = mixing.schedule(mixing.with_sizes(docs))
    assert planned.columns.count("target") == planned.columns.count("taken") == 1 and planned.agg(F.sum("taken")).first()[0] == 40 * 5 * 20 * 1.5


def test_mix_of_odd_documents(spark):
    docs = odd_documents(spark)
    rows = mixing.schedule(mixing.with_sizes(docs))
    assert rows.count() == docs.count() and sorted(map(str, rows.collect())) == sorted(map(str, mixing.schedule(mixing.with_sizes(docs)).collect()))
    assert {c for c in docs.columns} == set(mixing.mix(docs).columns)
    assert mixing.schedule(mixing.with_sizes(docs.where("false"))).count() == 0
    assert mixing.mix(docs.where("false")).count() == 0
    blank = docs.where("doc_id in (2, 3, 4)")
    assert mixing.schedule(mixing.with_sizes(blank)).agg(F.sum("taken")).first()[0] == 0


def test_revisits(spark):
    h = lambda **k: {a.replace("_", "-"): b for a, b in k.items()}
    rows = [
        (1, "http://www.A.com/x/", 10, "response", h(etag="1", content_length="5", server="s")),
        (2, "https://a.com/x?q#f", 20, "response", h(etag="2", content_length="6")),
        (3, "http://a.com/x", 10, "revisit", h(etag="1")),  # none earlier
        (4, "http://a.com/x", 15, "revisit", h(etag="W/1", content_length="0", server="t")),
        (5, "http://a.com/x", 30, "revisit", h(etag="1")),  # the latest has another tag
        (6, "http://a.com/x", 31, "revisit", h(last_modified="m")),
        (7, "http://b.com/", 31, "revisit", None),
        (8, None, 31, "revisit", h(etag="1")),
        (9, "http://a.com/x", None, "revisit", h(etag="1")),
        (10, None, 5, "response", h(etag="1")),
        (4, "http://a.com/x", 15, "revisit", h(etag="W/1", content_length="0", server="t")),
        (11, "http://a.com/x", 12, "other", None),
    ]
    table = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, headers map<string,string>")
    out = [(r["record_id"], r["status"], r["response_id"], r["headers"]) for r in warc.resolve_revisits(table).collect()]
    assert len(out) == 8
    by = {r[0]: r[1:] for r in out}
    assert by[3][0] == by[7][0] == by[8][0] == by[9][0] == "no_response"
    assert by[4] == ("resolved", 1, h(etag="W/1", content_length="5", server="t"))
    assert by[5][:2] == ("validator_mismatch", 2) and by[6][:2] == ("resolved", 2)
    assert warc.resolve_revisits(table.where("false")).count() == 0


def test_popular_responses_and_long_urls(spark):
    """A third of all revisits of one response at one time, a very long and an empty URL."""
    far = "http://a.com/" + "x" * 50_000
    rows = [(1, "http://a.com/x", 10, "response", {"etag": "1"}), (1, "http://a.com/x", 10, "response", {"etag": "0"}), (2, far, 10, "response", {"etag": "2"}), (3, "", 1, "response", {"etag": "3"})]
    rows += [(100 + k, "http://a.com/x" if k % 3 else far if k % 2 else "", 20, "revisit", {"etag": "1"}) for k in range(3000)]
    rows += [(9000 + k, None, 20, "revisit", None) for k in range(50)]
    out = warc.resolve_revisits(spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, headers map<string,string>"))
    got = {(r["status"], r["response_id"]): r["n"] for r in out.groupBy("status", "response_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {("resolved", 1): 2000, ("validator_mismatch", 2): 500, ("validator_mismatch", 3): 500, ("no_response", None): 50}


def test_lookup_of_hot_keys(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    table = spark.range(0, 5000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w")).unionByName(spark.createDataFrame([(7, 1)], "k long, w long"))
    for how in ("inner", "left"):
        assert sorted(map(str, lookup(rows, table, ["k"], how, shares=50).collect())) == sorted(map(str, rows.join(table, "k", how).collect()))

"""Registered queries against independent computations of the whole small table."""

import hashlib
import math
import zlib

import zstandard as zs

from quillspark.llm import quality, urlfilter
from quillspark.llm import queries as Q


def test_op6_payloads(spark, sf):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = Q.op6_media_columns(spark, sf).collect()
    assert len(rows) == len(texts)
    of_text = {}
    for r in rows:
        raw = texts[r["doc_id"]]
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_bytes"] > len(payload) and len(r["media_sha256"]) == 64
        same = of_text.setdefault(raw, (r["media_bytes"], r["media_sha256"], r["feature"]))
        assert same == (r["media_bytes"], r["media_sha256"], r["feature"])


def test_op7_scores_by_hand(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = quality.fit(docs, Q.learnable_labels(spark, sf))
    good, bad = (zs.ZstdCompressor(level=3, dict_data=zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_AUTO), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad))
    want = {}
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        a, b, n = len(good.compress(raw)), len(bad.compress(raw)), len(raw)
        gap, share, length = (b - a) / (a + b), (a + b) / (2 * n + 32), math.log1p(n)
        z = sum(w * x for w, x in zip(model.weights, (1, gap, gap * length, gap * gap, gap * share, share, share * share, length, length * share), strict=True))
        want[r["doc_id"]] = (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0, 1 / (1 + math.exp(-max(-30, min(30, z)))))
    rows = Q.op7_quality_classifier(spark, sf).collect()
    assert len(rows) == len(want)
    for r in rows:
        held, score = want[r["doc_id"]]
        assert r["held_out"] == held and abs(r["score"] - score) < 1e-9 and r["predicted"] == int(r["score"] >= 0.3)
    # Held-out labels aren't among those that may be learned from.
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in Q.learnable_labels(spark, sf).collect())


def test_op3_alike_with_a_filter_too_large_to_broadcast(spark, sf, monkeypatch):
    rows = lambda: sorted(map(tuple, Q.op3_url_filters(spark, sf).collect()))
    few = rows()
    monkeypatch.setattr(urlfilter, "BROADCAST_BLOCKS", 0)
    assert rows() == few


def test_very_long_urls(spark):
    long = "http://bad.io/" + "p" * 500_000
    pages = spark.createDataFrame([(1, long), (2, long + "?q"), (3, long + "x")], "page_id long, url string")
    listed = spark.createDataFrame([("bad.io/" + "p" * 500_000,)], "canonical string")
    assert {r["page_id"]: r["listed"] for r in urlfilter.judge(pages, [], listed).collect()} == {1: True, 2: True, 3: False}

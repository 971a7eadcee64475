import math

import numpy as np

from quillspark.llm import langid, media, quality
from quillspark.llm import queries as Q

from .helpers import odd_documents, prose


def all_segmentations(word, logp, vocab):
    """The sum over every way to cut a marked word into pieces."""
    marked, number = "▁" + word, {p: i for i, p in enumerate(vocab.pieces)}

    def total(at):
        if at == len(marked):
            return 1.0
        out = 0.0
        for end in range(at + 1, len(marked) + 1):
            if marked[at:end] in number:
                out += math.exp(logp[number[marked[at:end]]]) * total(end)
        if marked[at] not in number:
            out += math.exp(-18.0) * total(at + 1)
        return out

    return math.log(total(0))


def test_forward_sums_all_segmentations():
    vocab = langid.index_pieces(["a", "ab", "b", "bc", "abc", "▁a", "▁ab", "▁"])
    logp = np.log(np.random.default_rng(1).dirichlet(np.ones(8), 2).T)
    words = ["a", "abc", "abcab", "bca", "zab", "abcabcabcabcabcabcabc"]
    got = langid.forward(words, vocab, logp)
    for w, row in zip(words, got, strict=True):
        assert np.allclose(row, [all_segmentations(w, logp[:, k], vocab) for k in range(2)])
    assert np.isfinite(langid.forward(["ab" * 5000], vocab, logp)).all()


def test_languages_on_odd_and_held_out_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    odd = {r["doc_id"]: r for r in langid.identify(odd_documents(spark), model).collect()}
    assert [odd[k]["lang_pred"] for k in (2, 3, 4, 7)] == ["und"] * 4
    assert all(0 <= r["score"] <= 1 for r in odd.values())
    signs = spark.createDataFrame([(1, "½ ²"), (2, "①②"), (3, "Ⅷ"), (4, "١٢"), (5, "½ the")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in langid.identify(signs, model).orderBy("doc_id").collect()] == [True] * 4 + [False]
    held = langid.identify(docs.where("doc_id % 2 = 1"), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    nothing = langid.fit(docs.where("false"))
    assert langid.identify(odd_documents(spark), nothing).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(docs.where("false"), model).count() == 0


def test_quality_tells_good_from_bad(spark):
    docs = spark.createDataFrame([(k, prose(k, 120) if k % 3 else " | ".join(w + "###" for w in prose(k, 60).split())) for k in range(240)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(160)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    rows = quality.score(docs.where("doc_id >= 160"), model).collect()
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in rows]) > 0.95
    odd = quality.score(odd_documents(spark), model)
    assert odd.count() == odd_documents(spark).count() and odd.where("score is null or not score between 0 and 1").count() == 0
    assert odd.columns.count("score") == 1


def test_quality_without_labels(spark):
    docs = odd_documents(spark)
    one = quality.fit(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    for model in (one, none):
        assert {0 <= r["score"] <= 1 for r in quality.score(docs, model).collect()} == {True}


def test_media_round_trip(spark):
    docs = odd_documents(spark)
    rows = media.inspect(media.store(docs), carve=True).collect()
    import hashlib
    import zlib

    want = {r["doc_id"]: media.payload_of((r["text"] or "").encode()) for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        payload = want[r["doc_id"]]
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["payload_bytes"] == len(payload)
        assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["kind"] in media.WRITERS and r["corrected"]


def test_every_container_is_sniffed_and_carved():
    import struct

    payload = bytes(range(192)) * 3
    png = b"\x89PNG\r\n\x1a\n"
    for kind, data in ((b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)), (b"IDAT", __import__("zlib").compress(b"\0\1")), (b"IEND", b"")):
        png += struct.pack(">I", len(data)) + kind + data + struct.pack(">I", __import__("zlib").crc32(kind + data))
    gif = b"GIF89a\1\0\1\0\0\0\0," + b"\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
    blobs = [(k, w(payload)) for k, w in media.WRITERS.items()] + [("image/png", png), ("image/gif", gif)]
    for kind, blob in blobs:
        found = media.sniff(b"BM junk P5 RIFF.snd " + blob + b" tail BM")
        assert [(f.kind, f.start, f.end) for f in found] == [(kind, 20, 20 + len(blob))]
        assert media.sniff(blob[:-1]) == []  # cut short: lengths don't hold
    mixed = b"".join(b for _, b in blobs)
    assert [f.kind for f in media.sniff(mixed)] == [k for k, _ in blobs]


def test_media_within_every_container_is_found():
    inner = b"P5 2 2 255 abcd"
    for kind, write in media.WRITERS.items():
        blob = write(media.payload_of(b"some text " + inner + b" and more"))
        at = blob.index(inner)
        assert [(f.kind, f.start, f.end) for f in media.sniff(blob)] == [(kind, 0, len(blob)), ("image/x-portable-graymap", at, at + len(inner))]
    wide = bytearray(media.wav(b"ab" * 96))
    wide[34] = 16
    assert [f.kind for f in media.sniff(bytes(wide))] == ["audio/wav"]


def test_held_out_flags(spark, sf):
    import zlib

    for r in Q.op7_quality_classifier(spark, sf).select("doc_id", "held_out").collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)

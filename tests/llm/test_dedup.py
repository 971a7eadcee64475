import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import chunking, simhash
from quillspark.llm import queries as Q

from .helpers import odd_documents, prose


def brute_components(prints, distance):
    ids = sorted({p for _, p in prints})
    label = {p: p for p in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if label[b] < label[a] and ((a ^ b) & (2**64 - 1)).bit_count() <= distance:
                    label[a], changed = label[b], True
    least = {}
    for d, p in prints:
        if d is not None:
            least[label[p]] = min(least.get(label[p], d), d)
    return [(d, p, least.get(label[p])) for d, p in prints]


def test_fingerprint_by_definition():
    from xxhash import xxh64_intdigest

    text = "One two\tthree FOUR five  two three four five"
    words = text.lower().split()
    hashes = [xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert simhash.text_fingerprint(text.encode()) & (2**64 - 1) == want
    assert simhash.text_fingerprint(b" \t ") == 0
    assert simhash.text_fingerprint(b"A b") & (2**64 - 1) == xxh64_intdigest(b"a b", 42)


def test_components_match_brute_force(spark):
    texts = [prose(k % 40, 60 + k % 40) + (" extra" * (k // 40)) for k in range(160)]
    docs = odd_documents(spark, [(100 + k, t, "en", "a", 1, None, None, None) for k, t in enumerate(texts)])
    got = simhash.near_duplicates(docs).collect()
    want = brute_components([(r["doc_id"], r["simhash"]) for r in got], 4)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert len(got) == docs.count()


def test_links_at_any_distance_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**62), 2**62, 30)
    values = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(63, f, replace=False)) for b in base for f in (0, 1, 3, 5, 7)})
    prints = spark.createDataFrame([(v,) for v in values], "simhash long")
    for distance in (2, 4, 8):
        got = {tuple(r) for r in simhash.links(prints, simhash.search_keys(prints, distance), distance).distinct().collect()}
        want = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= distance}
        assert got == want


def test_similar_documents_keep_clean_ones_apart(spark):
    base = prose(7, 300)
    words = base.split()
    near = " ".join(words[:150] + ["changed"] + words[151:])
    rows = [(1, base, "en", "a", 1, None, None, None), (2, near, "en", "a", 1, None, None, None), (3, prose(8, 300), "en", "a", 1, None, None, None), (4, base, "en", "a", 1, None, None, None), (9, None, None, None, None, None, None, None)]
    docs = odd_documents(spark).where("false").unionByName(spark.createDataFrame(rows, odd_documents(spark).schema))
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 1, 9: 9}
    assert simhash.similar_documents(docs.where("false")).count() == 0


def table_of(spark, texts):
    return spark.createDataFrame([(k, t, "en", "a", len(t), None, None, None) for k, t in texts], odd_documents(spark).schema)


def brute_similar(texts, similarity):
    """The smallest id that each text is linked to, by all pairs."""
    sets = {}
    for k, t in texts:
        w = t.lower().split()
        sets[k] = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    label = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            shared = len(sets[a] & sets[b])
            if a < b and shared >= similarity * len(sets[a] | sets[b]) and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    return label


def test_every_pair_just_over_the_similarity_is_found(spark):
    texts, rng = [], np.random.default_rng(5)
    for k in range(60):
        words = prose(500 + k, 200).split()
        texts.append((10 * k, " ".join(words)))
        for f in (2, 4, 5):  # 4 changes leave some 176 of 216 runs, just over 0.8; 5 just less
            other = list(words)
            for at in rng.choice(range(5, 195, 6), f, replace=False):
                other[at] = f"changed{k}x{at}"
            texts.append((10 * k + f, " ".join(other)))
    want = brute_similar(texts, 0.8)
    assert 60 < len(set(want.values())) < 180
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(table_of(spark, texts)).collect()}
    assert got == want


def test_a_shared_passage_is_one_key(spark):
    passage = prose(700, 120)
    docs = simhash.with_keys(table_of(spark, [(k, passage + " " + prose(701 + k, 30)) for k in range(6)])).drop("doc")
    table = simhash.set_digests(docs, 5).where("bucket is null").localCheckpoint()
    nodes = table.select("node", "n", "bits", "doc_id", "text_key")
    shared = simhash.shared_postings(docs, nodes, np.arange(simhash.BUCKETS, dtype=np.uint64), 5, 0.8)
    many = shared.groupBy("key").agg(F.count(F.lit(1)).alias("nodes"), F.sort_array(F.collect_list("node")).alias("of"), F.count_distinct("node").alias("distinct")).collect()
    assert many and len({tuple(r["of"]) for r in many}) == len(many)  # no two keys of the same nodes
    assert all(r["nodes"] == r["distinct"] > 1 for r in many)


def test_merged_postings_lose_no_pair(spark):
    rng = np.random.default_rng(8)
    given = [(int(n), int(at), int(k)) for k in range(80) for n, at in zip(rng.choice(12, rng.integers(1, 5), replace=False), rng.integers(0, 50, 5), strict=False)]
    got = simhash.merged_postings(spark.createDataFrame([*given, *[(n, at + 1, k + 100) for n, at, k in given]], "node long, at int, key long")).collect()
    at = {(r["key"], r["node"]): r["at"] for r in got}
    assert len(at) == len(got) < len(given)
    by = {}
    for key, node in at:
        by.setdefault(key, []).append(node)
    for n, p, k in given:
        for m, q, other in given:
            if k == other and n < m:
                assert any(n in of and m in of and at[key, n] <= p and at[key, m] <= q for key, of in by.items())


def test_equal_fingerprints_of_different_texts_stay_apart(spark):
    line = "one two three four five\n" * 120
    texts = [(k, line + prose(60 + k, 40)) for k in range(1, 6)] + [(9, line + prose(63, 40) + " end")]
    assert len({simhash.text_fingerprint(t.encode(), 5) for _, t in texts}) == 1
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(table_of(spark, texts)).collect()}
    assert got == brute_similar(texts, 0.8) == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 9: 3}


def test_boundaries_survive_insertions():
    text = prose(1, 400).encode()
    moved = b"some new words stand here " + text
    cuts, after = set(chunking.boundaries(text).tolist()), {c - 26 for c in chunking.boundaries(moved).tolist()}
    assert len(cuts & after) >= 0.9 * len(cuts)
    for raw in (b"", b"x", b"y" * 9000, "東京".encode() * 2000, text):
        ends = chunking.boundaries(raw).tolist()
        assert ends == sorted(set(ends)) and (not raw or ends[-1] == len(raw))
        b"".join(raw[s:e] for s, e in zip([0, *ends], ends, strict=False)).decode()


def test_repeated_passages_go_and_the_first_stays(spark):
    passage = prose(5, 70)
    docs = odd_documents(spark, [(20, prose(10, 90) + " " + passage + " " + prose(11, 90), "en", "a", 1, None, None, None), (21, prose(12, 90) + " " + passage + " " + prose(13, 90), "en", "a", 1, None, None, None), (22, prose(14, 200), "en", "a", 1, None, None, None)])
    spans = chunking.repeated_spans(docs.where("doc_id <> 5")).collect()
    assert {(r["doc_id"], r["first_doc_id"]) for r in spans} == {(21, 20)}
    assert sum(r["words"] for r in spans) >= 45
    out = {r["doc_id"]: r for r in chunking.deduplicate(docs).collect()}
    assert passage in out[20]["text"] and passage not in out[21]["text"]
    assert out[22]["text"] == prose(14, 200) and out[2]["text"] is None and out[3]["text"] == ""
    assert len(out[5]["text"]) < 15_000  # of 150,000: one word over and over
    assert chunking.deduplicate(docs).count() == docs.count()
    assert chunking.repeated_spans(docs.where("false")).count() == 0


def test_spans_match_brute_force_on_the_table(spark, sf):
    got = {(r["doc_id"], r["span_start"], r["span_end"], r["words"]) for r in Q.op9_substring_dedup(spark, sf).collect()}
    docs = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    first, cut = {}, {}
    for d in sorted(docs):
        ends = chunking.boundaries(docs[d]).tolist()
        cut[d] = [(s, e, docs[d][s:e].strip()) for s, e in zip([0, *ends], ends, strict=False)]
        for s, _, c in cut[d]:
            first.setdefault(c, (d, s))
    want = set()
    for d, parts in cut.items():
        run = []
        for s, e, c in [*parts, (None, None, None)]:
            if s is not None and first[c] != (d, s):
                run.append((s, e, len(c.split())))
            else:
                if run and sum(r[2] for r in run) >= 20:
                    want.add((d, run[0][0], run[-1][1], sum(r[2] for r in run)))
                run = []
    assert got == want


def test_op4_query_shape(spark, sf):
    rows = Q.op4_simhash_near_dedup(spark, sf)
    assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert rows.where(~F.col("fingerprint").rlike("^[0-9a-f]{16}$")).count() == 0

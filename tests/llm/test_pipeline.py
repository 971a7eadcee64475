from collections import Counter

import corpus_pipeline as P
from quillspark.llm import quality
from quillspark.llm.queries import learnable_labels

from .helpers import odd_documents, prose


def test_stages_do_their_work(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = []
    for _, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns
        kept.append({r["doc_id"] for r in docs.collect()} if len(kept) < 3 else Counter(r["doc_id"] for r in docs.collect()))
    assert kept[0] > kept[1] >= kept[2] and max(kept[3].values()) == 2
    packed = P.pack_sequences(spark, docs, sf).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == kept[3]


def test_first_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, learnable_labels(spark, sf))
    good = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = list(good)
    import numpy as np

    p = 1 / (1 + np.exp(-quality.features(model, [good[i].encode() for i in ids]) @ np.array(model.weights)))
    want = {i for i, s in zip(ids, p, strict=True) if s >= 0.3}
    first = P.keep_good(spark, docs, sf)
    assert {r["doc_id"] for r in first.collect()} == want

    def shingles(text):
        w = text.encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {i: shingles(good[i]) for i in want}
    kept = {r["doc_id"] for r in P.keep_one_of_near_copies(spark, first, sf).collect()}
    for i in want - kept:  # whatever goes has a close relative among the documents
        assert max(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in want if j != i) >= 0.8
    close = [(i, j) for i in want for j in want if i < j and len(sets[i] & sets[j]) >= 0.9 * len(sets[i] | sets[j])]
    assert all(not {i, j} <= kept for i, j in close)


def test_odd_documents_pass_through(spark, sf):
    docs = odd_documents(spark)
    one = P.keep_one_of_near_copies(spark, docs, sf)
    ids = [r["doc_id"] for r in one.collect()]
    assert len(ids) == len(set(ids)) and {None, 1, 2, 5} <= set(ids) and 3 not in ids
    assert P.cut_repeated_passages(spark, one, sf).columns == docs.columns
    for _, stage in P.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0


def test_run_ends_in_packed_sequences(spark, sf):
    rows = P.run(spark, sf)
    assert rows.where("length > 4096 or offset + length > 4096").count() == 0 and rows.count() > 0


def test_rows_without_or_with_one_id_stay_by_their_texts(spark, sf):
    texts = [(None, prose(31, 80)), (None, prose(32, 80)), (None, prose(32, 80)), (50, prose(33, 80)), (50, prose(34, 80)), (51, prose(34, 80))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t), None, None, None) for i, t in texts], odd_documents(spark).schema)
    kept = sorted((r["text"], str(r["doc_id"])) for r in P.keep_one_of_near_copies(spark, docs, sf).collect())
    assert kept == sorted([(prose(31, 80), "None"), (prose(32, 80), "None"), (prose(33, 80), "50"), (prose(34, 80), "50")])

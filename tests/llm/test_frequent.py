import random

from pyspark.sql import functions as F

from quillspark.llm import chunking
from quillspark.storage import materialise


def corpus(spark):
    """600 texts with one common passage, each with a passage of one other; one row twice, two of no id."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9)))
    passage = lambda n: " ".join(word() for _ in range(n))
    common, pairs = passage(60), [passage(40) for _ in range(300)]
    rows = [(i, " ".join([passage(15), common, passage(15), pairs[i // 2], passage(10)])) for i in range(600)]
    return spark.createDataFrame([*rows, rows[7], (None, rows[8][1]), (None, rows[8][1]), (900, None), (901, "")], "doc_id long, text string")


def test_frequent_and_rare_chunks_by_a_plain_loop(spark):
    docs = corpus(spark)
    table, first, last = chunking.chunks(docs).collect(), {}, {}
    for r in table:
        for d in r["digests"]:
            if r["doc_id"] is not None:
                first[d] = min(first.get(d, r["doc_id"]), r["doc_id"])
            last.setdefault(d, set()).add(r["doc_id"])
    want = set()
    for r in table:
        hits = {(p, first[d]) for d, p in zip(r["digests"], r["places"], strict=True) if d in first and len(last[d]) > 1 and first[d] != r["doc_id"]}
        hits |= {(p, r["doc_id"]) for p in r["places"] if p % 2}
        want |= {(r["doc_id"], r["text_hash"], *span) for span in chunking.runs(iter(hits), 20)}
    got = [tuple(r) for r in chunking.repeated_spans(docs).collect()]
    assert len(want) > 800 and set(got) == want and len(got) == len(want)


def test_frequent_chunks_are_one_row_a_document(spark):
    """The common passage's chunks are some 8,000 rows of a join, but 600 rows of lists."""
    table = materialise(chunking.chunks(corpus(spark)), "chunks")
    each = table.select("doc_id", F.explode("digests").alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("n"))
    rows = chunking._frequent(table, each.where("n > 500").select("digest", "first_doc_id")).collect()
    assert len(rows) == 602 and all(len(r["hits"]) > 5 and {h["first_doc_id"] for h in r["hits"]} == {0} for r in rows)
    assert chunking._frequent(table, each.where("false").select("digest", "first_doc_id")).count() == 0

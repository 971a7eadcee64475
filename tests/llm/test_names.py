"""Callers' columns that are named as the library's own come back as they were."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import chunking, mixing

from .helpers import prose

NAMES = "text_key row_key _text _row doc k component none node n bits bucket uses simhash prefix _hash _held _id _spans hash held id spans c0 c1 digests places".split()
MIXED = "mix_key mix_slice mix_source mix_turn mix_end mix_at mix_name mix_before mix_doc slice turn level w".split()


def named(spark, names):
    shared = prose(1, 60)
    texts = [prose(2, 80), prose(2, 80), shared + " " + prose(3, 50), prose(4, 50) + " " + shared, "short text", None, ""]
    rows = [(k, t, "s" if k % 2 else None, len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    return docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names], F.create_map(F.lit("a"), F.col("doc_id")).alias("entries"))


def kept(out, names):
    rows = out.collect()
    assert all(r[n] == f"{n}:{r['doc_id']}" for r in rows for n in names) and all(r["entries"] == {"a": r["doc_id"]} for r in rows)
    return sorted(r["doc_id"] for r in rows)


@pytest.mark.parametrize("names", [NAMES, MIXED])
def test_stages_keep_callers_columns(spark, sf, names):
    docs = named(spark, names)
    near = corpus_pipeline.keep_one_of_near_copies(spark, docs, sf)
    assert near.columns == docs.columns and kept(near, names) == [0, 2, 3, 4, 5]
    cut = chunking.deduplicate(docs)
    assert cut.columns == docs.columns and kept(cut, names) == list(range(7))
    assert {r["doc_id"]: r["text"] for r in cut.collect()}[4] == "short text"
    assert set(kept(mixing.mix(docs), names)) <= set(range(7))
    sized = mixing.with_sizes(docs)
    timed = mixing.schedule(sized)
    assert kept(timed, names) == list(range(7)) and timed.columns == [*sized.columns, *mixing.MADE]

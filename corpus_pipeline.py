"""Training-corpus pipeline: quality, near-duplicates, repeated passages, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a
DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import chunking, mixing, packing, quality, simhash
from quillspark.llm.common import materialise
from quillspark.llm.queries import learnable_labels


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality is 0.3 or more; rejected ones go."""
    model = quality.fit(docs, learnable_labels(spark, sf_dir))
    return quality.score(docs, model, threshold=0.3).where("predicted = 1").select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; near copies share 0.8 of their runs of five
    words or more.

    The one that stays is that of the smallest doc_id, rows without an id last; then the smallest
    hash of the text, then that of the row.  Rows of the same id, or of none, are copies only if
    their texts are.
    """
    found = simhash.similar_documents(docs, words=5, similarity=0.8)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "row_key")
    kept = found.groupBy("component").agg(F.min(order).alias("k")).select(F.col("k.text_key").alias("_text"), F.col("k.row_key").alias("_row"))
    # Both keys are hashes, the row's covers its id: joined by them, whole texts are shuffled once.
    mine = (F.col("text_key") == F.col("_text")) & (F.col("row_key") == F.col("_row"))
    return simhash.with_keys(docs).select("text_key", "row_key", "doc").join(kept, mine, "left_semi").dropDuplicates(["text_key", "row_key"]).select("doc.*")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; emptied documents go."""
    less = chunking.deduplicate(docs, min_words=20)
    return less.where(F.col("text").isNull() | (F.trim("text") != "")).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else F.lit(None)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources by weights 5, 2, 1 in turn, 150 % of all words; a row for each copy taken.

    Packing goes by length alone, so the mix isn't put in its order."""
    return mixing.mix(docs, ordered=False)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequences, the ids themselves among them."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_one_of_near_copies),
    ("substring dedup", cut_repeated_passages),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Hashing, compression and tokens can't be expressed in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "_"))
    return docs

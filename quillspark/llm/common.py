"""Shared helpers: parallel scans of whole texts, held-out buckets, bounded samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..storage import materialise, release, shared_dir

__all__ = ["bounded_sample", "by_bytes", "components", "doc_bucket", "gathered", "lookup", "materialise", "release", "shared_dir", "spread"]

#: Rows of an Arrow batch of whole texts, at most; longer batches only take memory.
BATCH_ROWS = 250


def spread(df: DataFrame) -> DataFrame:
    """Prepare ``df`` for Python work on whole texts: a scan of very few files is dealt over all
    cores, and the session's Arrow batches get ``BATCH_ROWS`` rows unless they have fewer."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() * 2 < cores:
        return df.repartition(cores)
    return df


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Successive batches put together up to about ``most`` bytes of ``column``; longer ones are parted."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        n = batch.column(column).nbytes
        if held and size + n > most:
            yield from _joined(held, column, most)
            held, size = [], 0
        held.append(batch)
        size += n
    yield from _joined(held, column, most)


def _joined(held: list[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    for batch in pa.Table.from_batches(held).combine_chunks().to_batches() if held else []:
        yield from by_bytes(batch, column, most)


def by_bytes(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about ``most`` bytes of ``column``; a longer value is a part alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield batch.slice(first, k - first)
            first, held = k, 0
        held += n
    if first < batch.num_rows:
        yield batch.slice(first)


def doc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal text of ``doc_id``, modulo ``modulus``; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", shares: int = 1000) -> DataFrame:
    """``rows`` joined to ``table``, which has at most one row for each value of ``keys``.

    Keys that hold more than 1 / ``shares`` of the rows are less than ``shares`` in number: their
    rows of ``table`` are broadcast, and all other keys are shuffled, so no key of any size makes
    a large task.  ``how`` is inner or left; rows with a null key match nothing.
    """
    counts = rows.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    least = rows.count() / shares
    heavy = materialise(counts.where(F.col("_n") > least).select(*keys), "heavy")
    held = heavy.withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(held), keys, "left")
    hot = marked.where("_hot").drop("_hot").join(F.broadcast(table.join(F.broadcast(heavy), keys, "left_semi")), keys, how)
    return hot.unionByName(marked.where("_hot is null").drop("_hot").join(table, keys, how))


def bounded_sample(docs: DataFrame, ids: DataFrame, group: str, rows: int) -> tuple[DataFrame, dict]:
    """``docs`` of a sample of ``ids`` (doc_id, group), and the rows of each non-null group.

    A doc_id is taken if its hash, as a share of all hashes, is below ``rows`` over its group's
    rows: about ``rows`` of each group and never more than twice as many in all, chosen alike in
    every run.  Their ids alone are broadcast, so a scan of ``docs`` moves only sampled texts.
    Each doc_id comes once.  ``docs`` may have a column named as the group; the one of ``ids``
    stays.
    """
    held = ids.where(F.col("doc_id").isNotNull() & F.col(group).isNotNull()).select("doc_id", group)
    counts = {r[group]: r["n"] for r in held.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return docs.drop(group).withColumn(group, F.lit(None).cast(ids.schema[group].dataType)).where("false"), counts
    unit = F.xxhash64(F.lit(7), "doc_id").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    taken = F.lit(False)
    for g, n in counts.items():
        taken = taken | ((F.col(group) == F.lit(g)) & (unit < rows / n))
    picked = held.where(taken).distinct().limit(2 * rows * len(counts))
    return docs.drop(group).join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]), counts

"""Substring deduplication by content-defined chunking with a gear rolling hash.

A chunk ends where the gear hash of the bytes before a word's start has zeros under a mask, so
boundaries depend on some sixteen bytes of content: an insertion moves no boundary but those
beside it.  Chunks are deduplicated by digest over the whole corpus; a run of chunks that all
occur earlier is removed from a text where it holds enough words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, spread

#: One random 16-bit number for each byte value, from a fixed seed.
GEAR = np.random.default_rng(20240229).integers(0, 1 << 16, 256, dtype=np.uint16)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def boundaries(raw: bytes, word_bits: int = 2, any_bits: int = 10, least: int = 12, most: int = 2048) -> np.ndarray:
    """Ends of the chunks of a UTF-8 text, in bytes; the last is its length.

    A cut may stand before a word that follows white space if the top ``word_bits`` bits of the
    16-bit gear hash are zero, or before any character if the top ``any_bits`` are (texts
    without white space).  Chunks have at least ``least`` bytes but the last, and about
    ``most`` at most: a longer one is cut at the next character.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64)
    b = np.frombuffer(raw, np.uint8)
    h = GEAR[b]
    for step in (1, 2, 4, 8):  # h[i] = sum of GEAR[b[i - j]] << j over the last 16 bytes
        h[step:] += h[:-step] << np.uint16(step)
    starts = (b & 0xC0) != 0x80
    space = _SPACE[b]
    word = np.zeros(n, bool)
    word[1:] = space[:-1] & ~space[1:]
    before = np.empty(n, np.uint16)
    before[0] = 0xFFFF
    before[1:] = h[:-1]
    cuts = np.flatnonzero((word & (before >> np.uint16(16 - word_bits) == 0)) | (starts & (before >> np.uint16(16 - any_bits) == 0)))
    out, last = [], 0
    for c in cuts.tolist():
        if c - last < least:
            continue
        while c - last > most:
            last = last + most
            while not starts[last]:
                last += 1
            out.append(last)
        if c - last >= least:
            out.append(c)
            last = c
    while n - last > most:
        last = last + most
        while last < n and not starts[last]:
            last += 1
        out.append(last)
    if last < n:
        out.append(n)
    return np.asarray(out, np.int64)


#: A chunk's place in one long: start << 27 | bytes << 14 | words << 1 | repeated within its text.
_START, _BYTES, _WORDS = 27, 14, 1


def chunks(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text_hash, digests, places): the chunks of each whole text.

    ``digests`` are 64-bit hashes of the chunks with outer white space stripped, ``places``
    packed positions in bytes.  Texts that are null or empty have no chunks.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("digests", T.ArrayType(T.LongType())), T.StructField("places", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                digests, places = [], []
                for raw in part.column("text").cast(pa.binary()).to_pylist():
                    ends = boundaries(raw or b"")
                    starts = np.r_[0, ends[:-1]] if len(ends) else ends
                    held = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                    found = np.fromiter([xxh3_64_intdigest(x.strip()) for x in held], np.uint64, len(held)).view(np.int64)
                    again = np.ones(len(held), np.int64)
                    again[np.unique(found, return_index=True)[1]] = 0
                    words = np.fromiter([len(x.split()) for x in held], np.int64, len(held))
                    digests.append(found)
                    places.append((starts << _START) | ((ends - starts) << _BYTES) | (words << _WORDS) | again)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(digests, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "digests", "places"])

    return spread(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")).mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """Rows (doc_id, text_hash, span_start, span_end, words, first_doc_id): what to remove.

    A chunk is a repeat if its digest occurs in a document of smaller doc_id, or earlier in its
    own text; so each passage stays once, in the smallest document that has it.  Neighbouring
    repeats make a run, which becomes a span if it holds ``min_words`` words.  Spans are
    [start, end) in bytes of the UTF-8 text, whose xxhash64 is text_hash.  Rows of equal doc_id
    count as one document; passages are not removed between rows whose ids are both null.
    first_doc_id is the smallest document that any of the run's chunks was found in before.
    """
    table = materialise(chunks(docs), "chunks")
    each = table.select("doc_id", "text_hash", F.explode(F.arrays_zip("digests", "places")).alias("c"))
    each = each.select(F.col("c.digests").alias("digest"), "doc_id", "text_hash", F.col("c.places").alias("place"))
    # Pre-aggregated before the shuffle; a digest in one document alone goes no further.
    seen = each.groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last"), F.bool_or(F.col("doc_id").isNull()).alias("null_too"), F.count(F.lit(1)).alias("n"))
    shared = materialise(seen.where("first_doc_id is not null and (first_doc_id <> last or null_too)").select("digest", "first_doc_id", "n"), "shared")
    # Digests of more than a thousandth of all shared chunks are less than a thousand: they are
    # looked up where the chunks lie, one row a document, so that no digest of any size makes a
    # large task or many rows of the join and of the shuffle by document.
    least = (shared.agg(F.sum("n").alias("n")).first()["n"] or 0) / 1000
    hot = shared.where(F.col("n") > least).select("digest", "first_doc_id")
    rare = shared.where(F.col("n") <= least).select("digest", "first_doc_id")
    cold = each.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(rare, "digest")
    across = cold.where(~F.col("first_doc_id").eqNullSafe(F.col("doc_id"))).select("doc_id", "text_hash", "place", "first_doc_id")
    inside = each.where("place % 2 = 1").select("doc_id", "text_hash", "place", F.col("doc_id").alias("first_doc_id"))
    single = across.unionByName(inside).select("doc_id", "text_hash", F.array(F.struct("place", "first_doc_id")).alias("hits"))
    hits = single.union(_frequent(table, hot)).groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set("hits")).alias("hits"))
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("span_start", T.LongType()), T.StructField("span_end", T.LongType()), T.StructField("words", T.LongType()), T.StructField("first_doc_id", docs.schema["doc_id"].dataType)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, spans = [], []
            for k, hit in enumerate(batch.column("hits").to_pylist()):
                for span in runs(((h["place"], h["first_doc_id"]) for h in hit), min_words):
                    rows.append(k)
                    spans.append(span)
            at, cols = pa.array(rows, pa.int32()), list(zip(*spans, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("text_hash").take(at), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], batch.schema.field("doc_id").type)],
                names=["doc_id", "text_hash", "span_start", "span_end", "words", "first_doc_id"],
            )

    return hits.mapInArrow(run, schema)


def _frequent(table: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows (doc_id, text_hash, hits): the chunks of each row of ``table`` whose digest is one of
    the less than a thousand of ``hot`` and first in another document."""
    first = T.StructField("first_doc_id", table.schema["doc_id"].dataType)
    hits = T.ArrayType(T.StructType([T.StructField("place", T.LongType()), first]))
    schema = T.StructType([table.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("hits", hits)])
    known = sorted((r["digest"], r["first_doc_id"]) for r in hot.collect())
    if not known:
        return table.sparkSession.createDataFrame([], schema)
    keys, ids = np.array([d for d, _ in known], np.int64), [x for _, x in known]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, held = batch.column("doc_id"), batch.column("digests")
            digests, places = held.flatten().to_numpy(zero_copy_only=False), batch.column("places").flatten()
            at = np.minimum(np.searchsorted(keys, digests), len(keys) - 1)
            found = np.flatnonzero(keys[at] == digests)
            firsts, row = pa.array(ids, own.type).take(pa.array(at[found])), pc.list_parent_indices(held).take(pa.array(found))
            other = pc.fill_null(pc.not_equal(firsts, own.take(row)), True)
            firsts, row, found = firsts.filter(other), row.filter(other), pa.array(found).filter(other)
            n = np.bincount(row.to_numpy(zero_copy_only=False), minlength=batch.num_rows)
            some = pa.array(np.flatnonzero(n))
            ends = pa.array(np.r_[0, np.cumsum(n[n > 0])].astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([places.take(found), firsts], names=["place", "first_doc_id"]))
            yield pa.RecordBatch.from_arrays([own.take(some), batch.column("text_hash").take(some), lists], names=["doc_id", "text_hash", "hits"])

    return table.mapInArrow(run, schema)


def runs(hits: Iterator[tuple[int, object]], min_words: int) -> list[tuple[int, int, int, object]]:
    """(start, end, words, first document) of the runs of touching repeats with enough words."""
    found: dict[int, list[object]] = {}
    for place, first in hits:
        found.setdefault(place, []).append(first)
    out: list[list] = []
    for place in sorted(found):
        start, size, words = place >> _START, (place >> _BYTES) & 0x1FFF, (place >> _WORDS) & 0x1FFF
        if not out or out[-1][1] != start:
            out.append([start, start, 0, []])
        out[-1][1] += size
        out[-1][2] += words
        out[-1][3] += [x for x in found[place] if x is not None]
    return [(s, e, n, min(ids, default=None)) for s, e, n, ids in out if n >= min_words]


def _cut(raw: bytes, spans: list[dict]) -> bytes:
    """The text without its spans."""
    kept, last = [], 0
    for s in sorted(spans, key=lambda s: s["span_start"]):
        kept.append(raw[last : s["span_start"]])
        last = s["span_end"]
    kept.append(raw[last:])
    return b"".join(kept)


def deduplicate(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """``docs`` with repeated spans removed from ``text``; all rows and columns stay.

    A document of which nothing is left keeps an empty text; callers may drop it.  Columns of any
    other names come back as they were: inside they go by their place.
    """
    spans = repeated_spans(docs, min_words)
    held = spans.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("held")).agg(F.collect_list(F.struct("span_start", "span_end")).alias("spans"))
    own = [f"c{k}" for k in range(len(docs.columns))]
    at, id_at = docs.columns.index("text"), docs.columns.index("doc_id")
    keyed = docs.toDF(*own).withColumn("hash", F.xxhash64(own[at]))
    joined = keyed.join(held, F.col(own[id_at]).eqNullSafe(F.col("id")) & (F.col("hash") == F.col("held")), "left").select(*own, "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None or s is None else _cut(t, s) for t, s in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=own)

    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(own, docs.schema.fields, strict=True)])
    return joined.mapInArrow(cut, schema).toDF(*docs.columns)

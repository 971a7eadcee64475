"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within ``distance`` bits agree within t_g bits on at least one partition g of the
bits whenever the sum of (t_g + 1) reaches ``distance`` + 1; a threshold of -1 skips its
partition.  Correlated bits share a partition, and dynamic programming deals the thresholds by
the candidates that each would bring, estimated from bit statistics over all fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, exp, lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, lookup, materialise, release, spread

BITS = 64


def run_hashes(raw: bytes, words: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of all runs of ``words`` words, in order, as unsigned 64-bit integers.

    A-Z are lower-cased; words are separated by bytes 9 to 13 and 32.  A text of fewer words
    is one run; one of no words has none.
    """
    from xxhash import xxh64_intdigest

    held = raw.lower().split()
    if not held:
        return np.zeros(0, np.uint64)
    joined = b" ".join(held)
    if len(held) <= words:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    return np.fromiter([xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts[: len(held) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes set, as a signed 64-bit integer; 0 of none."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 32768):
        total += np.unpackbits(hashes[at : at + 32768].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<i8")[0])


def text_fingerprint(raw: bytes, words: int = 4, seed: int = 42) -> int:
    """The majority bits of XXH64 over all runs of ``words`` words; a text of no words gives 0."""
    return majority(run_hashes(raw, words, seed))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """Rows (doc_id, simhash long) of whole texts, one for each row; a null text counts as empty."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("simhash", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raws = part.column("text").cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([text_fingerprint(x or b"", words) for x in raws], pa.int64())], names=["doc_id", "simhash"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, schema)


# --- choosing partitions and thresholds ---------------------------------------------------


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many bits i and j are both set: sums over
    all rows, of which 64 x 64 numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = batch.column("simhash").to_numpy(zero_copy_only=False)
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total, n = total + bits.T @ bits, n + len(values)
        yield pa.RecordBatch.from_arrays([pa.array([*range(BITS * BITS), -1], pa.int32()), pa.array([*total.ravel().tolist(), float(n)], pa.float64())], names=["cell", "n"])

    cells = prints.select("simhash").mapInArrow(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(BITS * BITS)
    rows = 0
    for r in cells:
        if r["cell"] < 0:
            rows = int(r["n"])
        else:
            both[r["cell"]] = r["n"]
    return rows, both.reshape(BITS, BITS)


def correlated_groups(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits dealt into ``parts`` partitions of even width, each grown by the most correlated bit."""
    p = np.diag(both) / max(n, 1)
    spread_ = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread_, spread_)
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for g in range(parts):
        width = BITS // parts + (g < BITS % parts)
        held = [max(free, key=lambda b: (corr[b, sorted(free)].sum(), -b))]
        free.remove(held[0])
        while len(held) < width:
            held.append(max(free, key=lambda b: (corr[b, held].sum(), -b)))
            free.remove(held[-1])
        groups.append(sorted(held))
    return groups


def _within(both: np.ndarray, n: int, bits: list[int], most: int) -> list[float]:
    """For t = 0 .. most: the chance that two fingerprints differ in at most t of these bits.

    Mean and variance of the number of differing bits follow from the counts of pairs of bits;
    a beta-binomial distribution of that mean and variance stands for it.
    """
    p11 = both[np.ix_(bits, bits)] / n
    p = np.diag(p11)
    p10 = p[:, None] - p11
    p00 = 1 - p[:, None] - p[None, :] + p11
    second = 2 * (p11 * p00 + p10 * p10.T)
    differ = 2 * p * (1 - p)
    np.fill_diagonal(second, differ)
    w, mean = len(bits), float(differ.sum())
    var = max(float(second.sum()) - mean**2, 1e-9)
    m = min(max(mean / w, 1e-6), 1 - 1e-6)
    rho = min(max((var / (w * m * (1 - m)) - 1) / max(w - 1, 1), 1e-6), 0.999)
    a, b = m * (1 / rho - 1), (1 - m) * (1 / rho - 1)
    beta = lambda x, y: lgamma(x) + lgamma(y) - lgamma(x + y)
    return np.cumsum([comb(w, k) * exp(beta(k + a, w - k + b) - beta(a, b)) for k in range(most + 1)]).tolist()


def plan_search(n: int, both: np.ndarray, distance: int, probe_cost: float = 40.0) -> tuple[list[list[int]], list[int]]:
    """Partitions and thresholds of least estimated cost, over 2 to ``distance`` + 2 partitions.

    A probe key costs as much as ``probe_cost`` candidates that are compared.  For each number
    of partitions, dynamic programming over (partition, t + 1 still to deal) picks thresholds.
    """
    best: tuple[float, list[list[int]], list[int]] | None = None
    for parts in range(2, distance + 3):
        groups = correlated_groups(both, n, parts)
        most = min(distance, 3)
        table: list[dict[int, tuple[float, list[int]]]] = [{0: (0.0, [])}]
        for bits in groups:
            near = _within(both, max(n, 2), bits, most)
            cost = [0.0] + [probe_cost * n * (1 + sum(comb(len(bits), i) for i in range(t + 1))) + n * n * near[t] / 2 for t in range(most + 1)]
            step: dict[int, tuple[float, list[int]]] = {}
            for dealt, (c, ts) in table[-1].items():
                for give in range(min(most + 1, distance + 1 - dealt) + 1):
                    new = (c + cost[give], [*ts, give - 1])
                    if dealt + give not in step or new[0] < step[dealt + give][0]:
                        step[dealt + give] = new
            table.append(step)
        if distance + 1 not in table[-1]:
            continue
        c, ts = table[-1][distance + 1]
        if best is None or c < best[0]:
            best = (c, groups, ts)
    return best[1], best[2]


# --- searching ----------------------------------------------------------------------------


def _gathered(value: Column, bits: list[int]) -> Column:
    """The given bits of a long, packed; runs of neighbouring bits move together."""
    out, k, at = F.lit(0).cast("long"), 0, 0
    while at < len(bits):
        run = 1
        while at + run < len(bits) and bits[at + run] == bits[at] + run:
            run += 1
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(value, bits[at]).bitwiseAND(F.lit((1 << run) - 1)), k))
        k, at = k + run, at + run
    return out


def search_keys(prints: DataFrame, distance: int) -> tuple[Column, Column]:
    """The keys that a fingerprint (column ``simhash``) probes, and those that it is found by."""
    n, both = bit_statistics(prints)
    groups, thresholds = plan_search(max(n, 1), both, distance)
    own, probe = [], []
    for g, (bits, t) in enumerate(zip(groups, thresholds, strict=True)):
        if t < 0:
            continue
        tag = F.lit(g << 58).cast("long") if len(bits) <= 58 else F.lit(0).cast("long")
        key = _gathered(F.col("simhash"), bits).bitwiseXOR(tag)
        masks = [sum(1 << k for k in c) for i in range(t + 1) for c in combinations(range(len(bits)), i)]
        own.append(F.array(key))
        probe.append(F.transform(F.lit(np.array(masks, np.int64)), lambda m, key=key: key.bitwiseXOR(m)) if len(masks) > 1 else F.array(key))
    return F.concat(*probe), F.concat(*own)


def links(prints: DataFrame, keys: tuple[Column, Column], distance: int = 4, apart: bool = False) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in at most ``distance`` bits.

    ``prints`` holds each fingerprint once, in ``simhash``.  A pair may come from more than one
    partition.  Verification is part of the join, so only true links leave it.  With ``apart``
    pairs of one ``component`` (a column of ``prints``) are left out.
    """
    group = [F.col("component")] if apart else []
    left = prints.select(F.col("simhash").alias("a"), *[c.alias("of_a") for c in group], F.explode(keys[0]).alias("key"))
    right = prints.select(F.col("simhash").alias("b"), *[c.alias("of_b") for c in group], F.explode(keys[1]).alias("key"))
    near = (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    if apart:
        near = near & (F.col("of_a") != F.col("of_b"))
    # The orientation a < b is found from a's probes: a partition's distance is the same both ways.
    return left.join(right, near).select("a", "b")


def first_links(prints: DataFrame, keys: tuple[Column, Column], distance: int = 4) -> DataFrame:
    """Links (a, b) of fingerprints to the smallest one of a key that they probe: no more than
    there are probes, however many share a key."""
    firsts = prints.select(F.col("simhash").alias("a"), F.explode(keys[1]).alias("key")).groupBy("key").agg(F.min("a").alias("a"))
    probes = prints.select(F.col("simhash").alias("b"), F.explode(keys[0]).alias("key"))
    near = (probes["key"] == firsts["key"]) & (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return probes.join(firsts, near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """Rows (doc_id, simhash, component_id), one for each row of ``docs``.

    Texts of no words have fingerprint 0 and link like any other.  component_id is the smallest
    doc_id reachable over links of at most ``distance`` differing bits; null ids are passed over
    (null where a component has none other).  Equal fingerprints are met once in the search, so
    groups of exact copies of any size cost no pairs.
    """
    table = materialise(fingerprints(docs, words), "prints")
    groups = materialise(table.groupBy("simhash").agg(F.min("doc_id").alias("least")), "groups")
    linked = components(links(groups, search_keys(groups, distance), distance))
    labelled = groups.join(linked, groups["simhash"] == linked["node"], "left").select("simhash", "least", F.coalesce("component", "simhash").alias("component"))
    owner = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    final = labelled.join(owner, "component").select("simhash", "component_id")
    return table.join(final, "simhash").select("doc_id", "simhash", "component_id")


# --- near copies by the similarity of shingle sets ----------------------------------------------

#: Buckets in which uses of shingles are counted, and bits of a set's parity map.
BUCKETS, PARITY = 1 << 16, 2048
#: Remainders of text keys that may be broadcast to pick the texts to compare.
FILTER = 1 << 20
#: Nodes of a key that all others of it are compared with before pairs are made.
PIVOTS = 4


def with_keys(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, text_key, row_key, doc) of ``docs``: hashes of the text and of all
    columns, by which rows without an id, or of the same id, are told apart; ``doc`` holds the
    row as it came, whatever its columns are named."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # Maps have no hash; their sorted entries do.
    held = [F.array_sort(F.map_entries(c)) if isinstance(f.dataType, T.MapType) else c for c, f in zip(columns, docs.schema.fields, strict=True)]
    keys = F.xxhash64("text").alias("text_key"), F.xxhash64(*held, *[c.isNull() for c in columns]).alias("row_key")
    return docs.select("doc_id", "text", *keys, F.struct(*columns).alias("doc"))


def _set_id(shingles: np.ndarray) -> int:
    """A 64-bit digest of a sorted shingle set, signed."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(shingles.tobytes())).view(np.int64))


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of a batch with the run hashes of their texts."""
    for at in range(0, batch.num_rows, 256):
        part = batch.slice(at, 256)
        yield part, [run_hashes(x or b"", words) for x in part.column("text").cast(pa.binary()).to_pylist()]


def set_digests(docs: DataFrame, words: int) -> DataFrame:
    """Rows (doc_id, text_key, row_key, simhash, node, n, bits) of whole texts, and rows (bucket,
    uses) that count their shingles, all other columns null.

    ``node`` is the digest of a text's set of shingles, ``n`` its size.  ``bits`` has bit k set if
    an odd number of its shingles fall on k: two sets differ in as many shingles at least as
    their maps do in bits.
    """
    fields = [T.StructField("simhash", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("bits", T.ArrayType(T.LongType())), T.StructField("bucket", T.IntegerType()), T.StructField("uses", T.LongType())]
    rest = docs.select("doc_id", "text_key", "row_key")
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in rest.schema.fields), *fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses, kind = np.zeros(BUCKETS, np.int64), None
        for batch in batches:
            kind = batch.column("doc_id").type
            for part, runs in _sets(batch, words):
                sets = [np.unique(h) for h in runs]
                if sets:
                    uses += np.bincount((np.concatenate(sets) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                maps = [np.packbits((np.bincount((s >> np.uint64(40) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)).view(np.int64) for s in sets]
                none = part.num_rows
                made = [pa.array([majority(h) for h in runs], pa.int64()), pa.array([_set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(maps, pa.list_(pa.int64())), pa.nulls(none, pa.int32()), pa.nulls(none, pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), part.column("row_key"), *made], names=names)
        met = np.flatnonzero(uses)
        if len(met):
            blank = [pa.nulls(len(met), t) for t in (kind, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*blank, pa.array(met, pa.int32()), pa.array(uses[met], pa.int64())], names=names)

    return spread(docs.select("doc_id", "text_key", "row_key", "text")).mapInArrow(run, schema)


def bucket_ranks(digests: DataFrame) -> np.ndarray:
    """The place of each of ``BUCKETS`` by how often its shingles are used; that many numbers
    reach the driver.  Any order gives the same links, this one puts common shingles last."""
    uses = np.zeros(BUCKETS, np.int64)
    for r in digests.where("bucket is not null").groupBy("bucket").agg(F.sum("uses").alias("uses")).collect():
        uses[r["bucket"]] = r["uses"]
    ranks = np.empty(BUCKETS, np.uint64)
    ranks[np.argsort(uses, kind="stable")] = np.arange(BUCKETS, dtype=np.uint64)
    return ranks


def prefixes(docs: DataFrame, ranks: np.ndarray, words: int, similarity: float) -> DataFrame:
    """Rows (doc_id, text_key, node, n, prefix): the shingles of each text by which it can meet
    all others of ``similarity``, the first n - ceil(similarity n) + 1 in the order of ``ranks``."""
    rest = [T.StructField(c, docs.schema[c].dataType) for c in ("doc_id", "text_key")]
    schema = T.StructType([*rest, T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("prefix", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, runs in _sets(batch, words):
                sets = [np.unique(h) for h in runs]
                firsts = []
                for s in sets:
                    # One number for a bucket's rank and the rest of the hash: another name of the shingle.
                    key = np.sort(ranks[(s & np.uint64(BUCKETS - 1)).astype(np.int64)] << np.uint64(48) | s >> np.uint64(16))
                    firsts.append(key[: len(s) - ceil(similarity * len(s) - 1e-9) + 1].view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array([_set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(firsts, pa.list_(pa.int64()))], names=schema.fieldNames())

    return spread(docs.select("doc_id", "text_key", "text")).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """Rows (node, shingles): the distinct 64-bit hashes of each text's runs of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, runs in _sets(batch, words):
                sets = [np.unique(h) for h in runs]
                yield pa.RecordBatch.from_arrays([pa.array([_set_id(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    return docs.select("text").mapInArrow(run, "node long, shingles array<long>")


def alike(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose shingle sets have a Jaccard similarity of at least
    ``similarity``.  Their sizes and parity maps rule most others out, then the sets are compared."""
    slim = nodes.select("node", "n", "bits")
    differ = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    most = (F.col("na") + F.col("nb")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    met = pairs.join(slim.toDF("a", "na", "bits_a"), "a").join(slim.toDF("b", "nb", "bits_b"), "b")
    near = materialise(met.where((F.abs(F.col("na") - F.col("nb")) <= most) & (differ <= most)).select("a", "b"), "near")
    wanted = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    owners = materialise(nodes.join(wanted, "node").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text")), "owners")
    # Most texts fall out by the remainders of the wanted keys, at most FILTER numbers, before any text is shuffled.
    remainder = lambda key: F.pmod(F.col(key), F.lit(FILTER)).alias("_r")
    few = F.broadcast(owners.select(remainder("_text")).distinct())
    possible = docs.select("doc_id", "text_key", "text", remainder("text_key")).join(few, "_r", "left_semi")
    texts = possible.select("doc_id", "text_key", "text").join(owners, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_text"))).dropDuplicates(["doc_id", "text_key"])
    sets = materialise(shingle_sets(texts, words), "shingles")
    both = near.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    found = materialise(both.where(shared >= similarity * (F.size("sa") + F.size("sb") - shared)).select("a", "b"), "alike")
    for done in (sets, owners, near):
        release(done)
    return found


#: Columns of a posting that tell its set: its size and its parity map.
_SET = ("n", "bits")


def _can_reach(a: str, b: str, similarity: float) -> Column:
    """Whether two postings may be the first that sets of ``similarity`` have in common: what
    follows them in the shorter rest must make up the overlap that the sizes ask for, and their
    parity maps must not differ in more bits than such sets in shingles."""
    na, nb, at, bt = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.at"), F.col(f"{b}.at")
    sizes = (na >= similarity * nb - 1e-6) & (nb >= similarity * na - 1e-6)
    differ = sum((F.bit_count(F.get(f"{a}.bits", F.lit(k)).bitwiseXOR(F.get(f"{b}.bits", F.lit(k)))) for k in range(PARITY // 64)), F.lit(0))
    reach = F.least(na - at, nb - bt) >= (na + nb) * (similarity / (1 + similarity)) - 1e-6
    return sizes & reach & (differ <= (na + nb) * ((1 - similarity) / (1 + similarity)) + 1e-6)


def merged_postings(postings: DataFrame) -> DataFrame:
    """Rows (key, at, node) of prefix shingles that several nodes have, those that the same nodes have as one.

    A passage that some texts share is many shingles of the same nodes, each of which would bring
    all their pairs again.  A node keeps its first place among them, which rules no pair out that
    one of them allows; sets of nodes that fall together by their hashes only bring more pairs.
    """
    same = Window.partitionBy("key")
    nodes = [F.sum(F.shiftright(F.xxhash64("node", F.lit(k)), 32)).over(same) for k in range(2)]
    each = postings.withColumns({"_low": F.min("node").over(same), "_high": F.max("node").over(same), "_of": F.xxhash64(*nodes, F.count(F.lit(1)).over(same))})
    return each.where("_low <> _high").groupBy(F.col("_of").alias("key"), "node").agg(F.min("at").alias("at"))


def shared_postings(docs: DataFrame, nodes: DataFrame, ranks: np.ndarray, words: int, similarity: float) -> DataFrame:
    """Rows (key, at, node, n, bits): prefix shingles that several nodes have, with their sets."""
    mine = nodes.select(F.col("node").alias("_node"), F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"))
    held = prefixes(docs, ranks, words, similarity)
    held = held.join(mine, (F.col("node") == F.col("_node")) & (F.col("text_key") == F.col("_text")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    merged = merged_postings(held.select("node", F.posexplode("prefix").alias("at", "key")))
    return materialise(merged.join(nodes.select("node", *_SET), "node"), "postings")


def to_first(postings: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of each node and ``PIVOTS`` nodes of a key, if they can be alike: no more than
    so many times the postings, however many share a key.

    The pivots are the smallest nodes by as many hashes.  In a group of near copies, some of which
    aren't like each other, one of several pivots is like most."""
    same, given = Window.partitionBy("key"), F.struct("node", "at", *_SET)
    pivots = F.array(*[F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node", "at", *_SET)).over(same) for k in range(PIVOTS)])
    p = postings.select(given.alias("p"), pivots.alias("f")).select("p", F.explode("f").alias("f"))
    return p.where((F.col("p.node") != F.col("f.node")) & _can_reach("p", "f", similarity)).select(F.least("f.node", "p.node").alias("a"), F.greatest("f.node", "p.node").alias("b")).distinct()


def prefix_pairs(postings: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b), a < b, of different components (a column) that share a key and can be alike."""
    a, b = postings.alias("a"), postings.alias("b")
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component"))
    return a.join(b, on & _can_reach("a", "b", similarity)).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, distance: int = 4) -> DataFrame:
    """Rows (doc_id, text_key, row_key, component, component_id), one for each row of ``docs``:
    near copies by shingle sets, exact.  ``component`` labels the group, with or without ids;
    component_id is its smallest doc_id.

    Candidates are fingerprints within ``distance``.  Two texts of similarity 0.8 differ in some
    ten of 64 bits, those of 0.9 in some seven, many in more, and a search at such distances
    compares a share of all pairs; so a prefix filter finds every other pair: with shingles in
    one order, two sets of similarity t share one of their first n - ceil(t n) + 1.  Every pair
    is compared by its sets, those of equal fingerprints too.

    Both searches run twice: each node is first compared with one that has a key in common
    with it, which puts dense groups of copies together without their pairs; then
    with all others that are still in a different component.
    """
    docs = with_keys(docs).drop("doc")
    table = materialise(set_digests(docs, words), "prints")
    rows = table.where("bucket is null")
    owner = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("o")
    grouped = rows.groupBy("node").agg(owner, F.min("simhash").alias("simhash"), F.min("n").alias("n"), F.first("bits").alias("bits"))
    nodes = materialise(grouped.select("node", "simhash", "n", "bits", "o.doc_id", "o.text_key"), "nodes")
    firsts = materialise(nodes.groupBy("simhash").agg(F.min("node").alias("first")), "firsts")
    postings = shared_postings(docs, nodes, bucket_ranks(table), words, similarity)
    keys = search_keys(firsts, distance)

    def label(known: DataFrame) -> DataFrame:
        joined = components(known)
        return materialise(nodes.select("node").join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "labelled")

    def named(pairs: DataFrame) -> DataFrame:
        """Pairs of fingerprints as pairs of nodes."""
        return pairs.join(firsts.toDF("a", "x"), "a").join(firsts.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))

    equal = nodes.join(firsts, "simhash").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    met = equal.unionByName(named(first_links(firsts.select("simhash"), keys, distance))).unionByName(to_first(postings, similarity))
    known = alike(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), nodes, docs, words, similarity)
    labelled = label(known)
    prints = firsts.join(labelled, F.col("first") == F.col("node")).select("simhash", "component")
    met = named(links(prints, keys, distance, apart=True)).unionByName(prefix_pairs(postings.join(labelled, "node"), similarity))
    known = known.unionByName(alike(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), nodes, docs, words, similarity))
    release(labelled)
    labelled = label(known)
    for done in (postings, firsts, nodes):
        release(done)
    final = materialise(lookup(rows.select("doc_id", "text_key", "row_key", "node"), labelled, ["node"]).drop("node"), "final")
    least = final.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return lookup(final, least, ["component"]).select("doc_id", "text_key", "row_key", "component", "component_id")

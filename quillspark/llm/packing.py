"""Best-fit packing of token pieces into sequences: bin completion on the length histogram.

How many pieces there are of each length is all that a packing depends on, and lengths are at
most ``capacity``: a histogram of that many entries is planned on the driver, whatever the
number of documents, and the plan is applied by each piece's rank among those of its length.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gathered, materialise, spread
from .tokens import default_tokenizer, tokenizer

#: A bin's filling: (length, how many) pairs; a plan: (how many such bins, filling).
Filling = tuple[tuple[int, int], ...]
Plan = list[tuple[int, Filling]]


#: A piece's part of the table and its rank among the part's pieces of its length.
_RANK_FIELDS = [T.StructField("_part", T.LongType()), T.StructField("_rank", T.LongType())]


def _with_ranks(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """A task's batches of pieces with the columns of ``_RANK_FIELDS``."""
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    for batch in batches:
        lengths = batch.column("length").to_numpy(zero_copy_only=False)
        order = np.argsort(lengths, kind="stable")
        ranks = np.empty(len(lengths), np.int64)
        held = lengths[order]
        starts = np.flatnonzero(np.r_[True, held[1:] != held[:-1]]) if len(held) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(held)])
        ranks[order] = np.arange(len(held)) - np.repeat(starts, sizes) + seen[held]
        np.add.at(seen, lengths, 1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(lengths), part, np.int64)), pa.array(ranks)], names=[*batch.schema.names, "_part", "_rank"])


def tokenise(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 4096, end_id: int = 1, ranked: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids): the tokens of each text, then ``end_id``.

    Texts of more than ``capacity`` ids are cut into pieces of ``capacity``; the last may be
    shorter.  ``ids`` holds little-endian unsigned 32-bit integers.  A null text counts as
    empty and gives one piece of the end id alone.  Repeated rows give repeated pieces; other
    columns are not read.  With ``ranked`` the rows have the ranks that ``pack_ranked`` needs,
    made in the same pass.
    """
    path = tokenizer_path or default_tokenizer()
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), *(_RANK_FIELDS if ranked else [])]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for part in gathered(batches, "text"):
            ids, bounds = tok.encode_array(part.column("text"))
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
            lengths = np.diff(bounds)
            pieces = -(-lengths // capacity)
            row = np.repeat(np.arange(part.num_rows), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(lengths[row] - start, capacity)
            cuts = np.r_[0, np.cumsum(length)] * 4
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), raw],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    def run_ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _with_ranks(run(batches), capacity)

    return spread(docs.select("doc_id", "text")).mapInArrow(run_ranked if ranked else run, schema)


# --- the planner: bin completion over {length: count} -------------------------------------


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: bins needed at least, with the space that large pieces waste."""
    have = np.zeros(capacity + 2, np.int64)
    for length, n in counts.items():
        have[length] = n
    many, mass = np.cumsum(have), np.cumsum(have * np.arange(capacity + 2))
    half, total = capacity // 2, int(mass[-1])
    k = np.arange(0, half + 1)
    huge = many[-1] - many[capacity - k]
    large = many[capacity - k] - many[half]
    large_mass = mass[capacity - k] - mass[half]
    small_mass = mass[half] - np.where(k > 0, mass[np.maximum(k - 1, 0)], 0)
    spare = large * capacity - large_mass
    need = huge + large + np.maximum(0, -((spare - small_mass) // capacity))
    return max(int(need.max()), -(-total // capacity))


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over counts: equal pieces go to equal bins together."""
    bins: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    rooms: list[int] = []

    def put(room: int, n: int, held: list[tuple[int, int]]) -> None:
        if room not in bins:
            bins[room] = []
            rooms.insert(bisect_right(rooms, room), room)
        bins[room].append((n, held))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_right(rooms, length - 1)
            if at < len(rooms):
                room = rooms[at]
                n, held = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    rooms.pop(at)
            else:
                room, n, held = capacity, left, []
            each = min(room // length, left)
            use = min(n, left // each)
            if n > use and held:
                put(room, n - use, held)
            put(room - each * length, use, [*held, (length, each)])
            left -= use * each
    return [(n, tuple(held)) for group in bins.values() for n, held in group]


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether b's pieces can be put into bins as large as a's pieces (both descending)."""
    if not b:
        return True
    if sum(a) < sum(b) or not a or a[0] < b[0]:
        return False
    tried = set()
    for k, room in enumerate(a):
        if room >= b[0] and room not in tried:
            tried.add(room)
            if _dominates(tuple(sorted((*a[:k], room - b[0], *a[k + 1 :]), reverse=True)), b[1:]):
                return True
    return False


def completions(room: int, lengths: list[int], counts: dict[int, int], keep: int = 4, effort: int = 400) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``, the least wasteful first; a perfect one ends the search.

    Pieces are tried from the largest down, so among equally full ones those of few large
    pieces come first.  ``effort`` bounds the nodes looked at; the first dive is best-fit's own.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    used: dict[int, int] = {}
    budget = [effort]

    def dive(left: int, most: int, held: tuple[int, ...]) -> bool:
        budget[0] -= 1
        if left <= most and counts.get(left, 0) > used.get(left, 0):
            found.append((0, (*held, left)))
            return True
        at, extended = bisect_right(lengths, min(left, most)), False
        while at and budget[0] > 0:
            at -= 1
            x = lengths[at]
            if counts[x] > used.get(x, 0):
                extended = True
                used[x] = used.get(x, 0) + 1
                done = dive(left - x, x, (*held, x))
                used[x] -= 1
                if done:
                    return True
        if not extended:
            found.append((left, held))
        return False

    dive(room, room, ())
    found.sort(key=lambda f: (f[0], len(f[1]), tuple(-x for x in f[1])))
    out: list[tuple[int, ...]] = []
    for _, f in found[: keep * 4]:
        if len(out) < keep and not any(f == g or (len(f) <= 8 and len(g) <= 8 and _dominates(g, f)) for g in out):
            out.append(f)
    return out or [()]


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = 20_000) -> Plan:
    """A plan with as few bins as the search finds; optimal where it meets ``lower_bound``.

    Depth-first: the largest length left is completed by its undominated fillings, each used
    for as many equal bins as the counts allow; a branch ends when its bins and the bound of
    the rest reach the incumbent, at first best-fit decreasing's plan.  Of every branch point
    the fillings after the first are taken up only while ``nodes`` lasts.
    """
    counts = {int(k): int(n) for k, n in counts.items() if n > 0}
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    best = best_fit(counts, capacity)
    best_bins, least = sum(n for n, _ in best), lower_bound(counts, capacity)
    stack: list[tuple[dict[int, int], list[int], int, tuple | None]] = [(counts, sorted(counts), 0, None)]
    while stack and best_bins > least and nodes > 0:
        left, lengths, bins, path = stack.pop()
        descending = True
        while descending and lengths and nodes > 0:
            nodes -= 1
            top = lengths[-1]
            left[top] -= 1  # the piece that the bin is completed around
            fillings = completions(capacity - top, lengths, left)
            left[top] += 1
            for f in reversed(fillings[1:]):
                if len(stack) < 200:
                    stack.append(_applied(left, lengths, bins, path, top, f))
            left, lengths, bins, path = _applied(left, lengths, bins, path, top, fillings[0])
            if nodes % 64 == 0 or len(lengths) < 24:
                descending = bins + lower_bound(left, capacity) < best_bins
        if descending and not lengths and bins < best_bins:
            best, best_bins = [], bins
            while path:
                best.append(path[0])
                path = path[1]
    return best


def _applied(left: dict[int, int], lengths: list[int], bins: int, path: tuple | None, top: int, filling: tuple[int, ...]) -> tuple:
    """The state after as many bins of this filling as the counts allow."""
    uses: dict[int, int] = {top: 1}
    for x in filling:
        uses[x] = uses.get(x, 0) + 1
    n = min(left[x] // k for x, k in uses.items())
    now = dict(left)
    for x, k in uses.items():
        now[x] -= n * k
        if not now[x]:
            del now[x]
    gone = [x for x in uses if x not in now]
    rest = [x for x in lengths if x not in gone] if gone else lengths
    return now, rest, bins + n, ((n, tuple(uses.items())), path)


# --- applying a plan ----------------------------------------------------------------------


def _slots(plan: Plan) -> dict[str, np.ndarray]:
    """For each length its places in order of rank: a row per pattern that holds the length."""
    next_rank: dict[int, int] = {}
    rows, first = [], 0
    for n, filling in plan:
        at = 0
        for length, each in filling:
            start = next_rank.get(length, 0)
            rows.append((length, start, first, each, at))
            next_rank[length] = start + n * each
            at += length * each
        first += n
    cols = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "start", "first", "each", "at"), cols, strict=True))


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` (any columns with ``length``, 1 to ``capacity``) with sequence_id and offset.

    Columns named sequence_id, offset, ``_part`` or ``_rank`` are replaced.  An empty table gives
    an empty result; rows with a null length raise.
    """
    plain = pieces.drop("sequence_id", "offset", "_part", "_rank")
    return pack_ranked(plain.mapInArrow(lambda batches: _with_ranks(batches, capacity), T.StructType([*plain.schema.fields, *_RANK_FIELDS])), capacity)


def pack_ranked(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pack`` for pieces that ``tokenise`` has ranked.

    One pass writes the pieces with their rank among equal lengths of the same part; counts
    per (length, part) give each part its first rank.  Only the histogram reaches the driver,
    at most ``capacity`` rows, and the plan that the tasks get has at most a few rows for each
    of its entries.
    """
    table = materialise(pieces, "pieces")
    rest = [f for f in pieces.schema.fields if f.name not in ("_part", "_rank")]
    counts = table.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = _slots(bin_completion(histogram, capacity))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    ranked = table.join(firsts, ["length", "_part"]).select(*[F.col(f"`{f.name}`") for f in rest], (F.col("_first") + F.col("_rank")).alias("_rank"))
    placed = T.StructType([*rest, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (slots["length"] << 48) + slots["start"] if slots["length"].size else np.zeros(0, np.int64)
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            inner = rank - slots["start"][at]
            sequence = slots["first"][at] + inner // slots["each"][at]
            offset = slots["at"][at] + (inner % slots["each"][at]) * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(place, placed)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 4096) -> DataFrame:
    """Documents to packed pieces with their ids: (doc_id, piece, start, length, ids, sequence_id, offset)."""
    return pack_ranked(tokenise(docs, tokenizer_path, capacity, ranked=True), capacity)

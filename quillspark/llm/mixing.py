"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations alone.

Every source sends its documents in a shuffled order that is the same in every run, the whole
source a second time.  They queue in packets of bounded size, so that a long document doesn't
hold up its source; the virtual finish time of a packet, or of a whole copy, is its source's
cumulative words divided by the source's target, so sources share the mix by their targets at
every point of it.  All packets are ranged by finish time and the mix is truncated where their
cumulative words reach the total budget: what finishes before is in it.
"""

from __future__ import annotations

from math import ceil, floor, log, sqrt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release

#: Words are runs of other characters than these.
WORD = r"[^\x20\x09-\x0D]+"
#: Columns that ``schedule`` adds; a caller's columns of these names are replaced.
MADE = ("source_size", "target", "finish_1", "finish_2", "taken")


#: Words of a packet, at most.
PACKET = 64


class Cut(NamedTuple):
    """The packet at which the budget is reached, and how many of its words are taken."""

    finish: float
    turn: int
    end: int
    words: int


def word_count(text: Column) -> Column:
    """The number of words of a whole text; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_sizes(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``, the number of words; a column of that name is replaced."""
    return docs.withColumn("size", word_count(F.col("text")))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Rows (source, source_size, target, turn): ``share`` of all words dealt by weight.

    Sources in code point order, null last, weigh ``weights`` in turn.  A target stops at
    ``most`` times its source's size; what it can't use is dealt again to the others by weight.
    With sources in order of cap over weight, the level (words a unit of weight) that holds if
    all before are capped rises up to the last capped source and falls after it, so the highest
    is the answer.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("turn", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    held = totals.withColumn("_w", weight).withColumn("_cap", most * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    held = held.withColumn("_level", level).withColumn("_level", F.max("_level").over(everything))
    return held.select("source", "source_size", F.least("_cap", F.col("_w") * F.col("_level")).alias("target"), "turn")


def _clocked(sized: DataFrame, slim: DataFrame, rows: int, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``sized`` (doc_id, source, size and others) with source_size, target, mix_turn and
    mix_end, the source's words up to and with the document.

    ``slim`` holds doc_id, source and size of the same rows.  The order within a source is that
    of md5(doc_id), then doc_id, size.  Running totals are taken in some sqrt(rows) slices of it
    and put together from the slices' sums, so that no window holds a whole source.
    """
    digits = max(1, ceil(log(max(rows, 1), 16) / 2))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sums = slim.groupBy("source", F.substring(key, 1, digits).alias("slice")).agg(F.sum("size").alias("size"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = sums.select(F.col("source").alias("mix_source"), F.col("slice").alias("mix_at"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("mix_before"))
    targets = source_targets(sums, weights, share, most).withColumnsRenamed({"source": "mix_name", "turn": "mix_turn"})
    slices = slices.join(targets, F.col("mix_source").eqNullSafe(F.col("mix_name"))).drop("mix_name")
    keyed = sized.withColumn("mix_key", key).withColumn("mix_slice", F.substring("mix_key", 1, digits))
    joined = keyed.join(slices, F.col("source").eqNullSafe(F.col("mix_source")) & (F.col("mix_slice") == F.col("mix_at")))
    inner = Window.partitionBy("source", "mix_slice").orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("mix_before") + F.sum("size").over(inner)
    return joined.select(*sized.columns, "source_size", "target", "mix_turn", end.alias("mix_end"))


def _clock(end: Column) -> Column:
    """The virtual finish time of what ends after so many words of its source; 0 without a target."""
    return F.when(F.col("target") > 0, end / F.col("target")).otherwise(0.0)


def _packet(start: Column, size: Column, k: Column) -> tuple[Column, Column]:
    """Where the k-th packet (from 0) of a copy ends among its source's words, and its size."""
    upto = F.least((k + 1) * PACKET, size)
    return start + upto, upto - k * PACKET


def _cut(timed: DataFrame, rows: int, words: int, share: float, most: float) -> Cut | None:
    """Where the packets of ``timed``, ranged by finish time, reach the budget; None without words.

    Finish times are dealt to some 4 sqrt(rows) ranges; packets are summed by range where they
    are made, the sums tell the range of the cut, and only its packets are put in order.
    """
    budget = floor(min(share, most) * words + 0.5)
    ranges = max(1024, ceil(4 * sqrt(rows)))
    first = F.col("mix_end") - F.col("size")
    copies = timed.where("size > 0").select("mix_turn", "size", "target", F.explode(F.array(first, first + F.col("source_size"))).alias("start"))
    each = copies.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / PACKET))).alias("k"))
    end, size = _packet(F.col("start"), F.col("size"), F.col("k"))
    packets = each.select(F.col("mix_turn").alias("turn"), end.alias("end"), size.alias("words"), _clock(end).alias("finish"))
    # Targets are at most ``most`` times their sizes, so the mix ends at virtual time 1 or little later.
    packets = packets.withColumn("range", F.floor(F.least(F.col("finish"), F.lit(2.0)) * ranges))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = packets.groupBy("range").agg(F.sum("words").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    hit = sums.where((F.col("before") < budget) & (F.col("before") + F.col("words") >= budget)).first()
    if hit is None:
        return None
    order = Window.orderBy("finish", "turn", "end").rowsBetween(Window.unboundedPreceding, 0)
    inside = packets.where(F.col("range") == hit["range"]).withColumn("upto", F.sum("words").over(order) + hit["before"])
    at = inside.where((F.col("upto") >= budget) & (F.col("upto") - F.col("words") < budget)).first()
    return Cut(at["finish"], at["turn"], at["end"], budget - (at["upto"] - at["words"]))


def _before(cut: Cut, end: Column) -> Column:
    """Whether what ends there in its source comes before the packet at the cut."""
    finish, turn = _clock(end), F.col("mix_turn")
    return (finish < cut.finish) | ((finish == cut.finish) & ((turn < cut.turn) | ((turn == cut.turn) & (end < cut.end))))


def _taken(cut: Cut | None, start: Column) -> Column:
    """Words of a copy that begins at ``start`` in its source's words, up to the cut."""
    if cut is None:
        return F.lit(0).cast("long")
    size = F.col("size")

    def words(k: Column) -> Column:
        end, n = _packet(start, size, k)
        at = (F.col("mix_turn") == cut.turn) & (end == cut.end)
        return F.when(_before(cut, end), n).when(at, F.lit(cut.words).cast("long")).otherwise(F.lit(0).cast("long"))

    last = F.floor((size - 1) / PACKET)
    some = F.aggregate(F.sequence(F.lit(0).cast("long"), last), F.lit(0).cast("long"), lambda s, k: s + words(k))
    return F.when(size <= 0, F.lit(0).cast("long")).when(_before(cut, start + size), size).when(words(F.lit(0).cast("long")) <= 0, F.lit(0).cast("long")).otherwise(some)


def _measured(slim: DataFrame) -> tuple[int, int]:
    found = slim.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("w")).first()
    return found["n"], found["w"]


def schedule(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sized`` (doc_id, source, size and any others) with source_size, target, finish_1,
    finish_2 and taken.

    finish_1 and finish_2 are the virtual finish times of a document's first and second copy;
    ``taken`` counts the words of both that lie before the cut.  All of them together make up
    the budget, ``share`` of all words (``most`` of them if that is less); each source's are
    within a packet of its target.  Documents without words finish with the one before them.
    Packets of one finish time go by source, then by their place in it; rows of equal doc_id and
    size change places without effect.  Sources may hold any share of the rows.  An empty table
    stays empty.  Columns of the names that are added here are replaced.
    """
    sized = sized.drop(*MADE)
    packed = sized.select("doc_id", "source", "size", F.struct(*[F.col(f"`{c}`") for c in sized.columns]).alias("mix_doc"))
    slim = materialise(sized.select("doc_id", "source", "size"), "slim")
    rows, words = _measured(slim)
    timed = materialise(_clocked(slim, slim, rows, weights, share, most), "timed")
    cut = _cut(timed, rows, words, share, most)
    release(timed)
    full = _clocked(packed, slim, rows, weights, share, most)
    first = F.col("mix_end") - F.col("size")
    taken = _taken(cut, first) + _taken(cut, first + F.col("source_size"))
    clocks = _clock(F.col("mix_end")).alias("finish_1"), _clock(F.col("mix_end") + F.col("source_size")).alias("finish_2")
    made = F.struct("source_size", "target", *clocks, taken.cast("long").alias("taken")).alias("mix_made")
    return full.select("mix_doc", made).select("mix_doc.*", "mix_made.*")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, ordered: bool = True) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, a row for each copy that lies before the cut.

    Texts stay whole: a copy in service at the cut is in the mix if at least half of it is before,
    so each source's words are within half a document of its target.  Documents without words come with
    their neighbours; those of a source that has no word at all come once.  ``ordered`` sorts
    the mix by finish time; without it the same rows come in any order and whole texts are
    shuffled once less.  Any columns of ``docs`` come back as they were, whatever their names.
    """
    packed = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_doc"))
    slim = materialise(packed.select("doc_id", "source", "size"), "slim")
    rows, words = _measured(slim)
    timed = materialise(_clocked(slim, slim, rows, weights, share, most), "timed")
    cut = _cut(timed, rows, words, share, most)
    release(timed)
    copies = _clocked(packed, slim, rows, weights, share, most)
    first = F.col("mix_end") - F.col("size")
    copy = lambda start, n: F.struct(_clock(start + F.col("size")).alias("finish"), (start + F.col("size")).alias("end"), (_taken(cut, start) * 2 >= F.col("size")).alias("taken"), F.lit(n).alias("n"))
    both = F.array(copy(first, 1), copy(first + F.col("source_size"), 2))

    def kept(c: Column) -> Column:
        if cut is None:
            return c["n"] == 1
        return F.when(F.col("size") > 0, c["taken"]).otherwise(_before(cut, c["end"]) & ((c["n"] == 1) | (F.col("target") > 0)))

    copies = copies.select("mix_doc", "mix_turn", F.explode(F.filter(both, kept)).alias("c"))
    if ordered:
        copies = copies.orderBy("c.finish", "mix_turn", "c.end")
    return copies.select("mix_doc.*")

"""Titles within a few edits by an index of segments, and the merge that rests on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import materialise
from .graph import components
from .slices import latest_before

#: Titles of at most SHORT characters may differ by FEW edits, longer ones by MORE.
SHORT, FEW, MORE = 40, 2, 3
#: Stands before short titles, so that the empty one has a tail too; equal beginnings change no distance.
_PAD = "\x01" * 3
#: Titles of equal heads up to which their keys are made in one task.
FAMILY = 300_000
#: Stands for a slot in keys; the places of slots are part of a key, so it may be in a title too.
_SLOT = "\x02"


def edits(length: Column) -> Column:
    """How many edits a title of this length may be away."""
    return F.when(length <= SHORT, FEW).otherwise(MORE)


def _segments(length: Column) -> Column:
    """In how many parts a title of this length is cut: one more than the edits of any title that
    it may be compared with, which is at most MORE characters longer."""
    return F.when(length <= SHORT - MORE, FEW + 1).otherwise(MORE + 1)


def _begin(length: Column, part: Column) -> Column:
    return F.floor(part * length / _segments(length)).cast("int")


def _key(block: Column, length: Column, part: Column, text: Column) -> Column:
    return F.xxhash64(block, length, part, text)


def _by_segments(probes: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (a, b): ids of probes and known titles of a block that have a part in common.

    Of a known title's parts one at least is intact in every title that few edits away, and moved
    by no more than these edits leave room for; so titles meet by block, length, part and the
    part's text.
    """
    n, length, part = F.length("title"), F.col("length"), F.col("part")
    parts = known.select("id", "block", "title", n.alias("length"), F.explode(F.sequence(F.lit(0), _segments(n) - 1)).alias("part"))
    begin, end = _begin(length, part), _begin(length, part + 1)
    index = parts.select(F.col("id").alias("known_id"), _key(F.col("block"), length, part, F.substring("title", begin + 1, end - begin)).alias("key"))
    asked = probes.withColumns({"n": n, "most": edits(n)})
    by_length = asked.select("id", "block", "title", "n", "most", F.explode(F.sequence(F.greatest(F.col("n") - F.col("most"), F.lit(0)), F.col("n") + F.col("most"))).alias("length"))
    by_part = by_length.select("*", F.explode(F.sequence(F.lit(0), _segments(length) - 1)).alias("part")).withColumns({"begin": begin, "size": end - begin, "more": F.col("n") - length})
    # A part moved by x leaves |x| edits before it and |more - x| after it.
    first, last = F.col("begin") - F.floor((F.col("most") - F.col("more")) / 2), F.col("begin") + F.floor((F.col("most") + F.col("more")) / 2)
    placed = by_part.withColumns({"first": F.greatest(first, F.lit(0)), "last": F.least(last, F.col("n") - F.col("size"))}).where("last >= first")
    keys = F.transform(F.sequence("first", "last"), lambda at: _key(F.col("block"), length, part, F.substring(F.col("title"), at.cast("int") + 1, F.col("size"))))
    asks = placed.select(F.col("id").alias("probe_id"), F.explode(F.array_distinct(keys)).alias("key"))
    return asks.join(index, "key").select(F.col("probe_id").alias("a"), F.col("known_id").alias("b"))


def _tail(length: Column) -> Column:
    """How many last characters of a short title of this length are its tail."""
    return F.greatest(F.ceil(length / 3).cast("int"), F.lit(1))


def _less(rows: DataFrame, count: int) -> DataFrame:
    """Rows (id, key) of ``rows`` (id, block, kind, length, head, part): keys by what is left of
    ``part`` without ``count`` of its characters, chosen in all ways."""
    cut = lambda text, at: F.concat(F.substring(text, F.lit(1), F.col(at) - 1), F.substring(text, F.col(at) + 1, F.length(text)))
    for k in range(count):
        last = F.col("at") - 1 if k else F.length("part")
        rows = rows.withColumn("last", last).where("last >= 1").withColumn("at", F.explode(F.sequence(F.lit(1), "last"))).withColumn("part", cut(F.col("part"), "at"))
    return rows.select("id", F.xxhash64("kind", "block", "length", "head", "part").alias("key"))


def _by_tails(shorter: DataFrame, longer: DataFrame, backwards: bool) -> DataFrame:
    """Rows (a, b): ids of short titles of a block that may be ``FEW`` (two) edits apart, b's title as long as
    a's or longer.

    Either at most one of the edits is in the tail of the longer title, so the tails meet by what is left of
    them without a character; or both are, so the heads are equal, and the tails meet by what is
    left without two.  Families that share their heads thus make no pairs beyond those nearly
    alike, and those that share their tails none if they are read ``backwards``.
    """
    text = F.concat(F.lit(_PAD), F.reverse("title") if backwards else F.col("title"))
    n, none, length = F.length("title"), F.lit(""), F.col("length")

    def last(size: Column) -> Column:
        return F.substring("text", F.length("text") - size + 1, size)

    def keyed(rows: DataFrame, kind: str, head: Column, part: Column, count: int) -> DataFrame:
        return _less(rows.select("id", "block", F.lit(kind).alias("kind"), "length", head.alias("head"), part.alias("part")), count)

    size = _tail(length)
    before = length + len(_PAD) - size
    head, rest = F.substring("text", F.lit(1), before), F.substring("text", before + 1, size)
    held = longer.select("id", "block", text.alias("text"), n.alias("length"))
    index = keyed(held, "whole", none, rest, 0).unionByName(keyed(held, "less", none, rest, 1)).unionByName(keyed(held, "both", head, rest, 2))
    asked = shorter.select("id", "block", text.alias("text"), n.alias("n"))
    asks = None
    for more in range(FEW + 1):
        of = asked.select("id", "block", "text", (F.col("n") + more).alias("length"))
        # The tail of the other title has as many characters in this one, or one less or more.
        found = [keyed(of, "less", none, last(size), 1), keyed(of, "less", none, last(size - 1), 0), keyed(of, "both", head, rest, FEW - more)]
        if more == 0:
            found.append(keyed(of, "whole", none, last(size + 1), 1))
        for each in found:
            asks = each if asks is None else asks.unionByName(each)
    return asks.withColumnRenamed("id", "a").join(index.withColumnRenamed("id", "b"), "key").select("a", "b")


def _backwards(known: DataFrame) -> bool:
    """Whether the first characters of titles tell them apart better than the last ones."""
    size = _tail(F.length("title"))
    ends = {"last": F.substring("title", F.length("title") - size + 1, size), "first": F.substring("title", F.lit(1), size)}
    pairs = {k: known.groupBy("block", c.alias("end")).agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("n")).first()["n"] or 0 for k, c in ends.items()}
    return pairs["first"] < pairs["last"]


def _verified(met: DataFrame, asked: DataFrame, held: DataFrame) -> DataFrame:
    """Rows (probe_id, known_id, distance) of ``met`` (a, b) within ``edits`` of the probe's length."""
    # Ids alone meet; titles come back for the pairs that are left.
    left = met.distinct().join(asked.select(F.col("id").alias("a"), F.col("title").alias("asked"), F.col("block").alias("of_asked")), "a")
    both = left.join(held.select(F.col("id").alias("b"), F.col("title").alias("held"), F.col("block").alias("of_held")), "b")
    near = both.where(F.col("of_asked") == F.col("of_held")).withColumn("distance", F.levenshtein("asked", "held"))
    return near.where(F.col("distance") <= edits(F.length("asked"))).select(F.col("a").alias("probe_id"), F.col("b").alias("known_id"), "distance")


def edit_pairs(probes: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (probe_id, known_id, distance): titles of one block within ``edits`` of the probe's length.

    Both have id, block and title.  Titles of up to ``SHORT`` characters meet by heads and tails,
    longer ones by parts, and only then are distances taken.  Null titles or blocks meet nothing;
    equal titles are at distance 0, and an id may meet itself.
    """
    n = F.length("title")
    slim = lambda df: materialise(df.where("title is not null and block is not null").select("id", "block", "title"), "titles")
    asked = slim(probes)
    held = asked if probes is known else slim(known)
    brief, near = asked.where(n <= SHORT), held.where(n <= SHORT + FEW)
    backwards = _backwards(near)
    met = _by_tails(brief, near, backwards).unionByName(_by_segments(asked.where(n > SHORT), held.where(n >= SHORT + 1 - MORE)))
    if probes is known:
        # Pairs of short titles are found from the shorter one alone; those of a longer probe were found by parts.
        met = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        met = met.unionByName(_by_tails(near.where(n < SHORT), brief, backwards).select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _verified(met, asked, held)


def _slots(rows: DataFrame, rounds: int) -> DataFrame:
    """``rows`` (group, part, steps, ...) with key and also instead of part and steps: all ways to put slots into ``part``.

    ``steps`` says which, from right to left, ``rounds`` at most.  A slot takes the place of a
    character (w) or stands between two (i), and takes one character or none; d leaves a
    character out, and without steps the part stays whole.  So the titles of a group that have one
    slotted part are as many edits apart at most as it has slots, those that are one without a
    character two, and titles that few edits apart have one, if the shorter is given the slots
    between.  Two hashes tell parts apart, of 96 bits in all.
    """
    kept = [c for c in rows.columns if c not in ("part", "steps")]
    rows = rows.withColumns({"last": F.length("part"), "places": F.lit(0)})
    for k in range(rounds):
        step = F.substring("steps", k + 1, 1)
        most = F.when(step == "i", F.col("last") + 1).when(step == "", 1).otherwise(F.col("last"))
        rows = rows.where(most >= 1).withColumn("at", F.explode(F.sequence(F.lit(1), most)))
        rest = F.substring(F.col("part"), F.col("at") + F.when(step == "i", 0).otherwise(1), F.length("part"))
        cut = F.concat(F.substring("part", F.lit(1), F.col("at") - 1), F.when(step == "d", "").otherwise(_SLOT), rest)
        places = F.when(step.isin("w", "i"), F.col("places") * 64 + F.length(rest)).otherwise(F.col("places"))
        rows = rows.select(*kept, "steps", F.when(step == "", F.col("part")).otherwise(cut).alias("part"), (F.col("at") - 1).alias("last"), places.alias("places"))
    named = (F.col("group"), F.when(F.col("steps") == "d", 0).otherwise(F.length("steps")), F.col("places"), F.col("part"))
    return rows.select(*kept, F.xxhash64(*named).alias("key"), F.hash(*named).alias("also"))


def _firsts(rows: DataFrame, rounds: int, distance: int, tasks: int) -> DataFrame:
    """Rows (id, distance, first) of ``rows`` (id, asks, group, n, part, steps, an array): the smallest id that
    has a key in common with one that asks, if it is smaller.

    A group of up to ``FAMILY`` rows stays in one task, which makes its keys; keys of larger ones are dealt.
    """
    slotted = lambda df: _slots(df.withColumn("steps", F.explode("steps")), rounds)
    first = F.min("id").over(Window.partitionBy("key", "also", "group"))
    told = [slotted(rows.where(F.col("n") <= FAMILY).repartition(tasks, "group")).withColumn("first", first), slotted(rows.where(F.col("n") > FAMILY)).repartition(tasks, "key").withColumn("first", first)]
    found = told[0].unionByName(told[1]).where("asks and first < id")
    return found.groupBy("id").agg(F.min("first").alias("first")).select("id", F.lit(distance).alias("distance"), "first")


def _steps(by: Column, steps: dict[int, list[str]]) -> Column:
    """The steps of each row by a number, none for numbers that aren't listed."""
    return reduce(lambda c, k: c.when(by == k, F.array(*map(F.lit, steps[k]))), steps, F.when(F.lit(False), F.array().cast("array<string>")))


def _placed(near: DataFrame, shifts: list[tuple[int, int]]) -> DataFrame:
    """``near`` (id, block, text, asks) cut where a title ``more`` characters longer has its tail, and ``shift`` from there."""
    cuts = F.explode(F.array(*[F.struct(F.lit(m).alias("more"), F.lit(s).alias("shift")) for m, s in shifts]))
    rows = near.withColumn("cut", cuts).select("id", "block", "text", "asks", "cut.*").withColumn("length", F.length("text") - len(_PAD) + F.col("more"))
    return rows.withColumn("size", _tail(F.col("length"))).withColumn("before", F.col("length") + len(_PAD) - F.col("size") + F.col("shift")).where(F.length("text") >= F.col("before"))


def _shared(rows: DataFrame) -> DataFrame:
    """``rows`` (id, asks, group, more) of groups with a title as long as their place, and another
    one, up to the last one that asks; with ``n``, how many rows their group has."""
    groups = rows.groupBy("group").agg(F.min("more").alias("least"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("asks"), F.col("id"))).alias("latest"))
    kept = materialise(groups.where("least = 0 and n > 1 and latest is not null").select("group", "n", "latest"), "groups")
    return rows.join(kept, "group").where("id <= latest")


def _families(near: DataFrame) -> DataFrame:
    """Titles by their heads: rows (id, asks, more, group, n, part), where part is the tail."""
    rows = _placed(near, [(m, 0) for m in range(FEW + 1)])
    head = F.substring("text", F.lit(1), F.col("before"))
    return _shared(rows.select("id", "asks", "more", F.xxhash64("block", "length", head).alias("group"), F.substring(F.col("text"), F.col("before") + 1, F.col("size")).alias("part")))


def _same_tails(near: DataFrame) -> DataFrame:
    """Rows (a, b), a later: ids of titles of equal tails that have one of three parts of their heads in common."""
    rows = _placed(near, [(m, 0) for m in range(FEW + 1)])
    end = F.length("text") - F.col("size")
    rows = _shared(rows.select("id", "asks", "more", "before", F.xxhash64("block", "length", F.substring(F.col("text"), end + 1, F.col("size"))).alias("group"), F.substring("text", F.lit(1), end).alias("head")))
    parts = rows.withColumn("part", F.explode(F.array(*[F.lit(k) for k in range(FEW + 1)])))
    begin = F.floor(F.col("part") * F.col("before") / (FEW + 1)).cast("int")
    size = F.floor((F.col("part") + 1) * F.col("before") / (FEW + 1)).cast("int") - begin
    # A part moved by x leaves |x| edits before it and |more + x| after it.
    moved = F.sequence(-F.floor((FEW + F.col("more")) / 2).cast("int"), F.floor((FEW - F.col("more")) / 2).cast("int"))
    asked = parts.withColumn("moved", F.explode(moved)).where((begin + F.col("moved") >= 0) & (begin + F.col("moved") + size <= F.length("head")))
    key = lambda at: F.xxhash64("group", "part", F.substring(F.col("head"), at + 1, size))
    left = asked.select("id", "asks", key(begin + F.col("moved")).alias("key")).alias("l")
    right = parts.where("more = 0").select("id", "asks", key(begin).alias("key")).alias("r")
    met = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.id") != F.col("r.id")))
    met = met.where(F.when(F.col("l.id") > F.col("r.id"), F.col("l.asks")).otherwise(F.col("r.asks")))
    return met.select(F.greatest("l.id", "r.id").alias("a"), F.least("l.id", "r.id").alias("b"))


def _near_heads(near: DataFrame) -> DataFrame:
    """Rows (id, asks, group, n, part, steps) for ``_firsts``: titles by pairs of heads that are one edit apart, such
    that their tails are one edit apart if they have a key in common.

    Heads are compared once for all titles that have them: families have few.
    """
    cuts = _placed(near, [(0, 0), (0, -1), (1, 0), (1, -1), (2, -1)])
    head = F.substring("text", F.lit(1), F.col("before"))
    cuts = cuts.select("id", "asks", "more", "shift", "block", "length", head.alias("head"), F.xxhash64("block", "length", head).alias("of_head"), F.substring(F.col("text"), F.col("before") + 1, F.length("text")).alias("part"))
    heads = cuts.groupBy("of_head", "block", "length", "head", "shift").agg(F.min("more").alias("least"), F.count(F.lit(1)).alias("n"), F.max("asks").alias("asks"))
    # Of two heads one is that of a title as long as the place.
    heads = materialise(heads.select("of_head", "n", "asks", F.expr("shift = 0 and least = 0").alias("whole"), F.xxhash64("block", "length").alias("group"), F.col("head").alias("part"), F.when(F.col("shift") == 0, "w").otherwise("i").alias("steps")), "heads")
    keyed = _slots(heads, 1).drop("group")
    one, other = keyed.where("whole").alias("one"), keyed.alias("other")
    pairs = one.join(other, ["key", "also"]).where("one.of_head <> other.of_head and (one.asks or other.asks)").select(F.col("one.of_head").alias("one"), F.col("other.of_head").alias("other"), F.expr("one.n + other.n").alias("n")).distinct()
    pairs = materialise(pairs.withColumn("group", F.xxhash64("one", "other")), "pairs")
    held = cuts.where("more = 0 and shift = 0").join(pairs.select(F.col("one").alias("of_head"), "group", "n"), "of_head").withColumn("steps", F.array(F.lit("w"), F.lit("")))
    # A tail that is one character shorter than the other's gets the slot; one that is longer by one leaves a character out.
    asked = cuts.join(pairs.select(F.col("other").alias("of_head"), "group", "n"), "of_head").withColumn("steps", _steps(F.col("more") + F.col("shift"), {-1: ["d"], 0: ["w"], 1: ["i"]}))
    return held.unionByName(asked).select("id", "asks", "group", "n", "part", "steps")


def nearest_before(titles: DataFrame) -> DataFrame:
    """Rows (id, distance, first): of each title of ``titles`` (id, block, title, asks) that asks, the title of its
    block of a smaller id within ``edits`` of its length that is the fewest edits away, of several the smallest id.

    Titles are distinct in a block.  Those of up to ``SHORT`` characters aren't paired with all that are near, of
    which a family has a square: titles of equal heads, or heads one edit apart, get keys by their tails
    such that all that have one in common are near, and of each key only the first is told to the others.
    Two edits are looked for where one has found nothing.  Titles of equal tails meet by parts of their
    heads, longer ones by parts, and are compared.
    """
    held = materialise(titles.where("title is not null and block is not null").select("id", "block", "title", "asks"), "titles")
    n = F.length("title")
    brief = held.where(n <= SHORT + FEW)
    backwards = _backwards(brief)
    near = materialise(brief.select("id", "block", F.concat(F.lit(_PAD), F.reverse("title") if backwards else F.col("title")).alias("text"), (F.col("asks") & (n <= SHORT)).alias("asks")), "near")
    # A title has some fifteen keys of one slot, ninety of two.
    count = near.count()
    tasks = lambda keys: max(titles.sparkSession.sparkContext.defaultParallelism, count * keys // 2_000_000)
    ones = _families(near).withColumn("steps", _steps(F.col("more"), {0: ["w"], 1: ["i"]}))
    ones = materialise(_firsts(ones, 1, 1, tasks(15)), "ones")
    still = near.where("asks").join(ones, "id", "left_anti").select("id")
    latest = still.agg(F.max("id")).first()[0]
    twos = []
    if latest is not None:
        left = near.where(F.col("id") <= latest).drop("asks").join(still.withColumn("asks", F.lit(True)), "id", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
        left = materialise(left, "left")
        family = _families(left).withColumn("steps", _steps(F.col("more"), {0: ["ww", "d"], 1: ["wi", "iw"], 2: ["ii"]}))
        twos = [_firsts(family, 2, 2, tasks(90)), _firsts(_near_heads(left), 1, 2, tasks(30))]
    long = held.where("asks").where(n > SHORT)
    met = _same_tails(near).unionByName(_by_segments(long, held.where(n >= SHORT + 1 - MORE)).where("b < a"))
    compared = _verified(met, held, held).select(F.col("probe_id").alias("id"), "distance", F.col("known_id").alias("first"))
    found = reduce(DataFrame.unionByName, [ones, *twos, compared])
    return found.groupBy("id").agg(F.min(F.struct("distance", "first")).alias("best")).select("id", "best.distance", "best.first")


def arrival_parents(papers: DataFrame) -> DataFrame:
    """Rows (arrival, parent, reason): the earlier paper that each paper of ``papers`` (arrival,
    doi, title) is merged into, null if it opens a group.

    An identifier seen before decides, else the same sorted-word title, else the title seen
    before of the fewest edits (the one seen first of several).  A key leads to the last paper
    that had it, as each one binds its keys anew.  Papers without a title have the empty one.
    """
    keys = papers.select("arrival", F.nullif(F.trim(F.lower("doi")), F.lit("")).alias("doi"), F.coalesce(T.sorted_title_key(F.col("title")), F.lit("")).alias("key"))
    keys = materialise(keys, "keys")
    by_doi = latest_before(keys.withColumn("own", F.col("arrival")), "doi", "arrival", "own").select("arrival", F.col("latest").alias("by_doi"))
    by_title = latest_before(keys.withColumn("own", F.col("arrival")), "key", "arrival", "own").select("arrival", F.col("latest").alias("by_title"))
    known = materialise(keys.groupBy("key").agg(F.min("arrival").alias("id")).select("id", F.lit(0).alias("block"), F.col("key").alias("title")), "titles")
    exact = materialise(by_doi.join(by_title, "arrival"), "exact")
    # Only the first paper of a title can get here, and each title is known by its first paper.
    open_ = exact.where("by_doi is null and by_title is null").select(F.col("arrival").alias("id"))
    asking = known.join(open_.withColumn("asks", F.lit(True)), "id", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    # Read twice below, once for the range of arrivals.
    best = materialise(nearest_before(asking).select(F.col("id").alias("arrival"), F.col("first").alias("id")), "best")
    asked = best.join(known, "id").select("arrival", F.col("title").alias("key"), F.lit(None).cast("long").alias("own"))
    seen = keys.select("arrival", "key", F.col("arrival").alias("own")).join(asked.select("key").distinct(), "key", "left_semi").select("arrival", "key", "own")
    by_edits = latest_before(seen.unionByName(asked), "key", "arrival", "own").where("own is null").select("arrival", F.col("latest").alias("by_edits"))
    reason = F.when(F.col("by_doi").isNotNull(), "doi_match").when(F.col("by_title").isNotNull(), "title_exact").when(F.col("by_edits").isNotNull(), "title_fuzzy")
    return exact.join(by_edits, "arrival", "left").select("arrival", F.coalesce("by_doi", "by_title", "by_edits").alias("parent"), reason.alias("reason"))


def arrival_merge(papers: DataFrame) -> DataFrame:
    """``papers`` (arrival, doi, title, abstract, citation_count, pubmed_id, openalex_id, pdf_url, ...)
    merged in order of arrival: a row per group with its first paper's columns, the longest
    abstract (the first of several), the most citations, of the identifiers and links the first
    that is there, and ``papers``, how many were merged.

    Each paper has one parent at most, which came before it; so the groups are the components of
    these links and a group's first paper is the one without a parent, as in a loop over arrivals.
    """
    parents = materialise(arrival_parents(papers), "parents")
    found = components(parents.where("parent is not null").select(F.col("parent").alias("a"), F.col("arrival").alias("b")))
    labelled = papers.join(found.withColumnRenamed("node", "arrival"), "arrival", "left").withColumn("label", F.coalesce("component", "arrival")).drop("component")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    there = lambda c: F.min_by(c, F.when(text(c), F.col("arrival"))).alias(c)
    longest = F.max_by("abstract", F.when(text("abstract"), F.struct(F.length("abstract"), -F.col("arrival")))).alias("abstract")
    filled = [c for c in ("doi", "pubmed_id", "openalex_id", "pdf_url", "landing_url") if c in papers.columns]
    rest = [c for c in papers.columns if c not in (*filled, "arrival", "abstract", "citation_count")]
    return labelled.groupBy("label").agg(
        F.min("arrival").alias("arrival"),
        *[F.min_by(c, "arrival").alias(c) for c in rest],
        *[there(c) for c in filled],
        longest,
        F.max("citation_count").alias("citation_count"),
        F.count(F.lit(1)).alias("papers"),
    ).drop("label")

"""Record deduplication: normalise, find fuzzy duplicates, group, elect, link, audit, measure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import doi as D
from ..functions import scores as S
from ..functions import similarity as H
from ..functions import text as T
from ..functions.hashing import record_fingerprint
from ..storage import materialise
from .graph import components

#: How far each source is trusted, and its rank among equals.  Unlisted: 0.500, 9999.
SOURCE_PRIORITY = [("pubmed", "0.980", 1), ("openalex", "0.920", 2), ("semantic_scholar", "0.900", 3), ("crossref", "0.890", 4), ("arxiv", "0.840", 5), ("unknown", "0.500", 999)]
#: Thresholds of a fuzzy duplicate, and of the quality gate in percent.
TITLE_SIMILARITY, AUTHOR_OVERLAP = 0.92, 0.5
MIN_PRECISION, MIN_RECALL = 99.0, 97.0


def _priority(source: Column, at: int, default: Column) -> Column:
    """A source's trust (1) or rank (2) as an expression; the list is six rows long."""
    out = F.when(F.lit(False), default)
    for row in SOURCE_PRIORITY:
        value = F.lit(row[at]).cast("decimal(4,3)") if at == 1 else F.lit(row[at])
        out = out.when(source == row[0], value)
    return out.otherwise(default)


def with_priority(records: DataFrame) -> DataFrame:
    """Trust and rank of each record's source, with defaults for unlisted ones."""
    return records.withColumns({"source_trust": _priority(F.col("source"), 1, F.lit("0.500").cast("decimal(4,3)")), "source_rank": _priority(F.col("source"), 2, F.lit(9999))})


def in_window(records: DataFrame, since: str | None, column: str = "source_updated_at") -> DataFrame:
    """All records for a full run; those touched since a time for an incremental one."""
    return records if since is None else records.where(F.col(column) >= F.lit(since).cast("timestamp_ntz"))


def normalize_records(records: DataFrame, run_ts: str) -> DataFrame:
    """Identifiers, text keys, score parts and quality of each record, and the key it is grouped
    by: its identifier where that is valid, else its fingerprint.  Identifiers, titles and names
    are put into Unicode's compatibility composition first."""
    records = T.with_nfkc(records, ["raw_doi", "title", "authors"])
    doi, title = D.normalize_doi(F.col("raw_doi")), T.normalize_record_text(F.col("title"))
    base = with_priority(records).withColumns({"doi_norm": doi, "title_norm": title, "authors_norm": T.authors_key(F.col("authors"))})
    base = base.withColumns(
        {
            "doi_is_valid": D.is_valid_doi(F.col("doi_norm")),
            "fingerprint": record_fingerprint(F.col("title_norm"), F.col("authors_norm"), F.col("pub_year")),
            "completeness": S.metadata_completeness(F.col("title"), F.col("authors"), F.col("pub_year"), F.col("raw_doi"), F.col("citation_count")),
            "recency": S.recency(F.col("source_updated_at"), F.lit(run_ts).cast("timestamp_ntz")),
            "citation_signal": S.citation_signal(F.col("citation_count"), F.lit(0.0)),
        }
    )
    return base.withColumns(
        {
            "quality": S.record_quality(F.col("completeness"), F.col("source_trust"), F.col("recency"), F.col("citation_signal")),
            "key_type": F.when(F.col("doi_is_valid"), "doi").otherwise("fingerprint"),
            "dedup_key": F.when(F.col("doi_is_valid"), F.col("doi_norm")).otherwise(F.concat(F.lit("fp:"), F.col("fingerprint"))),
        }
    )


def rarest(sets: DataFrame, by: list[str], similarity: float) -> DataFrame:
    """Rows (``by``, firsts) for sets (``by``, grams, n), n being among ``by``: the n - ceil(t n) + 1
    rarest grams of each, of which two sets of Jaccard t share one."""
    each = sets.select(*by, F.explode("grams").alias("gram"))
    rarity = each.groupBy("gram").agg(F.count(F.lit(1)).alias("uses"))
    ranked = each.join(rarity, "gram").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("uses", "gram"))).alias("ordered"))
    return ranked.select(*by, F.slice("ordered", F.lit(1), F.col("n") - F.ceil(F.lit(similarity) * F.col("n")).cast("int") + 1).alias("firsts"))


def fuzzy_edges(normalized: DataFrame, title_similarity: float = TITLE_SIMILARITY, overlap: float = AUTHOR_OVERLAP) -> DataFrame:
    """Pairs (a, b, similarity, author_overlap), a < b, of active records without a valid
    identifier: same year (or none), titles alike by trigrams, authors in common.

    Exact prefix filter instead of all pairs of a year: with the grams of a title in order of
    rarity, two titles of Jaccard t share one of their first n - ceil(t n) + 1 grams, and
    authors in common share a name.  Records meet by (year, name, such a gram) and by a length
    that allows t, then the whole sets are compared.
    """
    held = normalized.where("key_type = 'fingerprint' and not is_deleted").select("record_id", "pub_year", "authors_norm", H.trigrams(F.coalesce("title_norm", F.lit(""))).alias("grams"))
    held = materialise(held.where(F.size("grams") > 0).withColumn("n", F.size("grams")), "grams")
    names = F.array_distinct(T.words(F.coalesce("authors_norm", F.lit("")), r"\|"))
    ranked = rarest(held, ["record_id", "pub_year", "n", "authors_norm"], title_similarity)
    keys = ranked.select("record_id", "pub_year", "n", F.explode(names).alias("name"), "firsts").select("record_id", "pub_year", "n", "name", F.explode("firsts").alias("k"))
    keys = keys.select("record_id", "pub_year", "n", F.xxhash64(F.coalesce(F.col("pub_year"), F.lit(-1)), "name", "k.gram").alias("block"))
    a, b = keys.alias("a"), keys.alias("b")
    # A length of at least t times the other's is needed for a Jaccard of t.
    lengths = (F.col("a.n") >= title_similarity * F.col("b.n")) & (F.col("b.n") >= title_similarity * F.col("a.n"))
    met = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.record_id") < F.col("b.record_id")) & lengths & F.col("a.pub_year").eqNullSafe(F.col("b.pub_year")))
    pairs = met.select(F.col("a.record_id").alias("a"), F.col("b.record_id").alias("b")).distinct()
    left, right = held.toDF("a", "y1", "authors_a", "grams_a", "n1"), held.toDF("b", "y2", "authors_b", "grams_b", "n2")
    raw = H.jaccard(F.col("grams_a"), F.col("grams_b"))
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", raw.alias("raw"), H.author_token_overlap(F.col("authors_a"), F.col("authors_b")).alias("author_overlap"))
    return scored.where((F.col("raw") >= title_similarity) & (F.col("author_overlap") >= overlap)).select("a", "b", F.col("raw").cast("decimal(4,3)").alias("similarity"), "author_overlap")


def _shared_names(names: Column, overlap: float) -> Column:
    """Structs (key, enough) of a record's subsets of names by which it can have enough authors in
    common with another: ``enough`` if the subset is all that the record itself asks for.

    Of a record of m names a fewest number s(m) must be shared with one of as many or more; it
    never falls as m grows.  So two records are alike if they share a subset that is enough for
    one of them.  ``normalize_records`` keeps three names at most.
    """
    fewest = [next((k for k in range(1, m + 1) if round(k / m, 3) >= overlap), 0) for m in range(1, 17)]
    need, n = F.array(*map(F.lit, fewest)), F.size(names)
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), n).cast("int") - 1)
    subset = lambda mask: F.array_join(F.filter(names, lambda _, i: F.getbit(mask, i) == 1), "|")
    wanted = F.filter(masks, lambda mask: F.array_contains(F.slice(need, F.lit(1), n), F.bit_count(mask)))
    return F.transform(wanted, lambda mask: F.struct(subset(mask).alias("key"), (F.bit_count(mask) == F.element_at(need, n)).alias("enough")))


def fuzzy_links(normalized: DataFrame, title_similarity: float = TITLE_SIMILARITY, overlap: float = AUTHOR_OVERLAP) -> DataFrame:
    """Some of the pairs of ``fuzzy_edges``, (a, b, similarity): they have the same connected
    components, and each record its highest similarity, but don't grow with the square of a title's records.

    A cell holds the records of one year and set of grams that share a subset of names
    (``_shared_names``).  One for which the subset is enough, its hub, is a duplicate of all others
    in the cell, so they link to the hub alone.  Cells of different titles meet by (year, subset, rare gram), as
    records do in ``fuzzy_edges``, and link by one record each: hubs, or where a cell has none,
    its first record.  The others of such a cell link to the hub of the title most like theirs.
    """
    names = F.array_sort(F.array_distinct(T.words(F.coalesce("authors_norm", F.lit("")), r"\|")))
    held = normalized.where("key_type = 'fingerprint' and not is_deleted").select("record_id", "pub_year", names.alias("names"), H.trigrams(F.coalesce("title_norm", F.lit(""))).alias("grams"))
    # Grams are letters, digits and spaces.
    title = F.md5(F.concat_ws("|", F.coalesce(F.col("pub_year").cast("string"), F.lit("")), F.array_join(F.array_sort("grams"), "|")))
    held = materialise(held.where((F.size("grams") > 0) & (F.size("names") > 0)).withColumn("title", title), "grams")
    rows = held.select("record_id", "title", "pub_year", F.explode(_shared_names(F.col("names"), overlap)).alias("s")).select("record_id", "title", "pub_year", "s.key", "s.enough")
    hub = F.min(F.when(F.col("enough"), F.col("record_id")))
    cells = materialise(rows.groupBy("title", "pub_year", "key").agg(hub.alias("hub"), F.min("record_id").alias("least")), "cells")
    near = materialise(_near_cells(held, cells, title_similarity), "near")
    own = rows.join(cells.where("hub is not null").select("title", "key", "hub"), ["title", "key"]).where("record_id <> hub").select("hub", "record_id", F.lit("1.000").cast("decimal(4,3)").alias("similarity"))
    first = near.select("one", "other", "similarity")
    sides = [near.where(f"not hub_{y}").select(F.col(f"title_{y}").alias("title"), "key", F.col(x).alias("hub"), "similarity") for x, y in (("one", "other"), ("other", "one"))]
    best = sides[0].union(sides[1]).groupBy("title", "key").agg(F.max_by("hub", F.struct("similarity", "hub")).alias("hub"), F.max("similarity").alias("similarity"))
    rest = rows.join(best, ["title", "key"]).select("hub", "record_id", "similarity")
    a, b = F.col("hub"), F.col("record_id")
    links = own.union(first.toDF("hub", "record_id", "similarity")).union(rest).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "similarity")
    return links.where("a <> b").distinct()


def _near_cells(held: DataFrame, cells: DataFrame, similarity: float) -> DataFrame:
    """Pairs of cells of different but similar titles, at least one of them with a hub:
    (title_one, title_other, key, one, hub_one, other, hub_other, similarity), ``one`` and ``other`` being their records."""
    titles = materialise(held.groupBy("title").agg(F.any_value("grams").alias("grams")).withColumn("n", F.size("grams")), "titles")
    firsts = rarest(titles, ["title", "n"], similarity)
    record = F.coalesce("hub", "least")
    at = cells.join(firsts, "title").select("title", "n", "pub_year", "key", record.alias("record"), F.col("hub").isNotNull().alias("hub"), F.explode("firsts.gram").alias("gram"))
    at = at.withColumn("block", F.xxhash64(F.coalesce("pub_year", F.lit(-1)), "key", "gram"))
    a, b = at.alias("a"), at.alias("b")
    # A length of at least t times the other's is needed for a Jaccard of t.
    lengths = (F.col("a.n") >= similarity * F.col("b.n")) & (F.col("b.n") >= similarity * F.col("a.n"))
    met = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.title") < F.col("b.title")) & lengths & F.col("a.pub_year").eqNullSafe(F.col("b.pub_year")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.hub") | F.col("b.hub")))
    met = met.select(F.col("a.title").alias("title_one"), F.col("b.title").alias("title_other"), "a.key", F.col("a.record").alias("one"), F.col("a.hub").alias("hub_one"), F.col("b.record").alias("other"), F.col("b.hub").alias("hub_other"))
    met = materialise(met.distinct(), "met")
    sets = titles.select("title", "grams")
    pairs = met.select("title_one", "title_other").distinct().join(sets.toDF("title_one", "grams_one"), "title_one").join(sets.toDF("title_other", "grams_other"), "title_other")
    alike = pairs.select("title_one", "title_other", H.jaccard(F.col("grams_one"), F.col("grams_other")).alias("raw")).where(F.col("raw") >= similarity)
    return met.join(alike.select("title_one", "title_other", F.col("raw").cast("decimal(4,3)").alias("similarity")), ["title_one", "title_other"])


def fuzzy_groups(normalized: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (record_id, root, group_size, cluster_key, confidence) of the active records without
    a valid identifier; alone, a record is its own root with confidence 1.  ``edges`` are those of
    ``fuzzy_edges``, or of ``fuzzy_links``, which give the same groups.

    One row per id: where records share one, a row each would join with each of them, their square.
    """
    active = normalized.where("key_type = 'fingerprint' and not is_deleted")
    held = active.groupBy("record_id").agg(F.count(F.lit(1)).alias("records"), F.min("fingerprint").alias("least"))
    found = components(edges.select("a", "b"))
    both = edges.select(F.col("a").alias("record_id"), "similarity").union(edges.select("b", "similarity"))
    nearest = both.groupBy("record_id").agg(F.max("similarity").alias("nearest"))
    labelled = held.join(found.withColumnRenamed("node", "record_id"), "record_id", "left").withColumn("label", F.coalesce("component", "record_id"))
    group = labelled.groupBy("label").agg(F.min("record_id").alias("root"), F.sum("records").alias("group_size"), F.min("least").alias("least"))
    rows = labelled.select("record_id", "label").join(group, "label").join(nearest, "record_id", "left")
    confidence = F.when(F.col("group_size") == 1, F.lit("1.000").cast("decimal(4,3)")).otherwise(F.greatest(F.lit("0.920").cast("decimal(4,3)"), F.col("nearest")))
    return rows.select("record_id", "root", "group_size", F.concat(F.lit("fp:"), F.sha2("least", 256)).alias("cluster_key"), confidence.alias("confidence"))


def with_clusters(normalized: DataFrame, groups: DataFrame) -> DataFrame:
    """Fingerprint keys replaced by those of the records' groups."""
    keys = groups.select("record_id", "cluster_key", "confidence")
    return normalized.join(keys, "record_id", "left").withColumn("dedup_key", F.coalesce("cluster_key", "dedup_key")).drop("cluster_key")


def _canonical_id() -> Column:
    return F.sha2(F.concat(F.lit("canon:"), "key_type", F.lit(":"), "dedup_key"), 256)


def elect_canonical(records: DataFrame) -> DataFrame:
    """The canonical record of each key: best quality, latest update, best source, smallest id."""
    order = Window.partitionBy("key_type", "dedup_key").orderBy(F.desc("quality"), F.desc("source_updated_at"), "source_rank", "record_id")
    best = records.where("not is_deleted").withColumn("place", F.row_number().over(order)).where("place = 1")
    return best.withColumn("canonical_id", _canonical_id()).drop("place")


def duplicate_links(records: DataFrame, canonical: DataFrame) -> DataFrame:
    """A link from each active record to the canonical record of its key, itself left out."""
    c = canonical.select("key_type", "dedup_key", "canonical_id", F.col("record_id").alias("canonical_record_id"))
    linked = records.where("not is_deleted").join(c, ["key_type", "dedup_key"]).where("record_id <> canonical_record_id")
    confidence = F.coalesce(F.col("confidence"), F.lit("1.000").cast("decimal(4,3)")) if "confidence" in records.columns else F.lit("1.000").cast("decimal(4,3)")
    return linked.select("record_id", "canonical_record_id", "canonical_id", "key_type", F.when(F.col("key_type") == "doi", F.lit("1.000").cast("decimal(4,3)")).otherwise(confidence).alias("confidence"))


def audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """What an election changed: (canonical_id, decision, previous_record_id, record_id)."""
    old = before.select("canonical_id", F.col("record_id").alias("previous_record_id"))
    new = after.select("canonical_id", "record_id")
    changed = new.join(old, "canonical_id", "left").where(~F.col("previous_record_id").eqNullSafe(F.col("record_id")))
    gone = old.join(new.select("canonical_id"), "canonical_id", "left_anti").withColumn("record_id", F.lit(None).cast("string"))
    kind = F.when(F.col("previous_record_id").isNull(), "elected").otherwise("re_elected")
    return changed.select("canonical_id", kind.alias("decision"), "previous_record_id", "record_id").unionByName(gone.select("canonical_id", F.lit("deactivated").alias("decision"), "previous_record_id", "record_id"))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, three decimals; null for nothing."""
    return F.round(part.cast("decimal(20,0)") / F.nullif(whole.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")) * 100, 3).cast("decimal(8,3)")


def duplicate_rate(records: DataFrame, links: DataFrame) -> DataFrame:
    """Records, linked records and their share, by source.  Ids are compared within a key, as
    records of several keys may share one."""
    linked = links.select("record_id", "canonical_id", F.lit(1).alias("linked")).distinct()
    marked = records.where("not is_deleted").withColumn("canonical_id", _canonical_id()).join(linked, ["record_id", "canonical_id"], "left")
    by = marked.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.count("linked").alias("duplicates"))
    return by.withColumn("rate", percent(F.col("duplicates"), F.col("records")))


def coverage(records: DataFrame, links: DataFrame) -> DataFrame:
    """One row: share without an identifier, and share linked by fingerprint; ``links`` are those of
    ``duplicate_links``, one for each linked record."""
    fallback = links.where("key_type = 'fingerprint'").agg(F.count(F.lit(1)).alias("fallback"))
    counts = records.where("not is_deleted").agg(F.count(F.lit(1)).alias("records"), F.count_if(~F.col("doi_is_valid")).alias("missing"))
    return counts.crossJoin(fallback).select("records", percent(F.col("missing"), F.col("records")).alias("pct_missing_doi"), percent(F.col("fallback"), F.col("records")).alias("pct_fallback_matched"))


def precision_recall(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """One row: counts and shares of labelled ``pairs`` (left_id, right_id, expected) by whether
    both have the same key."""
    key = records.select("record_id", F.concat_ws(":", "key_type", "dedup_key").alias("key"))
    joined = pairs.join(key.toDF("left_id", "key_l"), "left_id").join(key.toDF("right_id", "key_r"), "right_id")
    same = F.col("key_l") == F.col("key_r")
    n = joined.agg(F.count_if(same & F.col("expected")).alias("tp"), F.count_if(same & ~F.col("expected")).alias("fp"), F.count_if(~same & F.col("expected")).alias("fn"), F.count(F.lit(1)).alias("samples"))
    return n.select("tp", "fp", "fn", "samples", percent(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision_pct"), percent(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall_pct"))


def churn(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: the share of earlier canonical records that another one replaced."""
    b = before.select("canonical_id", F.col("record_id").alias("was"))
    j = b.join(after.select("canonical_id", "record_id"), "canonical_id", "left")
    changed = F.count_if(~F.col("was").eqNullSafe(F.col("record_id")))
    return j.agg(F.count(F.lit(1)).alias("canonicals"), changed.alias("changed"), percent(changed, F.count(F.lit(1))).alias("churn_pct"))


def without_orphans(staged: DataFrame, raw: DataFrame) -> DataFrame:
    """Staged records whose raw record still exists."""
    return staged.join(raw.select("record_id").distinct(), "record_id", "left_semi")


def gate(metrics: DataFrame, min_precision: float = MIN_PRECISION, min_recall: float = MIN_RECALL) -> None:
    """Raise if labelled pairs exist and precision or recall falls short; one row is read."""
    row = metrics.first()
    if row and row["samples"]:
        if (row["precision_pct"] or 0) < min_precision or (row["recall_pct"] or 0) < min_recall:
            raise ValueError(f"dedup gate: precision {row['precision_pct']} %, recall {row['recall_pct']} %")

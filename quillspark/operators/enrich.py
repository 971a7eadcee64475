"""Metadata enrichment: candidates, scores, the best one, outcomes and field merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import similarity as H
from ..functions import text as T
from ..storage import materialise

#: Weights of title, authors, year and venue, and the bonus of equal identifiers.
WEIGHTS = (0.55, 0.20, 0.15, 0.10)
DOI_BONUS = 0.1
#: Fixed value: the confidence from which a candidate is accepted, and no second source is asked.
ACCEPTED = 0.9
#: Days that a cached answer is good for, by kind; and days it may be served stale.
TTL_DAYS = {"doi": 30, "title": 7, "unresolved": 1}
STALE_DAYS = 90


def _features(df: DataFrame, side: str) -> DataFrame:
    """What a comparison needs of each record, worked out once per record and not per pair."""
    title, venue = T.normalize_ascii(F.col(f"{side}_title")), T.normalize_ascii(F.col(f"{side}_venue"))
    publication = F.coalesce(F.nullif(f"{side}_journal", F.lit("")), F.nullif(f"{side}_venue", F.lit("")))
    made = df.withColumns({"_t": title, "_v": venue, f"{side}_publication": publication})
    return made.withColumns(
        {
            f"{side}_words": H.match_tokens(F.col("_t")),
            f"{side}_grams": H.bigrams(F.col("_t")),
            f"{side}_venue_words": H.match_tokens(F.col("_v")),
            f"{side}_venue_grams": H.bigrams(F.col("_v")),
            f"{side}_journal_words": H.match_tokens(T.normalize_ascii(F.col(f"{side}_publication"))),
            f"{side}_journal_grams": H.bigrams(T.normalize_ascii(F.col(f"{side}_publication"))),
            f"{side}_names": F.transform(F.col(f"{side}_authors"), T.normalize_ascii),
        }
    ).drop("_t", "_v")


def title_sets(df: DataFrame) -> DataFrame:
    """Rows (id, provider, tokens, of_set) of ``df``: the sorted distinct title tokens of three
    letters or more, stop words aside, and the hash of the set."""
    tokens = F.array_sort(H.claim_tokens(F.coalesce("title", F.lit(""))))
    return df.select("id", "provider", tokens.alias("tokens")).where(F.size("tokens") > 0).withColumn("of_set", F.xxhash64(F.array_join("tokens", " ")))


def _first_of_sets(sets: DataFrame, k: int, salts: int = 64) -> DataFrame:
    """The k smallest ids of each provider's rows of one token set: rows (provider, of_set, ids).

    First within shares of the ids, then over the shares, so a set of any size is no task's."""
    def first(rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("nth") <= k).drop("nth")

    salted = sets.select("provider", "of_set", "id", (F.xxhash64("id") % salts).alias("salt"))
    return first(first(salted, "provider", "of_set", "salt"), "provider", "of_set").groupBy("provider", "of_set").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def best_titles(papers: DataFrame, references: DataFrame, k: int = 5, least: float = 0.5) -> DataFrame:
    """Rows (p_id, r_id, provider): the ``k`` references of each provider whose titles share most
    with the paper's, by the weight of the shared tokens.

    A token weighs ln(1 + references / its references), one that no reference has as if one had.
    Only references that share ``least`` of the weight of the paper's title count; ties go to the
    title of fewer tokens, then to the smaller id.  A paper's tokens are looked up from the
    heaviest on, as long as those that are left weigh enough to reach ``least``: titles without
    any of these can't.  Equal token sets are looked up once and stand in the index once, with
    their k smallest ids, so copies of a title make no pairs.  Joins are by sorted shuffles, as
    tables of titles are many times what their compressed files let Spark expect.
    """
    asked, held = title_sets(papers.withColumn("provider", F.lit(None).cast("string"))), materialise(title_sets(references), "held")
    size = held.count()
    known = held.select("of_set", "tokens").dropDuplicates(["of_set"])
    uses = held.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    each = asked.select("of_set", "tokens").dropDuplicates(["of_set"]).select("of_set", F.posexplode("tokens").alias("at", "token"))
    # Rounded as decimals, so that sums don't depend on their order.
    weight = F.round(F.log(1.0 + size / F.coalesce("uses", F.lit(1))), 6).cast("decimal(18,6)")
    weighed = each.join(uses.hint("merge"), "token", "left").select("of_set", "token", "uses", weight.alias("w"))
    order = Window.partitionBy("of_set").orderBy(F.desc("w"), "token")
    rest = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("w").over(Window.partitionBy("of_set"))
    ranged = materialise(weighed.withColumns({"rest": rest, "total": total}), "weighed")
    asks = ranged.where((F.col("rest") >= F.col("total") * least) & F.col("uses").isNotNull()).select(F.col("of_set").alias("p_set"), "token")
    index = known.select(F.col("of_set").alias("r_set"), F.explode("tokens").alias("token"))
    met = asks.join(index.hint("merge"), "token").select("p_set", "r_set").distinct()
    mine = ranged.groupBy(F.col("of_set").alias("p_set")).agg(F.collect_list(F.struct("token", "w")).alias("weights"), F.max("total").alias("total"))
    both = met.join(mine.hint("merge"), "p_set").join(known.select(F.col("of_set").alias("r_set"), F.col("tokens").alias("r_tokens")).hint("merge"), "r_set")
    shared = F.aggregate(F.filter("weights", lambda x: F.array_contains(F.col("r_tokens"), x["token"])), F.lit(0).cast("decimal(28,6)"), lambda s, x: (s + x["w"]).cast("decimal(28,6)"))
    scored = both.select("p_set", "r_set", shared.alias("score"), F.size("r_tokens").alias("n"), "total").where(F.col("score") >= F.col("total") * least)
    rows = scored.join(_first_of_sets(held, k).withColumnRenamed("of_set", "r_set").hint("merge"), "r_set").select("p_set", "provider", "score", "n", F.explode("ids").alias("r_id"))
    best = Window.partitionBy("p_set", "provider").orderBy(F.desc("score"), "n", "r_id")
    top = rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("p_set", "provider", "r_id")
    return asked.select(F.col("id").alias("p_id"), F.col("of_set").alias("p_set")).join(top.hint("merge"), "p_set").select("p_id", "r_id", "provider")


def candidates(papers: DataFrame, references: DataFrame, sources: tuple[str, str] = ("crossref", "openalex"), k: int = 5) -> DataFrame:
    """Pairs of a paper and a reference, with what their comparison needs and their ``confidence``.

    Both have id, doi, title, authors, year, venue, journal, citation_count; papers have source,
    references provider.  Of the first source a paper gets the references of its identifier, or
    if there are none the ``k`` best titles.  The second is asked only for papers whose best
    candidate stays below the confidence that is accepted: by the identifier if the paper has
    one, else by its title.  (A paper as its own candidate would always win, and is left out.)
    """
    named = ("id", "doi", "title", "authors", "year", "venue", "citation_count", "journal")
    p = materialise(_features(papers.select(*[F.col(c).alias(f"p_{c}") for c in (*named, "source")]), "p"), "p")
    r = materialise(_features(references.select(*[F.col(c).alias(f"r_{c}") for c in (*named, "provider")]), "r"), "r")
    first, second = sources
    keys = p.select(F.col("p_id"), F.col("p_doi").alias("doi")).where("doi <> ''")
    by_doi = materialise(keys.join(r.select("r_id", F.col("r_doi").alias("doi"), F.col("r_provider").alias("provider")), "doi").select("p_id", "r_id", "provider"), "by_doi")
    by_title = materialise(best_titles(papers, references.where(F.col("provider").isin(first, second)), k), "by_title")
    of = lambda pairs, source: pairs.where(F.col("provider") == source).select("p_id", "r_id")
    known = of(by_doi, first)
    asked = known.unionByName(of(by_title, first).join(known.select("p_id"), "p_id", "left_anti"))
    featured = lambda pairs: pairs.join(p.hint("merge"), "p_id").join(r.hint("merge"), "r_id").withColumn("confidence", candidate_confidence())
    one = materialise(featured(asked), "first")
    sure = one.where(F.col("confidence") >= ACCEPTED).select("p_id").distinct()
    more = of(by_doi, second).unionByName(of(by_title, second).join(keys.select("p_id"), "p_id", "left_anti")).join(sure, "p_id", "left_anti")
    return one.unionByName(featured(more))


def candidate_confidence() -> Column:
    """Score of a candidate pair, 0 to 1, four decimals."""
    text = lambda words, grams: H.combined(F.col(f"p_{words}"), F.col(f"r_{words}"), F.col(f"p_{grams}"), F.col(f"r_{grams}"))
    parts = (text("words", "grams"), H.author_overlap(F.col("p_names"), F.col("r_names")), H.year_similarity(F.col("p_year"), F.col("r_year")), text("venue_words", "venue_grams"))
    total = sum((w * p for w, p in zip(WEIGHTS, parts, strict=True)), F.lit(0.0))
    bonus = F.when(F.coalesce(F.col("p_doi") == F.col("r_doi"), F.lit(False)), DOI_BONUS).otherwise(0.0)
    # Rounded as a decimal: sums of doubles end beside the ties.
    return F.round(S.clamp(total + bonus).cast("decimal(18,10)"), 4).cast("double")


def trust(source: Column) -> Column:
    """The trust in a source; 0.5 in unknown ones."""
    return F.when(source.isin(*S.PROVIDER_CONFIDENCE), S.provider_confidence(source)).otherwise(0.5)


def best_candidates(pairs: DataFrame) -> DataFrame:
    """The best candidate of each paper: confidence, then trust in its provider, then id."""
    scored = pairs.withColumn("trust", trust(F.col("r_provider")))
    order = Window.partitionBy("p_id").orderBy(F.desc("confidence"), F.desc("trust"), "r_id")
    best = scored.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
    return best.withColumn("outcome", S.enrichment_outcome(F.col("confidence")))


def merged_fields(best: DataFrame) -> DataFrame:
    """What an accepted candidate fills or replaces, field by field, with the reasons.

    A missing field is filled.  A year one off is replaced on evidence clearly above that of the
    paper's own source, a journal if the two names are alike too; citations grow to the larger
    number; differing identifiers and years far apart are recorded.
    """
    accepted = F.col("outcome") == "accepted"
    evidence, own = F.col("trust") * F.col("confidence"), trust(F.lower(F.coalesce("p_source", F.lit("unknown")))) * 0.8
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    missing = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    conflict = ~blank("p_doi") & ~blank("r_doi") & (F.col("p_doi") != F.col("r_doi"))
    gap = F.abs(F.col("p_year") - F.col("r_year"))
    alike = H.combined(F.col("p_journal_words"), F.col("r_journal_words"), F.col("p_journal_grams"), F.col("r_journal_grams"))
    known = ~blank("r_publication")
    citations = F.greatest(F.coalesce("p_citation_count", F.lit(0)), F.coalesce("r_citation_count", F.lit(0)))
    applied = {
        "doi": [(blank("p_doi") & ~blank("r_doi"), "filled")],
        "year": [(missing("p_year") & ~missing("r_year"), "filled"), (~missing("p_year") & (gap == 1) & (evidence >= own + 0.05), "higher_evidence")],
        "journal": [(blank("p_journal") & known, "filled"), (~blank("p_journal") & known & (alike >= 0.85) & (evidence >= own + 0.03) & (F.col("p_publication") != F.col("r_publication")), "higher_evidence")],
        "citation_count": [(F.col("r_citation_count").isNotNull() & (citations != F.coalesce("p_citation_count", F.lit(0))), "max_trusted")],
    }
    why = {}
    for field, rules in applied.items():
        found = F.lit(None).cast("string")
        for condition, reason in reversed(rules):
            found = F.when(accepted & F.coalesce(condition, F.lit(False)), reason).otherwise(found)
        why[field] = found
    pick = lambda field, new, old: F.when(why[field].isNotNull(), new).otherwise(old)
    held = F.array_compact(F.array(*[F.concat(F.lit(f"{field}="), reason) for field, reason in why.items()], F.when(conflict, "doi=doi_conflict")))
    reasons = F.array_compact(F.array(F.when(conflict, "doi_conflict"), F.when(~missing("p_year") & ~missing("r_year") & (gap > 1), "year_out_of_range")))
    return best.select(
        "p_id",
        "outcome",
        pick("doi", F.col("r_doi"), F.col("p_doi")).alias("doi"),
        pick("year", F.col("r_year"), F.col("p_year")).alias("year"),
        pick("journal", F.col("r_publication"), F.col("p_journal")).alias("journal"),
        pick("citation_count", citations, F.col("p_citation_count")).alias("citation_count"),
        F.array_join(held, "|").alias("fields_applied"),
        F.array_join(reasons, "|").alias("reasons"),
    )


def cache_state(cache: DataFrame, now: Column) -> DataFrame:
    """``fresh``, ``stale`` (may be served inline) or ``expired`` for each cached answer."""
    until = F.col("fetched_at") + F.expr(f"INTERVAL {STALE_DAYS} DAYS")
    return cache.withColumn("state", F.when(F.col("expires_at") > now, "fresh").when(until > now, "stale").otherwise("expired"))

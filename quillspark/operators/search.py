"""Search: query plans, retrieval, canonical papers, quality, claims and the evidence table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions.hashing import fnv1a
from ..functions import extraction as X
from ..functions import scores as S
from ..functions import similarity as H
from ..functions import text as T
from ..views import spread

#: Concepts: id, preferred term, synonyms, terms never added, and how many are.
ONTOLOGY = [
    ("sleep_deprivation", "sleep deprivation", ["sleep restriction", "sleep loss", "partial sleep deprivation", "insufficient sleep"], ["sleep quality"], 3),
    ("cognitive_performance", "cognitive performance", ["working memory", "attention", "executive function", "reaction time"], [], 3),
    ("hypertension", "blood pressure", ["hypertension", "systolic blood pressure", "diastolic blood pressure"], [], 3),
    ("depression", "depression", ["depressive symptoms", "major depressive disorder", "mood symptoms"], [], 3),
    ("anxiety", "anxiety", ["anxious symptoms", "anxiety disorder", "state anxiety"], [], 3),
    ("insomnia", "insomnia", ["sleep onset insomnia", "sleep maintenance insomnia", "sleeplessness"], [], 2),
    ("vaccine_hesitancy", "vaccine hesitancy", ["vaccine confidence", "vaccine acceptance", "vaccine refusal"], ["anti-vaccine"], 2),
    ("glycemic_control", "glycemic control", ["glycaemic control", "blood glucose", "hemoglobin a1c", "hba1c"], [], 3),
    ("body_weight", "body weight", ["body mass index", "bmi", "weight loss", "weight gain"], [], 3),
    ("cardiovascular_outcomes", "cardiovascular outcomes", ["major adverse cardiovascular events", "mace", "cardiovascular mortality"], [], 2),
]
#: How many own and added terms a source's query holds.
SOURCE_BUDGETS = {"semantic_scholar": (8, 6), "openalex": (8, 3), "pubmed": (8, 4), "arxiv": (8, 3)}
#: Tokens that are ambiguous, negate, or compare.
AMBIGUOUS = ["better", "best", "worse", "worst", "good", "bad", "safe", "safer"]
NEGATIONS = ["not", "without", "no", "non"]
COMPARATORS = ["vs", "versus", "compared", "against"]


# --- query understanding ------------------------------------------------------------------


def concept_terms(query: Column, terms: Column) -> tuple[Column, Column]:
    """The added terms of every concept that the query names, and how many concepts those are."""
    added, met = [], F.lit(0)
    for _, preferred, synonyms, never, most in ONTOLOGY:
        hit = S.any_of(query, [preferred, *synonyms])
        usable = F.filter(F.array(*[F.lit(t) for t in dict.fromkeys([preferred, *synonyms]) if t not in never]), lambda t: ~F.array_contains(terms, t))
        added.append(F.when(hit, F.slice(usable, 1, most)).otherwise(F.array().cast("array<string>")))
        met = met + hit.cast("int")
    return F.array_distinct(F.flatten(F.array(*added))), met


def query_confidence(terms: Column, added: Column, concepts: Column) -> Column:
    """How well a query is understood, 0.05 to 0.99, three decimals."""
    meets = lambda held: F.arrays_overlap(terms, F.array(*[F.lit(x) for x in held]))
    parts = [
        F.when(F.size(terms) < 2, -0.20),
        F.when(meets(AMBIGUOUS), -0.14),
        F.when(meets(NEGATIONS), 0.06),
        F.when(meets(COMPARATORS), 0.05),
        F.least(F.lit(0.12), concepts * 0.04),
        F.when(F.size(added) > 6, -0.05),
    ]
    total = F.lit(0.82)
    for p in parts:
        total = total + F.coalesce(p, F.lit(0.0))
    return F.round(S.clamp(total, 0.05, 0.99), 3)


def reason_codes(raw: Column, terms: Column, added: Column, concepts: Column) -> Column:
    """What was done to a query and why it is trusted or not, in order, as an array."""
    plain = T.normalize_punctuation(raw)
    low = F.lower(plain)
    unit, bare = T.separate_units(low), T.strip_boilerplate(T.separate_units(low))
    text = T.versus_to_vs(bare)
    codes = [F.when(low != plain, "lowercased"), F.when(unit != low, "dose_unit_normalized"), F.when(bare != unit, "boilerplate_removed")]
    codes += [F.when(text.rlike("(?i)" + pattern), reason) for pattern, _, reason in T.COMPARATIVES]
    meets = lambda held: F.arrays_overlap(terms, F.array(*[F.lit(x) for x in held]))
    codes += [
        F.when(F.size(added) > 0, "ontology_expansion_applied"),
        F.when(F.size(terms) < 2, "short_query_penalty"),
        F.when(meets(AMBIGUOUS), "ambiguity_penalty"),
        F.when(meets(NEGATIONS), "negation_preserved"),
        F.when(meets(COMPARATORS), "comparator_preserved"),
        F.when(concepts > 0, "concept_match_bonus"),
        F.when(F.size(added) > 6, "expansion_breadth_penalty"),
    ]
    return F.array_compact(F.array(*codes))


def source_query(source: str, normalized: Column, terms: Column, added: Column) -> Column:
    """A query in one source's language, of its budget's terms; the text itself if there are none."""
    own, more = SOURCE_BUDGETS[source]
    a, b = F.slice(terms, 1, own), F.slice(added, 1, more)
    quoted = lambda t: F.when(t.contains(" "), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t)
    if source in ("openalex", "arxiv"):
        out = F.array_join(F.array_distinct(F.concat(a, b)), " ")
        return F.when(out == "", normalized).otherwise(out)
    field = "[Title/Abstract]" if source == "pubmed" else ""
    part = lambda ts, word: F.array_join(F.transform(ts, lambda t: F.concat(quoted(t), F.lit(field))), word)
    left, right = part(a, " AND " if field else " OR "), part(b, " OR ")
    both = F.concat(left, F.lit(" AND ("), right, F.lit(")")) if field else F.concat(F.lit("("), left, F.lit(") OR ("), right, F.lit(")"))
    return F.when((left != "") & (right != ""), both).when(left != "", left).when(right != "", right).otherwise(normalized)


def understand(queries: DataFrame, column: str = "query") -> DataFrame:
    """``queries`` with normalized, terms, added, confidence, reasons and one query per source."""
    q = queries.withColumn("normalized", T.normalize_query(F.col(column)))
    q = q.withColumn("terms", T.query_terms(F.col("normalized")))
    added, met = concept_terms(F.col("normalized"), F.col("terms"))
    q = q.withColumns({"added": added, "concepts": met})
    q = q.withColumns({"confidence": query_confidence(F.col("terms"), F.col("added"), F.col("concepts")), "reasons": reason_codes(F.col(column), F.col("terms"), F.col("added"), F.col("concepts"))})
    return q.withColumns({f"{s}_query": source_query(s, F.col("normalized"), F.col("terms"), F.col("added")) for s in SOURCE_BUDGETS})


def benchmark(answers: DataFrame) -> DataFrame:
    """``answers`` (corpus, expected, forbidden arrays) with how many of each occur, and pass."""
    hits = lambda terms: F.size(F.filter(terms, lambda t: F.col("corpus").contains(t)))
    out = answers.withColumns({"matched_expected": hits(F.col("expected")), "matched_forbidden": hits(F.col("forbidden"))})
    return out.withColumn("passed", (F.col("matched_expected") == F.size("expected")) & (F.col("matched_forbidden") == 0))


#: Bounds of years, candidates and rows of a request, and defaults of the last two.
YEARS, CANDIDATES, ROWS = (1900, 2100), (100, 5000, 2000), (10, 500, 200)


def sanitize_requests(requests: DataFrame) -> DataFrame:
    """``requests`` (query, from_year, to_year, max_candidates, max_rows) within bounds: years are
    clamped and in order, missing numbers take their default, queries are trimmed."""
    clamp = lambda c, b: F.greatest(F.lit(b[0]), F.least(F.lit(b[1]), c))
    first = clamp(F.coalesce("from_year", F.lit(YEARS[0])), YEARS)
    return requests.withColumns(
        {
            "query": F.trim(F.coalesce("query", F.lit(""))),
            "from_year": first,
            "to_year": F.greatest(first, clamp(F.coalesce("to_year", F.lit(YEARS[1])), YEARS)),
            "max_candidates": clamp(F.coalesce("max_candidates", F.lit(CANDIDATES[2])), CANDIDATES),
            "max_rows": clamp(F.coalesce("max_rows", F.lit(ROWS[2])), ROWS),
        }
    )


def visible_rows(rows: DataFrame, owners: DataFrame, key: str = "user_id") -> DataFrame:
    """Row security: the rows of the given owners alone."""
    return rows.join(owners.select(key).distinct(), key, "left_semi")


def claim_offsets(papers: DataFrame, key: str = "study_id") -> DataFrame:
    """Where each sentence lies in its abstract: (key, at, char_start, char_end), from 0."""
    step = lambda acc, s: F.struct((F.call_function("locate", s, F.col("abstract"), acc["cursor"] + 1) - 1 + F.length(s)).alias("cursor"), F.concat(acc["ends"], F.array(F.call_function("locate", s, F.col("abstract"), acc["cursor"] + 1) - 1 + F.length(s))).alias("ends"))
    start = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<int>").alias("ends"))
    held = papers.select(key, "abstract", T.sentences(F.col("abstract")).alias("parts"))
    each = held.withColumn("ends", F.aggregate("parts", start, step, lambda acc: acc["ends"])).select(key, F.posexplode(F.arrays_zip("parts", "ends")).alias("at", "p"))
    return each.select(key, "at", (F.col("p.ends") - F.length("p.parts")).alias("char_start"), F.col("p.ends").alias("char_end"))


# --- retrieval ------------------------------------------------------------------------------


def fan_out(parts: list[DataFrame]) -> DataFrame:
    """Sources one after the other, with the number of the source and reciprocal rank within it."""
    out = None
    for k, part in enumerate(parts):
        numbered = part.withColumn("provider_ordinal", F.lit(k))
        out = numbered if out is None else out.unionByName(numbered, allowMissingColumns=True)
    return out


def eligible(papers: DataFrame, more_than: int = 50) -> DataFrame:
    """Papers whose abstract is longer than ``more_than`` characters."""
    return papers.where(F.length("abstract") > more_than)


def rank_candidates(papers: DataFrame, keywords: list[str], most: int = 2000) -> DataFrame:
    """The ``most`` best candidates by keywords met, length and citations; ties by study_id."""
    score = F.round(S.candidate_score(F.col("title"), F.col("abstract"), F.col("citation_count"), keywords), 4)
    return papers.withColumn("candidate_score", score).orderBy(F.desc("candidate_score"), "study_id").limit(most)


def expand_citations(seeds: DataFrame, edges: DataFrame, found: DataFrame, most: int = 400) -> DataFrame:
    """Works (cited) that seeds (citing, seed_rank) refer to: the first ``most`` references in
    order of seed and reference, then distinct, then those of ``found`` (cited)."""
    refs = edges.join(seeds, "citing").select("seed_rank", "cited")
    first = refs.orderBy("seed_rank", "cited").limit(most)
    return first.groupBy("cited").agg(F.min("seed_rank").alias("seed_rank")).join(found, "cited", "left_semi")


def coverage_report(log: DataFrame) -> DataFrame:
    """One row from ``log`` (provider, ok): how many were asked and failed, which, and whether
    results are degraded."""
    failed = F.array_join(F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("provider")))), ",")
    return log.agg(F.count_distinct("provider").alias("queried"), F.count_distinct(F.when(~F.col("ok"), F.col("provider"))).alias("failed"), failed.alias("failed_providers"), (F.count_if(~F.col("ok")) > 0).alias("degraded"))


def provider_health(log: DataFrame) -> DataFrame:
    """Per provider: calls, share of errors, mean latency and whether the last call succeeded."""
    by = log.groupBy("provider").agg(F.count(F.lit(1)).alias("calls"), F.round(F.avg((~F.col("ok")).cast("double")), 4).alias("error_rate"), F.round(F.avg("latency_ms"), 2).alias("latency_ms"), F.max_by("ok", F.struct("ts", "call_id")).alias("last_ok"))
    return by


# --- canonical papers -----------------------------------------------------------------------


def merge_groups(papers: DataFrame) -> DataFrame:
    """One paper per ``group_id``: title and authors of the first; of abstract, venue, year and
    identifiers the first that is there; most citations; any retraction; every source and
    reference; where each part came from; rank signals times confidence, summed."""
    first = F.col("paper_id")
    confidence = S.provider_confidence(F.col("source"))
    there = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", first)).alias(c)
    part = F.struct("paper_id", F.col("source").alias("provider"), "rank_signal", confidence.alias("metadata_confidence"))
    return papers.groupBy("group_id").agg(
        F.min_by("title", first).alias("title"),
        *[there(c) for c in ("year", "abstract", "venue", "doi", "pubmed_id", "arxiv_id")],
        F.max("citation_count").alias("citation_count"),
        F.bool_or("is_retracted").alias("is_retracted"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("referenced_ids")))).alias("referenced_ids"),
        F.max(confidence).alias("source_authority"),
        F.array_sort(F.collect_list(part)).alias("provenance"),
        # Summed as decimals: the order of doubles would show.
        F.round(F.sum((F.col("rank_signal") * confidence).cast("decimal(18,8)")), 4).cast("double").alias("relevance"),
    )


def score_papers(papers: DataFrame, current_year: int, from_year: int = 1900, to_year: int = 2100, exclude_preprints: bool = False) -> DataFrame:
    """Five parts of quality, their weighted sum and the first reason to reject, or null."""
    hint = S.design_hint(F.col("title"), F.col("abstract"), F.array().cast("array<string>"), F.col("source"))
    preprint = F.col("preprint_status") == "Preprint"
    parts = {
        "source_authority": S.clamp(F.greatest(S.provider_confidence(F.col("source")), F.lit(0.25))),
        "study_design_strength": S.design_strength(hint, preprint),
        "methods_transparency": S.methods_transparency(F.col("abstract")),
        "citation_impact": S.citation_impact(F.col("citation_count"), F.col("year"), current_year),
        "recency_fit": S.recency_fit(F.col("year"), current_year, (from_year, to_year)),
    }
    total = sum((parts[k] * w for k, w in S.PAPER_WEIGHTS.items()), F.lit(0.0))
    low = F.lower(F.concat_ws(" ", "title", "abstract"))
    scored = papers.withColumns({**{k: F.round(v, 4) for k, v in parts.items()}, "q_total": F.round(total, 4)})
    unclear = S.any_of(low, S.EMPIRICAL_SIGNALS) & ~S.any_of(F.lower("abstract"), S.METHODS_PRESENT) & (F.col("methods_transparency") < 0.35)
    reason = (
        F.when(F.col("is_retracted"), "retracted_or_invalidated")
        .when(F.lit(exclude_preprints) & preprint, "preprint_excluded")
        .when(S.has_year(F.col("year")) & ~F.col("year").between(from_year, to_year), "outside_requested_timeframe")
        .when(unclear, "missing_methodological_metadata")
        .when(F.col("q_total") < 0.6, "quality_below_threshold")
    )
    return scored.withColumn("reject_reason", reason)


def kept_papers(scored: DataFrame, most: int = 2000) -> DataFrame:
    """Papers that aren't rejected, best first, with their rank; ties by id.

    Rejected papers sort last and go after the top-k: a filter before it would be pushed below
    the scores and work each of them out several times.
    """
    order = [F.desc("q_total"), F.desc("citation_count"), F.col("study_id")]
    kept = scored.orderBy(F.col("reject_reason").isNotNull(), *order).limit(most).where("reject_reason is null")
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


# --- claims -----------------------------------------------------------------------------------


def claims(papers: DataFrame, key: str = "study_id") -> DataFrame:
    """Every claim sentence of the abstracts: (key, at, sentence, outcome, direction)."""
    each = papers.select(key, F.posexplode(T.sentences(F.col("abstract"))).alias("at", "sentence")).where(X.is_claim(F.col("sentence")))
    return each.withColumns({"outcome": X.claim_outcome(F.col("sentence")), "direction": X.claim_direction(F.col("sentence"))})


def disposition(positive: Column, negative: Column, neutral: Column) -> Column:
    return F.when((positive > 0) & (negative > 0), "conflicting").when((positive > 0) & (neutral == 0), "consensus_positive").when((negative > 0) & (neutral == 0), "consensus_negative").otherwise("mixed")


def greedy_clusters(found: DataFrame, batch: str, key: str = "study_id", threshold: float = 0.42, order: str | None = None) -> DataFrame:
    """Claims of each query's batch (column ``batch``, at most some thousand claims by the limits
    of a search) by ``order`` (the key unless given) and sentence: each joins the cluster of the best Jaccard, at least ``threshold``,
    whose token set grows by it, or opens one.  Order decides, so a batch is one task's."""
    schema = T_.StructType([T_.StructField(batch, T_.StringType()), T_.StructField(key, found.schema[key].dataType), T_.StructField("at", T_.IntegerType()), T_.StructField("cluster", T_.IntegerType())])
    rows = found.select(F.col(batch).cast("string").alias(batch), key, F.col(order or key).alias("order"), F.col("at").cast("int").alias("at"), H.claim_tokens(F.concat_ws(" ", "outcome", "sentence")).alias("tokens"))
    # Dealt over all cores by search: claims are small for the work they are, and would be given to few tasks.
    rows = spread(rows, batch).sortWithinPartitions(batch, F.asc_nulls_last("order"), "at")

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = object(), []
        for part in batches:
            numbers = []
            for name, tokens in zip(part.column(batch).to_pylist(), part.column("tokens").to_pylist(), strict=True):
                if name != of:
                    of, held = name, []
                own, best, score = set(tokens), -1, -1.0
                for i, h in enumerate(held):
                    shared = len(own & h)
                    s = shared / (len(own) + len(h) - shared) if shared else 0.0
                    if s > score:
                        best, score = i, s
                if best >= 0 and score >= threshold:
                    held[best] |= own
                else:
                    best = len(held)
                    held.append(own)
                numbers.append(best)
            yield pa.RecordBatch.from_arrays([part.column(batch), part.column(key), part.column("at"), pa.array(numbers, pa.int32())], names=[batch, key, "at", "cluster"])

    return rows.mapInArrow(cluster, schema)


def kept_by_search(scored: DataFrame, batch: str, most: int = 2000, key: str = "study_id") -> DataFrame:
    """``kept_papers`` of every search of the column ``batch``, each ranked from 1."""
    order = [F.col("reject_reason").isNotNull(), F.desc("q_total"), F.desc("citation_count"), F.col(key)]
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(batch).orderBy(*order)))
    return ranked.where(F.col("reject_reason").isNull() & (F.col("rank") <= most))


def anchored_claims(papers: DataFrame, batch: str, key: str = "study_id") -> DataFrame:
    """``claims`` of ranked papers of searches, with their place in the abstract (from 0) and the
    sentence's hash: (batch, key, rank, at, sentence, outcome, direction, char_start, char_end, snippet_hash)."""
    places = claim_offsets(papers.select(F.struct(batch, key, "rank").alias("of"), "abstract"), "of")
    each = claims(papers.select(F.struct(batch, key, "rank").alias("of"), "abstract"), "of")
    return each.join(places, ["of", "at"]).select("of.*", "at", "sentence", "outcome", "direction", "char_start", "char_end", fnv1a(F.col("sentence")).alias("snippet_hash"))


def clustered_claims(found: DataFrame, batch: str, key: str = "study_id", threshold: float = 0.42) -> DataFrame:
    """``anchored_claims`` with the cluster of each, in order of rank and sentence."""
    numbers = greedy_clusters(found, batch, key, threshold, order="rank")
    return found.withColumn(batch, F.col(batch).cast("string")).withColumn("at", F.col("at").cast("int")).join(numbers, [batch, key, "at"])


def claim_clusters(clustered: DataFrame, batch: str, key: str = "study_id") -> DataFrame:
    """Every search's clusters: (batch, cluster, cluster_id, label, claims, positive, negative,
    neutral, disposition); label and id are those of the claim that opened it."""
    counts = [F.count_if(F.col("direction") == d).alias(d) for d in ("positive", "negative", "neutral")]
    first = F.min(F.struct("rank", "at", key, "outcome", "sentence")).alias("first")
    grouped = clustered.groupBy(batch, "cluster").agg(F.count(F.lit(1)).alias("claims"), *counts, first)
    name = F.concat(F.lit("cluster_"), fnv1a(F.concat_ws("|", F.col(f"first.{key}").cast("string"), "first.sentence")))
    return grouped.select(batch, "cluster", name.alias("cluster_id"), F.col("first.outcome").alias("label"), "claims", "positive", "negative", "neutral", disposition(F.col("positive"), F.col("negative"), F.col("neutral")).alias("disposition"))


def propositions(clustered: DataFrame, clusters: DataFrame, batch: str, key: str = "study_id") -> DataFrame:
    """Each paper's disposition over its claims' clusters; ``mixed`` where they differ."""
    joined = clustered.join(clusters.select(batch, "cluster", "disposition"), [batch, "cluster"])
    per = joined.groupBy(batch, key).agg(F.min("disposition").alias("least"), F.max("disposition").alias("most"))
    return per.select(batch, key, F.when(F.col("least") == F.col("most"), F.col("least")).otherwise("mixed").alias("proposition"))


#: A paper's identifiers and parts of quality in the evidence table, as far as it has them.
IDENTIFIERS = ("authors", "venue", "doi", "pubmed_id", "openalex_id", "arxiv_id")
QUALITY = ("source_authority", "study_design_strength", "methods_transparency", "citation_impact", "recency_fit", "q_total")


def evidence_table(ranked: DataFrame, stances: DataFrame, batch: str, most: int = 200, key: str = "study_id") -> DataFrame:
    """The first ``most`` papers of every search: identifiers, snippet (of the abstract, else the
    title), proposition, the parts of quality and where the paper came from."""
    rows = ranked.where(F.col("rank") <= most).withColumn(batch, F.col(batch).cast("string")).join(stances, [batch, key], "left")
    snippet = T.shortened(F.coalesce(F.nullif("abstract", F.lit("")), "title"), 280).alias("snippet")
    came = F.struct(F.col("source").alias("provider"), F.col(key).cast("string").alias("external_id"), S.provider_confidence(F.col("source")).alias("metadata_confidence")).alias("provenance")
    held = [c for c in (*IDENTIFIERS, *QUALITY) if c in ranked.columns]
    return rows.select(batch, "rank", key, "title", "year", *held, snippet, F.coalesce("proposition", F.lit("mixed")).alias("proposition"), came)


# --- the brief --------------------------------------------------------------------------------

#: A brief's sentence and stance by disposition, and its other sentences.
BRIEF = {
    "conflicting": ("Evidence for %s is conflicting across the retrieved studies, with both positive and negative directions reported.", "conflicting"),
    "consensus_positive": ("Most studies indicate a positive association for %s.", "positive"),
    "consensus_negative": ("Most studies indicate a negative association for %s.", "negative"),
    "mixed": ("Findings related to %s are mixed and likely context-dependent.", "mixed"),
}
OVERVIEW = "The search retained %d quality-screened studies after multi-source retrieval and strict filtering."
UNRESOLVED = "At least one major proposition remains unresolved, so conclusions should be interpreted with explicit uncertainty."
NOTHING = "No high-confidence effect statements were extractable from abstracts, so interpretation remains limited."


def evidence_brief(ranked: DataFrame, clustered: DataFrame, clusters: DataFrame, batch: str, key: str = "study_id") -> DataFrame:
    """Rows (batch, position, text, stance, citations): the brief of every search with a kept paper.

    An overview that cites the three best papers; a sentence for each of the three largest
    clusters (ties by their opening) with its first three claims; a warning if any cluster is
    conflicting, with two claims of each of these and three in all; one sentence of its own if
    there are no claims.  A citation is (paper, char_start, char_end, snippet_hash), a place in
    the paper's abstract and the hash of what stands there.
    """
    ranked = ranked.withColumn(batch, F.col(batch).cast("string"))
    cite = lambda start, end, text: F.struct(F.col(key).cast("string").alias("paper"), start.cast("int").alias("char_start"), end.cast("int").alias("char_end"), text.alias("snippet_hash"))
    in_order = lambda *by: F.transform(F.array_sort(F.collect_list(F.struct(*by, "c"))), lambda x: x["c"])
    shown = F.least(F.length(F.coalesce(F.nullif("abstract", F.lit("")), "title")), F.lit(160))
    best = ranked.where("rank <= 3").select(batch, "rank", cite(F.lit(0), shown, fnv1a(F.concat(F.col(key).cast("string"), F.lit("|overview")))).alias("c"))
    number = ranked.groupBy(batch).agg(F.count(F.lit(1)).alias("n")).join(best.groupBy(batch).agg(in_order("rank").alias("citations")), batch)
    # The first claims of every cluster are kept where they are made.
    nth = F.row_number().over(Window.partitionBy(batch, "cluster").orderBy("rank", "at"))
    early = clustered.withColumn("nth", nth).where("nth <= 3").select(batch, "cluster", "nth", cite(F.col("char_start"), F.col("char_end"), F.col("snippet_hash")).alias("c"))
    anchors = early.groupBy(batch, "cluster").agg(in_order("nth").alias("citations"))
    order = [F.desc("claims"), F.col("cluster")]
    placed = clusters.withColumns({"place": F.row_number().over(Window.partitionBy(batch).orderBy(*order)), "torn": F.row_number().over(Window.partitionBy(batch, "disposition").orderBy(*order))})
    text, stance = F, F
    for name, (sentence, word) in BRIEF.items():
        text, stance = text.when(F.col("disposition") == name, F.format_string(sentence, "label")), stance.when(F.col("disposition") == name, word)
    said = placed.where("place <= 3").join(anchors, [batch, "cluster"]).select(batch, F.col("place").alias("position"), text.alias("text"), stance.alias("stance"), "citations")
    # A conflicting cluster has two claims at least, so two of them give the three citations.
    torn = placed.where("disposition = 'conflicting' and torn <= 2").join(anchors, [batch, "cluster"]).select(batch, "torn", F.slice("citations", 1, 2).alias("c"))
    after = placed.groupBy(batch).agg((F.least(F.max("place"), F.lit(3)) + 1).alias("position"))
    warning = torn.groupBy(batch).agg(F.slice(F.flatten(in_order("torn")), 1, 3).alias("citations")).join(after, batch).select(batch, "position", F.lit(UNRESOLVED).alias("text"), F.lit("conflicting").alias("stance"), "citations")
    opened = number.select(batch, F.lit(0).alias("position"), F.format_string(OVERVIEW, "n").alias("text"), F.lit("neutral").alias("stance"), "citations")
    silent = number.join(clusters.select(batch).distinct(), batch, "left_anti").select(batch, F.lit(1).alias("position"), F.lit(NOTHING).alias("text"), F.lit("neutral").alias("stance"), "citations")
    return opened.unionByName(said).unionByName(warning).unionByName(silent)

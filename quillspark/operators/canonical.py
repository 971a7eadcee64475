"""Canonical papers in order of arrival.

A paper joins the canonical paper of the last earlier one with an identifier of its own; if no
earlier paper has any, the earliest canonical paper whose title, authors and year are like its
own; else it becomes canonical itself.  Identifiers lead to an earlier paper whatever that became,
so they are settled at once; the texts are settled in rounds, in each of which every paper is
decided all of whose earlier like ones are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import doi as D
from ..functions import similarity as H
from ..storage import materialise, release
from .graph import components
from .slices import latest_before

#: Jaccard of titles and of authors from which two papers are one.
TITLES, AUTHORS = 0.78, 0.2


def _by_identifier(papers: DataFrame) -> DataFrame:
    """Rows (arrival, leader): the first paper of the chain of identifiers that each belongs to.

    Of a paper's identifiers the first kind that was seen before decides (doi, pmid, arxiv)."""
    arxiv = F.coalesce(F.nullif(F.col("arxiv_id").cast("string"), F.lit("")), F.when(F.col("source") == "arxiv", F.col("paper_id")))
    kinds = [D.retrieval_doi(F.col("doi")), F.col("pubmed_id").cast("string"), arxiv]
    held = F.array(*[F.struct(F.lit(k).alias("kind"), F.concat(F.lit(f"{k}:"), F.nullif(v, F.lit(""))).alias("key")) for k, v in enumerate(kinds)])
    keys = materialise(papers.select("arrival", F.explode(F.filter(held, lambda x: x["key"].isNotNull())).alias("i")).select("arrival", "i.kind", "i.key", F.col("arrival").alias("own")), "keys")
    seen = latest_before(keys, "key", "arrival", "own").where("latest is not null")
    parents = seen.groupBy("arrival").agg(F.min_by("latest", "kind").alias("parent"))
    found = components(parents.select(F.col("parent").alias("a"), F.col("arrival").alias("b")))
    leaders = found.groupBy("component").agg(F.min("node").alias("leader"))
    return found.join(leaders, "component").select(F.col("node").alias("arrival"), "leader")


def _like_texts(texts: DataFrame) -> DataFrame:
    """Pairs (r, t), r < t, of ``texts`` (id, year, tokens, names) whose titles and authors are
    alike and whose years, if both have one, are at most one apart.

    They meet by a title token, of those that the Jaccard needs one of (the rarest first), and an
    author token, of which it needs one as well; arrays are joined to the pairs of ids alone."""
    each = texts.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    rarity = each.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    order = Window.partitionBy("id").orderBy("uses", "token")
    rare = each.join(rarity, "token").withColumn("at", F.row_number().over(order)).where(F.col("at") <= F.col("n") - F.ceil(TITLES * F.col("n")) + 1)
    names = texts.select("id", "year", F.size("tokens").alias("size"), F.explode("names").alias("name"))
    keyed = materialise(rare.select("id", "token").join(names, "id").select("id", "year", "size", F.xxhash64("token", "name").alias("key")), "keyed")
    a, b = keyed.alias("a"), keyed.alias("b")
    years = F.coalesce(F.abs(F.col("a.year") - F.col("b.year")) <= 1, F.lit(True))
    sizes = F.least("a.size", "b.size") >= TITLES * F.greatest("a.size", "b.size")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & years & sizes).select(F.col("a.id").alias("r"), F.col("b.id").alias("t")).distinct()
    left = met.join(texts.select(F.col("id").alias("r"), F.col("year").alias("r_year"), F.col("tokens").alias("tokens_a"), F.col("names").alias("names_a")), "r")
    both = left.join(texts.select(F.col("id").alias("t"), F.col("year").alias("t_year"), F.col("tokens").alias("tokens_b"), F.col("names").alias("names_b")), "t")
    alike = (H.jaccard(F.col("tokens_a"), F.col("tokens_b")) >= TITLES) & (H.jaccard(F.col("names_a"), F.col("names_b")) >= AUTHORS)
    return both.where(alike).select("r", "t", "r_year", "t_year")


def _settled(edges: DataFrame, firsts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (node, root) of ``ids``: each node's canonical one, by ``edges`` (r, t, r_year, t_year).

    A canonical paper without a year takes that of the first of its papers that has one
    (``firsts``: node, first (at, year)), and is compared by it from then on.  Such an edge waits
    until no earlier paper can bring a year any more.  The smallest undecided paper is always
    decided, and all others whose earlier ones are; most take a round or two.
    """
    edges = materialise(edges, "edges")
    decided = materialise(ids.join(edges.select(F.col("t").alias("node")).distinct(), "node", "left_anti").select("node", F.col("node").alias("root")), "decided")
    while not edges.isEmpty():
        state = edges.join(decided.select(F.col("node").alias("r"), "root"), "r", "left").where("root is null or root = r")
        pending = edges.groupBy("r").agg(F.min("t").alias("pending"))
        years = decided.join(firsts, "node").groupBy(F.col("root").alias("r")).agg(F.min("first").alias("first"))
        known = state.join(pending, "r").join(years, "r", "left")
        brought = F.coalesce(F.col("first.at") < F.col("t"), F.lit(False))
        final = (F.col("pending") == F.col("t")) | (brought & (F.col("first.at") < F.col("pending")))
        by_year = F.when(final & brought, F.abs(F.col("first.year") - F.col("t_year")) <= 1).when(final, True)
        joins = F.when(F.col("root").isNull(), F.lit(None)).when(F.col("r_year").isNotNull() | F.col("t_year").isNull(), True).otherwise(by_year)
        known = materialise(known.select("r", "t", "r_year", "t_year", joins.cast("boolean").alias("joins")).where("joins is null or joins"), "known")
        choice = known.groupBy("t").agg(F.min(F.when(F.col("joins"), F.col("r"))).alias("hit"), F.min(F.when(F.col("joins").isNull(), F.col("r"))).alias("wait"))
        asked = edges.select("t").distinct().join(choice, "t", "left")
        new = asked.where("wait is null or hit < wait").select(F.col("t").alias("node"), F.coalesce("hit", "t").alias("root"))
        grown = materialise(decided.unionByName(new), "decided")
        fewer = materialise(known.drop("joins").join(grown.select(F.col("node").alias("t")), "t", "left_anti"), "edges")
        for done in (edges, decided, known):
            release(done)
        edges, decided = fewer, grown
    release(edges)
    return decided


def arrival_groups(papers: DataFrame) -> DataFrame:
    """``papers`` (arrival, paper_id, source, doi, pubmed_id, arxiv_id, title, authors, year and any
    others) with ``group_id``, the paper_id of the canonical paper each becomes part of.

    ``arrival`` is a number of its own for every paper.  Papers of equal words, names and year
    are decided once, with the first of them: the others come after it and meet the same
    canonical papers, or itself.  Titles or authors without a word match nothing.
    """
    chains = _by_identifier(papers)
    base = papers.select("arrival", F.nullif("year", F.lit(0)).alias("year"), F.array_sort(H.claim_tokens(F.coalesce("title", F.lit("")))).alias("tokens"), F.array_sort(H.claim_tokens(F.array_join("authors", " "))).alias("names"))
    base = materialise(base.join(chains, "arrival", "left").withColumn("leader", F.coalesce("leader", "arrival")), "base")
    # The first year in each chain, by which its leader's canonical paper may get one.
    first = base.where("year is not null").groupBy("leader").agg(F.min(F.struct(F.col("arrival").alias("at"), "year")).alias("first"))
    heads = base.where("leader = arrival")
    blank = (F.coalesce(F.size("tokens"), F.lit(0)) <= 0) | (F.coalesce(F.size("names"), F.lit(0)) <= 0)
    kind = F.when(blank, F.array(F.col("arrival").cast("string"))).otherwise(F.concat(F.col("tokens"), F.array(F.lit("|")), F.col("names")))
    marked = heads.withColumn("kind", F.array_join(kind, " "))
    kinds = marked.groupBy("kind", "year").agg(F.min("arrival").alias("id"), F.min_by("tokens", "arrival").alias("tokens"), F.min_by("names", "arrival").alias("names"))
    kinds = materialise(kinds, "kinds")
    of_kind = materialise(marked.join(kinds.select("kind", F.col("year").alias("of_year"), "id"), "kind").where(F.col("year").eqNullSafe(F.col("of_year"))).select("arrival", "id"), "of_kind")
    firsts = of_kind.join(first, of_kind["arrival"] == first["leader"]).groupBy(F.col("id").alias("node")).agg(F.min("first").alias("first"))
    texts = kinds.where(F.size("tokens") > 0).where(F.size("names") > 0).select("id", "year", "tokens", "names")
    roots = _settled(_like_texts(texts), materialise(firsts, "firsts"), kinds.select(F.col("id").alias("node")))
    named = papers.select(F.col("arrival").alias("root"), F.col("paper_id").alias("group_id"))
    of_head = of_kind.join(roots, of_kind["id"] == roots["node"]).select(F.col("arrival").alias("leader"), "root").join(named, "root").select("leader", "group_id")
    return papers.join(base.select("arrival", "leader").join(of_head, "leader").select("arrival", "group_id"), "arrival")

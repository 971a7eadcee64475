"""Readers of saved provider payloads.  No network: payloads lie in files that Spark reads.

Schemas are declared, so nothing is inferred and unused fields are pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import doi as D
from ..functions import text as T

#: Columns that every mapper gives.
PAPER = ["paper_id", "title", "abstract", "authors", "year", "venue", "doi", "source", "citation_count"]
OPENALEX = "id string, title string, publication_year int, doi string, cited_by_count int, abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<display_name:string>>>, primary_location struct<source:struct<display_name:string>>, referenced_works array<string>"
SEMANTIC_SCHOLAR = "paperId string, title string, abstract string, year int, venue string, citationCount int, authors array<struct<name:string>>, externalIds struct<DOI:string>"
CROSSREF = "DOI string, title array<string>, `container-title` array<string>, author array<struct<given:string,family:string>>, issued struct<`date-parts`:array<array<int>>>, `is-referenced-by-count` int"


def _or(value: Column, default: str) -> Column:
    return F.coalesce(D.none_if_empty(F.trim(value)), F.lit(default))


def _authors(names: Column) -> Column:
    held = F.filter(names, lambda n: F.coalesce(F.trim(n), F.lit("")) != "")
    return F.when(F.coalesce(F.size(held), F.lit(0)) > 0, held).otherwise(F.array(F.lit("Unknown")))


def openalex(spark: SparkSession, path: str, current_year: int) -> DataFrame:
    """Works as JSON lines; abstracts come from their inverted index."""
    raw = spark.read.schema(OPENALEX).json(path)
    return raw.select(
        F.col("id").alias("paper_id"), _or(F.col("title"), "Untitled").alias("title"), F.coalesce(T.abstract_of(F.col("abstract_inverted_index")), F.lit("")).alias("abstract"),
        _authors(F.transform("authorships", lambda a: a["author"]["display_name"])).alias("authors"), F.coalesce("publication_year", F.lit(current_year)).alias("year"),
        F.col("primary_location.source.display_name").alias("venue"), D.retrieval_doi(F.col("doi")).alias("doi"), F.lit("openalex").alias("source"), F.col("cited_by_count").alias("citation_count"),
    )


def semantic_scholar(spark: SparkSession, path: str, current_year: int, most: int = 50) -> DataFrame:
    """Papers as JSON lines with abstracts of more than 50 characters, ``most`` of them by id."""
    raw = spark.read.schema(SEMANTIC_SCHOLAR).json(path).where(F.length("abstract") > 50)
    return raw.orderBy("paperId").limit(most).select(
        F.col("paperId").alias("paper_id"), _or(F.col("title"), "Untitled").alias("title"), "abstract", _authors(F.col("authors.name")).alias("authors"),
        F.coalesce("year", F.lit(current_year)).alias("year"), "venue", D.retrieval_doi(F.col("externalIds.DOI")).alias("doi"), F.lit("semantic_scholar").alias("source"), F.col("citationCount").alias("citation_count"),
    )


def crossref(spark: SparkSession, path: str, current_year: int) -> DataFrame:
    raw = spark.read.schema(CROSSREF).json(path)
    year = F.try_element_at(F.try_element_at(F.col("issued")["date-parts"], F.lit(1)), F.lit(1))
    return raw.select(
        F.col("DOI").alias("paper_id"), _or(F.try_element_at("title", F.lit(1)), "Untitled").alias("title"), F.lit("").alias("abstract"),
        _authors(F.transform("author", lambda a: F.concat_ws(" ", a["given"], a["family"]))).alias("authors"), F.coalesce(year, F.lit(current_year)).alias("year"),
        F.try_element_at(F.col("container-title"), F.lit(1)).alias("venue"), D.retrieval_doi(F.col("DOI")).alias("doi"), F.lit("crossref").alias("source"), F.col("is-referenced-by-count").alias("citation_count"),
    )


def pubmed(spark: SparkSession, path: str, current_year: int) -> DataFrame:
    """PubMed articles in XML with abstracts of 50 characters or more."""
    article = "MedlineCitation struct<PMID:string,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<string>>,Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:int>>>,AuthorList:struct<Author:array<struct<LastName:string,Initials:string>>>>>"
    raw = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(article).load(path)
    a = F.col("MedlineCitation.Article")
    text = F.array_join(a["Abstract"]["AbstractText"], " ")
    return raw.where(F.length(text) >= 50).select(
        F.col("MedlineCitation.PMID").alias("paper_id"), _or(T.without_tags(a["ArticleTitle"]), "Untitled").alias("title"), T.without_tags(text).alias("abstract"),
        _authors(F.transform(a["AuthorList"]["Author"], lambda x: F.concat_ws(" ", x["LastName"], x["Initials"]))).alias("authors"), F.coalesce(a["Journal"]["JournalIssue"]["PubDate"]["Year"], F.lit(current_year)).alias("year"),
        a["Journal"]["Title"].alias("venue"), F.lit(None).cast("string").alias("doi"), F.lit("pubmed").alias("source"), F.lit(None).cast("int").alias("citation_count"),
    )


def arxiv(spark: SparkSession, path: str, current_year: int) -> DataFrame:
    """Atom entries with abstracts of 50 characters or more; error entries and versions are dropped."""
    entry = "id string, title string, summary string, published string, author array<struct<name:string>>"
    raw = spark.read.format("xml").option("rowTag", "entry").schema(entry).load(path)
    kept = raw.where((F.trim("title") != "Error") & (F.length(F.trim("summary")) >= 50))
    return kept.select(
        F.regexp_replace(F.regexp_extract("id", r"abs/(.+)$", 1), r"v\d+$", "").alias("paper_id"), _or(T.collapse(F.col("title")), "Untitled").alias("title"), T.collapse(F.col("summary")).alias("abstract"),
        _authors(F.col("author.name")).alias("authors"), F.coalesce(F.try_to_number(F.substring("published", 1, 4), F.lit("9999")).cast("int"), F.lit(current_year)).alias("year"), F.lit("arXiv").alias("venue"),
        F.lit(None).cast("string").alias("doi"), F.lit("arxiv").alias("source"), F.lit(None).cast("int").alias("citation_count"),
    )


def extracted_texts(spark: SparkSession, path: str, most_bytes: int = 15_000_000) -> DataFrame:
    """Text files of papers (already extracted from PDF) by the binary source: path and text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= most_bytes)
    return raw.select("path", T.joined_hyphens(F.decode("content", F.lit("UTF-8"))).alias("text"))


def as_stream_events(turns: DataFrame) -> DataFrame:
    """Conversation answers as the events of a token stream: two ``data:`` lines a turn, then the
    one that ends it, and a late one that nobody reads."""
    half = F.floor(F.length("text") / 2).cast("int")
    parts = F.array(F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text")))
    line = lambda t: F.concat(F.lit("data: "), F.to_json(F.struct(t.alias("delta"))))
    lines = F.concat(F.transform(parts, line), F.array(F.lit("data: [DONE]"), line(F.lit("late"))))
    return turns.where("role = 'assistant'").select("conv_id", "turn", F.posexplode(lines).alias("seq", "line"))


def joined_stream(events: DataFrame) -> DataFrame:
    """Deltas of ``data:`` lines (conv_id, turn, seq, line) in order as one answer; a turn ends at
    its ``[DONE]``, whatever comes after it."""
    payload = F.regexp_extract("line", r"(?s)^data:\s*(.*)$", 1)
    held = events.select("conv_id", "turn", F.struct("seq", payload.alias("payload")).alias("e")).where("e.payload <> ''")
    turns = held.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list("e")).alias("es"))
    stop = F.array_position(F.transform("es", lambda e: e["payload"]), "[DONE]").cast("int")
    sent = F.when(stop > 0, F.slice("es", F.lit(1), stop - 1)).otherwise(F.col("es"))
    deltas = F.transform(sent, lambda e: F.coalesce(F.from_json(e["payload"], "delta string")["delta"], F.lit("")))
    parts = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.array_join(deltas, "").alias("said")))).alias("ts"))
    return parts.select("conv_id", F.array_join(F.transform("ts", lambda t: t["said"]), "").alias("answer"))

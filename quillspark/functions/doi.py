"""Identifier normalisers.  Five forms exist side by side and differ in what they strip."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The URL forms of an identifier, and the shape of a valid one.
URL_PREFIX = r"^https?://(dx\.)?doi\.org/"
VALID = r"(?i)^10\.[0-9]{4,9}/[-._;()/:a-z0-9]+$"


def none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def normalize_doi(raw: Column) -> Column:
    """For deduplication: trimmed, lower-cased, all URL prefixes and one ``doi:`` off, no white
    space, no punctuation at either end; null if nothing is left."""
    text = F.lower(F.trim(raw))
    text = F.regexp_replace(text, r"^(https?://(dx\.)?doi\.org/)+", "")
    text = F.regexp_replace(text, r"^doi:\s*", "")
    text = F.regexp_replace(text, r"\s+", "")
    return none_if_empty(F.regexp_replace(F.regexp_replace(text, r"^\p{Punct}+", ""), r"\p{Punct}+$", ""))


def retrieval_doi(raw: Column) -> Column:
    """For retrieval: trimmed, lower-cased, one URL prefix off."""
    return F.regexp_replace(F.lower(F.trim(raw)), URL_PREFIX, "")


def enrichment_doi(raw: Column) -> Column:
    """For enrichment: as for retrieval, then ``doi:`` off; null if nothing is left."""
    return none_if_empty(F.trim(F.regexp_replace(retrieval_doi(raw), r"^doi:\s*", "")))


def download_doi(raw: Column) -> Column:
    """For lookups: the URL prefix off in any case; the rest keeps its case."""
    return F.trim(F.regexp_replace(F.trim(raw), "(?i)" + URL_PREFIX, ""))


def is_valid_doi(doi: Column) -> Column:
    """Whether an identifier has the registered shape; null is not valid."""
    return F.coalesce(doi.rlike(VALID), F.lit(False))

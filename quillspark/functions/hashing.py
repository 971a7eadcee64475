"""Fingerprints and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def record_fingerprint(title_norm: Column, authors_norm: Column, year: Column) -> Column:
    """SHA-256 of the normalised title, authors and year; missing parts count as empty."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (title_norm, authors_norm, year)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def title_fingerprint(title: Column, lead_author: Column, year: Column) -> Column:
    """SHA-1 of normalised title, lead author and year, or ``na`` for no year."""
    return F.sha1(F.concat_ws("|", F.coalesce(title, F.lit("")), F.coalesce(lead_author, F.lit("")), F.coalesce(F.nullif(year.cast("string"), F.lit("0")), F.lit("na"))))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the characters of a text, eight hex digits; for characters of the
    basic plane.  An empty text gives the offset basis."""
    basis, prime, mask = F.lit(2166136261).cast("long"), F.lit(16777619).cast("long"), F.lit(4294967295).cast("long")
    codes = F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substring(text, i, F.lit(1))).cast("long")))
    state = F.aggregate(F.coalesce(codes, F.array().cast("array<bigint>")), basis, lambda h, c: (h.bitwiseXOR(c) * prime).bitwiseAND(mask))
    return F.lpad(F.lower(F.hex(state)), 8, "0")

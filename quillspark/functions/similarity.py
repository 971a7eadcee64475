"""Similarity of texts, names and years, all by array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CLAIM_STOP_WORDS, words


def trigrams(text: Column) -> Column:
    """Distinct 3-grams of each word, padded by two spaces before and one after."""
    padded = lambda w: F.concat(F.lit("  "), w, F.lit(" "))
    grams = F.transform(words(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(padded(w), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def author_token_overlap(a: Column, b: Column) -> Column:
    """Shared over the fewer of the names joined by ``|``, three decimals; 0 if either is empty."""
    left, right = (F.array_distinct(words(F.coalesce(x, F.lit("")), r"\|")) for x in (a, b))
    fewest = F.least(F.size(left), F.size(right))
    return F.round(F.when(fewest == 0, F.lit(0).cast("decimal(6,3)")).otherwise((F.size(F.array_intersect(left, right)) / F.nullif(fewest, F.lit(0))).cast("decimal(6,3)")), 3)


def claim_tokens(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text), "[^a-z0-9]+", 2, CLAIM_STOP_WORDS))


def match_tokens(normalized: Column) -> Column:
    return F.array_distinct(words(normalized, r"\s+", 1))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters, spaces included."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(F.length(text) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def dice(x: Column, y: Column) -> Column:
    """Twice the shared over all elements of two sets; 0 if either is empty."""
    total = F.size(x) + F.size(y)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / F.nullif(total, F.lit(0)))


def combined(words_a: Column, words_b: Column, grams_a: Column, grams_b: Column) -> Column:
    """0.6 of the token Jaccard and 0.4 of the bigram Dice of two texts' sets."""
    return 0.6 * jaccard(words_a, words_b) + 0.4 * dice(grams_a, grams_b)


def text_similarity(a: Column, b: Column) -> Column:
    """``combined`` of two normalised texts; 0 if either is empty."""
    return F.when((a == "") | (b == ""), 0.0).otherwise(combined(match_tokens(a), match_tokens(b), bigrams(a), bigrams(b)))


def author_overlap(a: Column, b: Column) -> Column:
    """Shared over the more of the first six normalised names; 0 if either has none."""
    x, y = F.slice(a, 1, 6), F.slice(b, 1, 6)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y)))


def year_similarity(a: Column, b: Column) -> Column:
    """1 for equal years, 0.5 for neighbours, else 0; missing years count as different."""
    gap = F.abs(a - b)
    return F.when(gap == 0, 1.0).when(gap == 1, 0.5).otherwise(0.0)


def within_edits(a: Column, b: Column, short: int = 40) -> Column:
    """Whether two titles are within 2 edits, or 3 if longer than ``short``."""
    most = F.when(F.greatest(F.length(a), F.length(b)) <= short, 2).otherwise(3)
    return F.levenshtein(a, b) <= most

"""Small tables with the cases that every operator must stand."""

import random

LONG = "word " * 30_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, key string"


def odd_documents(spark, extra=()):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing columns."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs home again", "en", "a", 10, 0.5, 7, "k"),
        (1, "The quick brown fox jumps over the lazy dog and runs home again", "en", "a", 10, 0.5, 7, "k"),
        (2, None, "en", "a", None, None, None, None),
        (3, "", None, "b", 0, None, None, None),
        (4, "   \t\n", "fr", None, 4, None, None, None),
        (5, LONG, "en", "a", len(LONG), None, None, None),
        (None, "a text without an identifier", "en", "c", 5, None, None, None),
        (6, "naïve café – 東京 🙂 <|endoftext|> it's", "fr", "c", 5, None, None, None),
        (7, "12345 !!! ###", "de", "c", 5, None, None, None),
        *extra,
    ]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, words, size=900):
    """Invented words in a fixed random order."""
    rng = random.Random(seed)
    vocab = [f"{a}{b}{c}" for a in ("ba", "ke", "li", "mo", "nu", "ra", "se", "ti", "vo", "zu") for b in ("n", "r", "st", "l", "m", "d", "k", "p", "x") for c in ("a", "e", "i", "o", "u", "an", "er", "is", "on", "um")]
    return " ".join(rng.choice(vocab[:size]) for _ in range(words))

"""Text normalisers, tokenisers and formatters."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .doi import none_if_empty

#: Stop words of query understanding.
QUERY_STOP_WORDS = (
    "what are is the a an of for with to in on and or how does do can could would should will that this these those it its be been being was "
    "were has have had but by from at as into through between about their there than reported outcomes associated effects effect impact "
    "relationship role influence evidence studies study please tell show find"
).split()
#: Stop words of keyword retrieval; these drop negations as well.
RETRIEVAL_STOP_WORDS = (
    "what are is the a an of for with to in on and or how does do can could would should will that this these those it its be been being was "
    "were has have had not no but by from at as into through between about their there than reported outcomes associated effects effect impact "
    "relationship role influence evidence studies study"
).split()
#: Stop words of claim clustering.
CLAIM_STOP_WORDS = "a an and are as at by for from in is it of on or that the to with".split()
#: Stop words of the words that a result list marks.
UI_STOP_WORDS = "and or in on the a an of for with to".split()
#: Openings of addresses that are never shown.
UNSAFE_URL = r"(?i)^(javascript|data|vbscript):"
#: Opening phrases that carry no content, in the order in which they are removed.
LOW_SIGNAL_PREFIXES = [r"^what\s+(are|is)\s+the\s+", r"^how\s+does\s+", r"^can\s+you\s+", r"^please\s+", r"^i\s+want\s+to\s+know\s+"]
#: Comparative wording, what replaces it, and the reason that is recorded.
COMPARATIVES = [
    (r"\b(better|best|superior)\s+than\b", "compared with", "comparative_neutralized_positive"),
    (r"\b(worse|worst|inferior)\s+than\b", "compared with", "comparative_neutralized_negative"),
    (r"\b(more|less)\s+effective\s+than\b", "compared with", "comparative_neutralized_effective"),
    (r"\beffects?\s+of\b", "outcomes associated with", "effect_phrase_neutralized"),
]
#: Units that are set apart from their number.
UNITS = r"(\d)\s*(mg|g|kg|mcg|ml|l|mmhg|bpm|mmol/l|mg/dl|%)\b"
#: Causal wording and its correlational form.
CAUSAL = [
    ("caused", "was associated with"),
    ("causes", "was associated with"),
    ("causing", "was associated with"),
    ("cause", "was associated with"),
    ("led to", "was associated with"),
    ("leads to", "was associated with"),
    ("resulted in", "showed"),
    ("results in", "showed"),
    ("due to", "associated with"),
    ("effect of", "association with"),
]


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words(text: Column, separator: str, longer_than: int = 0, without: list[str] | None = None) -> Column:
    """Parts of a text between matches of ``separator``, those longer than so many characters,
    without the listed ones; in order, repeats included."""
    parts = F.filter(F.split(text, separator), lambda w: F.length(w) > longer_than)
    return F.filter(parts, lambda w: ~w.isin(without)) if without else parts


def normalize_record_text(raw: Column) -> Column:
    """For deduplication: lower case, punctuation to spaces, collapsed; null if nothing is left."""
    return none_if_empty(collapse(F.regexp_replace(F.lower(F.trim(raw)), r"\p{Punct}+", " ")))


#: Characters that compatibility composition leaves as they are, whatever stands beside them.
_COMPOSED = r"^[\x00-\x7F\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]*$"


def with_nfkc(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with text or array-of-text ``columns`` in Unicode's compatibility composition.

    Rows of plain characters alone stay in the JVM; the others go through Python in Arrow batches."""
    kinds = dict(df.dtypes)
    plain = F.lit(True)
    for c in columns:
        text = F.array_join(F.col(c), "") if kinds[c].startswith("array") else F.col(c)
        plain = plain & F.coalesce(text.rlike(_COMPOSED), F.lit(True))

    def form(value: str | list | None) -> str | list | None:
        return normalize("NFKC", value) if isinstance(value, str) else [form(v) for v in value] if value is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([form(v) for v in c.to_pylist()], c.type) if name in columns else c for name, c in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)

    return df.where(plain).unionByName(df.where(~plain).mapInArrow(run, df.schema))


def normalize_ascii(raw: Column) -> Column:
    """For matching: lower case, all but a-z, 0-9 and white space to spaces, collapsed; null to ''."""
    return F.coalesce(collapse(F.regexp_replace(F.lower(raw), r"[^a-z0-9\s]", " ")), F.lit(""))


def sorted_title_key(raw: Column) -> Column:
    """Letters and digits of any script, words in sorted order."""
    return F.array_join(F.array_sort(words(F.lower(raw), r"[^\p{L}\p{N}]+")), " ")


def authors_key(authors: Column, first: int = 3) -> Column:
    """The first non-blank authors, each normalised, joined by ``|``; null if none."""
    named = F.slice(F.filter(authors, lambda a: F.trim(F.coalesce(a, F.lit(""))) != ""), 1, first)
    return none_if_empty(F.array_join(F.transform(named, normalize_record_text), "|"))


def normalize_punctuation(query: Column) -> Column:
    """Typographic quotes and dashes to ASCII, spaces around ``, ; : ! ?``, collapsed."""
    plain = F.translate(query, "“”’‘`‐‑‒–—", "\"\"'''-----")
    return collapse(F.regexp_replace(plain, r"\s*([,;:!?])\s*", " $1 "))


def separate_units(query: Column) -> Column:
    return F.regexp_replace(query, "(?i)" + UNITS, "$1 $2")


def strip_boilerplate(query: Column) -> Column:
    return reduce(lambda q, p: F.trim(F.regexp_replace(q, "(?i)" + p, "")), LOW_SIGNAL_PREFIXES, query)


def neutralize_comparatives(query: Column) -> Column:
    return reduce(lambda q, rule: F.regexp_replace(q, "(?i)" + rule[0], rule[1]), COMPARATIVES, query)


def versus_to_vs(query: Column) -> Column:
    return F.regexp_replace(query, r"\b(vs\.?|versus)\b", "vs")


def normalize_query(query: Column) -> Column:
    """Query understanding, the second version: all steps in turn, lower-cased."""
    q = F.lower(normalize_punctuation(query))
    return collapse(neutralize_comparatives(versus_to_vs(strip_boilerplate(separate_units(q)))))


def normalize_query_first(query: Column) -> Column:
    """Query understanding, the first version: comparatives and "effects of" alone."""
    q = F.regexp_replace(F.trim(query), r"(?i)\b(better|best|worse|worst|superior|inferior)\b", "associated with")
    q = F.regexp_replace(q, r"(?i)\b(more|less)\s+(effective|efficient|beneficial)\b", "outcomes of")
    return F.trim(F.regexp_replace(q, r"(?i)\beffects?\s+of\b", "reported outcomes associated with"))


def query_terms(normalized: Column, most: int = 12) -> Column:
    """Distinct terms of a normalised query in order, of two characters or more."""
    kept = F.regexp_replace(normalized, r"[^a-z0-9/%\-\s]", " ")
    return F.slice(F.array_distinct(words(kept, r"\s+", 1, QUERY_STOP_WORDS)), 1, most)


def retrieval_terms(query: Column, most: int = 8) -> Column:
    """Distinct keywords for retrieval, of any length."""
    kept = F.regexp_replace(F.lower(query), r"[^a-z0-9\s]", " ")
    return F.slice(F.array_distinct(words(kept, r"\s+", 0, RETRIEVAL_STOP_WORDS)), 1, most)


def ui_keywords(query: Column) -> Column:
    """Keywords as the result list marks them: of three characters or more, repeats kept."""
    return words(F.lower(query), r"[^a-z0-9]+", 2, UI_STOP_WORDS)


def sentences(text: Column) -> Column:
    """Split after ``. ! ?`` and white space; trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), F.trim), lambda s: s != "")


def shortened(text: Column, most: int) -> Column:
    """Collapsed text of at most ``most`` characters; longer ones end in three dots."""
    plain = collapse(text)
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(F.substring(plain, 1, most - 1), F.lit("...")))


def abstract_of(index: Column) -> Column:
    """The text of an inverted index (map of word to positions): words in order of position; at a
    position that several claim, the last word in code point order stays."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    ordered = F.array_sort(pairs)
    # Each pair beside the next one; the last stands beside null.
    kept = F.zip_with(ordered, F.slice(ordered, 2, 2**31 - 1), lambda x, y: F.when(F.coalesce(y["p"] != x["p"], F.lit(True)), x["w"]))
    return F.array_join(F.array_compact(kept), " ")


def citation(authors: Column, year: Column, title: Column, venue: Column) -> Column:
    """Up to three authors, ``et al.`` for more, then year, title and venue."""
    named = F.array_join(F.slice(authors, 1, 3), ", ")
    lead = F.when(F.coalesce(named, F.lit("")) == "", "Unknown").otherwise(F.concat(named, F.when(F.size(authors) > 3, " et al.").otherwise("")))
    when = F.coalesce(F.nullif(year.cast("string"), F.lit("0")), F.lit("n.d."))
    return F.trim(F.concat(lead, F.lit(" ("), when, F.lit("). "), title, F.lit(". "), F.coalesce(venue, F.lit(""))))


def first_author(formatted: Column) -> Column:
    """The name before the first comma or bracket, without ``et al.``; ``Unknown`` if none."""
    name = F.trim(F.regexp_replace(F.regexp_extract(formatted, r"^([^,(]+)", 1), r"(?i)\set al\.?$", ""))
    return F.coalesce(none_if_empty(name), F.lit("Unknown"))


def without_causality(text: Column) -> Column:
    """Causal wording in its correlational form; longer forms are looked for first."""
    return reduce(lambda t, rule: F.regexp_replace(t, rf"(?i)\b{rule[0]}\b", rule[1]), CAUSAL, text)


def population_type(population: Column) -> Column:
    low = F.lower(F.coalesce(population, F.lit("")))
    return (
        F.when(low.contains("child") | low.contains("adolescent"), "pediatric")
        .when(low.contains("adult") | low.contains("elderly"), "adult")
        .when(low.contains("patient") | low.contains("clinical"), "clinical")
        .otherwise("general")
    )


def outcome_group(outcome: Column) -> Column:
    """An outcome's name without words of measurement."""
    return F.trim(F.regexp_replace(F.lower(outcome), r"\b(symptoms?|levels?|scores?|measures?|rates?)\b", ""))


def csv_field(value: Column) -> Column:
    """Quoted if it holds a comma, a quote or a line break; quotes are doubled."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike("[,\"\\n]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def without_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def pdf_link(html: Column) -> Column:
    """The address of a PDF in a page: an iframe's source, else a link, else a click handler."""
    tries = [r"""(?i)<iframe[^>]+src=["']([^"']+\.pdf[^"']*)["']""", r"""(?i)<a[^>]+href=["']([^"']+\.pdf[^"']*)["']""", r"""(?i)onclick=["'][^"']*location\.href=\\?['"]([^'"\\]+)"""]
    return F.coalesce(*[none_if_empty(F.regexp_extract(html, t, 1)) for t in tries])


def highlight_segments(text: Column, terms: list[str]) -> Column:
    """Array of (text, hit): the text cut before and after each occurrence of a term; where several
    terms fit at a place, the first listed one counts."""
    alternatives = "|".join(re.escape(t) for t in terms)
    parts = F.split(F.regexp_replace(text, f"(?i)({alternatives})", "\u0001$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, lambda p: F.struct(p.alias("text"), p.rlike(f"(?i)^({alternatives})$").alias("hit"))), lambda s: s["text"] != "")


def without_control_characters(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def json_payload(text: Column) -> Column:
    """A model's JSON answer: code fences off, commas before closing brackets off."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(json)?", ""), r"```$", ""))
    return F.regexp_replace(bare, r",\s*([}\]])", "$1")


def joined_hyphens(text: Column) -> Column:
    """Words broken by a hyphen at a line's end are joined; then white space is collapsed."""
    return collapse(F.regexp_replace(text, r"-\s*\n\s*", ""))


def safe_url(url: Column) -> Column:
    """Printable ASCII of an address; ``about:blank`` for none and for script or data addresses."""
    plain = F.trim(F.regexp_replace(url, r"[^\x20-\x7E]", ""))
    return F.when((F.coalesce(url, F.lit("")) == "") | plain.rlike(UNSAFE_URL), "about:blank").otherwise(plain)


def time_ago(then: Column, now: Column) -> Column:
    """``Just now``, then whole minutes, hours and days."""
    minutes = F.floor((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(then.cast("timestamp"))) / 60)
    text = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(minutes < 1, "Just now").when(minutes < 60, text(minutes, "m")).when(minutes < 1440, text(minutes / 60, "h")).otherwise(text(minutes / 1440, "d"))

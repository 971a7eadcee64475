"""Fill-in-the-middle by counted quantifiers: one regular-expression match cuts and rearranges a text.

``regexp_count`` gives a text's number of units; the row's own pattern takes a units into one
possessive group, b - a into the next and the rest into a third, and the replacement puts the
groups in their new order between markers.  All of it are Spark's own functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit of text, and the markers of prefix, suffix and middle.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draws(key: Column, many: int = 4) -> list[Column]:
    """``many`` (at most 8) unsigned 32-bit numbers of the sha256 of a key; null counts as ''."""
    digest = F.sha2(F.coalesce(key, F.lit("")).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(many)]


def pattern(a: Column, b: Column) -> Column:
    """The pattern whose groups hold the first a units, those up to the b-th, and the rest."""
    unit = "((?:[A-Za-z]++|[^A-Za-z]){%d}+)"
    return F.format_string("(?s)\\A" + unit.replace("{%d}", "{%1$d}") + unit.replace("{%d}", "{%2$d}") + "(.*)\\z", a, b - a)


def transform(docs: DataFrame, key: Column, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """``docs`` with a struct ``fim`` (n, form, prefix_chars, middle_chars, output) of its ``text``.

    Cuts and form follow from the digest of ``key`` alone.  The form is plain, the text as it is,
    for ``plain_percent`` of the keys, an empty or null text (which counts as empty) and any text
    that holds a marker; else spm (suffix, prefix, middle) for ``spm_percent`` of the keys and
    psm (prefix, suffix, middle) for the others.  Lengths are code points, null if plain.  All
    columns and rows of ``docs`` stay, a column ``fim`` is replaced.
    """
    kept = [c for c in docs.columns if c.lower() != "fim"]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.lit(None)
    held = docs.select(row.alias("row"), F.coalesce("text", F.lit("")).alias("text"), F.array(*draws(key)).alias("h"))
    counted = held.withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    marked = F.col("text") == ""
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(m))
    form = F.when(marked | (F.col("h")[2] % 100 >= 100 - plain_percent), "plain").when(F.col("h")[3] % 100 < spm_percent, "spm").otherwise("psm")
    one, two = F.col("h")[0] % (F.col("n") + 1), F.col("h")[1] % (F.col("n") + 1)
    placed = counted.select("row", "text", "n", form.alias("form"), pattern(F.least(one, two), F.greatest(one, two)).alias("pattern"))
    turned = F.when(F.col("form") == "psm", F.regexp_replace("text", F.col("pattern"), F.lit(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")))
    turned = turned.when(F.col("form") == "spm", F.regexp_replace("text", F.col("pattern"), F.lit(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"))).otherwise(F.col("text"))
    done = placed.select("row", "n", "form", turned.alias("output"))
    # Each marker is in the output once: the text holds none, and none can arise where two parts meet.
    begins = {m: F.locate(m, F.col("output")) for m in (PREFIX, SUFFIX, MIDDLE)}
    prefix = F.when(F.col("form") == "psm", begins[SUFFIX] - begins[PREFIX]).when(F.col("form") == "spm", begins[MIDDLE] - begins[PREFIX]) - len(PREFIX)
    middle = F.when(F.col("form") != "plain", F.length("output") - begins[MIDDLE] + 1 - len(MIDDLE))
    fim = F.struct("n", "form", prefix.cast("long").alias("prefix_chars"), middle.cast("long").alias("middle_chars"), "output")
    return done.select(*[F.col("row").getField(c).alias(c) for c in kept], fim.alias("fim"))


def restore(output: Column, form: Column) -> Column:
    """The text that ``transform`` made an output of, from the output and its form."""
    psm = F.regexp_replace(output, f"(?s)\\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)\\z", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)\\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)\\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)

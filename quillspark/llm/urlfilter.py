"""URL filters: host and path rules, then a blocked Bloom filter before an exact hash join.

Everything is DataFrame operations: the filter is a table of 256-bit blocks of which each URL
touches one, so probing is one join on the block number and a few bit tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Bits of a block, in words of 32, and bits that a URL sets in its block.
WORDS, HASHES = 8, 6


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without one."""
    rest = F.coalesce(F.try_element_at(F.split(url, "://", 2), F.lit(2)), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; '' without ``://``."""
    rest = F.coalesce(F.try_element_at(F.split(url, "://", 2), F.lit(2)), F.lit(""))
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """The form that is listed and looked up: no scheme, query or fragment, no leading ``www.``,
    no slashes at the end."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule of ``rules`` (verdict, host, path) as struct (rule, verdict), or null.

    A rule fits its host and all subdomains where the path starts with its own.  The list is a
    parameter of bounded length (10,000 at most) and becomes part of the expression.
    """
    if len(rules) > 10_000:
        raise ValueError("rules are for short lists; use listed URLs for long ones")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in ordered
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _bits(key: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a key and the bits (0 to 255) that it sets there."""
    other = F.xxhash64(key, F.lit(1))
    bits = F.array(*[F.shiftrightunsigned(other, 8 * k).bitwiseAND(F.lit(255)).cast("int") for k in range(HASHES)])
    return F.pmod(F.xxhash64(key), F.lit(blocks)), bits


def bloom_blocks(listed: DataFrame, key: str, bits_per_key: int = 16) -> tuple[DataFrame, int]:
    """A blocked Bloom filter of the distinct keys: rows (_block, _w0 .. _w7), and how many
    blocks there are; false positives are some 0.2 % at 16 bits a key."""
    n = listed.count()
    blocks = max(1, -(-n * bits_per_key // (WORDS * 32)))
    block, bits = _bits(F.col(key), blocks)
    each = listed.select(block.alias("_block"), F.explode(bits).alias("_bit"))
    word = F.shiftright("_bit", 5)
    one = F.expr("shiftleft(1, _bit & 31)")
    return each.groupBy("_block").agg(*[F.bit_or(F.when(word == k, one).otherwise(0)).alias(f"_w{k}") for k in range(WORDS)]), blocks


#: Blocks of a filter that may be broadcast: 32 bytes and a number each, 48 MB at most.
BROADCAST_BLOCKS = 1 << 20


def _possible(keys: DataFrame, key: str, blooms: DataFrame, blocks: int) -> DataFrame:
    """``keys`` with ``_possible``: whether the filter has all bits of a key; false for null keys."""
    block, bits = _bits(F.col(key), blocks)
    few = F.broadcast(blooms) if blocks <= BROADCAST_BLOCKS else blooms
    probe = keys.withColumns({"_block": block, "_bits": bits}).join(few, "_block", "left")
    words = F.array(*[f"_w{k}" for k in range(WORDS)])
    held = F.forall("_bits", lambda b: F.getbit(F.get(words, F.shiftright(b, 5)).cast("long"), b.bitwiseAND(F.lit(31))) == 1)
    return probe.select(*keys.columns, F.coalesce(F.col(key).isNotNull() & F.col("_w0").isNotNull() & held, F.lit(False)).alias("_possible"))


def listed_pages(pages: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """``pages`` with ``listed`` (boolean): whether the non-null ``key`` is among listed's keys.

    ``listed`` holds keys in a column of the same name; it is made distinct, pre-aggregated
    before its shuffle.  A filter of up to ``BROADCAST_BLOCKS`` blocks (some 16 million keys) is
    broadcast and probed where the pages are read: only possible hits are shuffled, to the exact
    join, where Spark may split a large key.  A larger filter is joined by block to the distinct
    keys, and what passes goes the same way.
    """
    wanted = materialise(listed.select(key).where(F.col(key).isNotNull()).distinct(), "listed")
    blooms, blocks = bloom_blocks(wanted, key)
    if blocks <= BROADCAST_BLOCKS:
        probed = _possible(pages, key, materialise(blooms, "blooms"), blocks)
        hits = wanted.select(F.col(key).alias("_hit"))
        maybe = probed.where("_possible").drop("_possible")
        found = maybe.join(hits, F.col(key) == F.col("_hit"), "left").withColumn("listed", F.col("_hit").isNotNull()).drop("_hit")
        return found.unionByName(probed.where("not _possible").drop("_possible").withColumn("listed", F.lit(False)))
    keys = pages.select(key).where(F.col(key).isNotNull()).distinct()
    possible = _possible(keys, key, blooms, blocks).where("_possible").select(key)
    hits = possible.join(wanted, key).select(F.col(key).alias("_hit"))
    return pages.join(hits, F.col(key) == F.col("_hit"), "left").withColumn("listed", F.col("_hit").isNotNull()).drop("_hit")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, listed), one for each row of ``pages``.

    Where a rule fits, the longest one decides; all other pages are blocked if their canonical
    URL is among ``listed`` (a column ``canonical``), and allowed otherwise.  Null URLs and those
    without ``://`` have empty host and path, fit no rule and are allowed.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parsed.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("_v"))
    keyed = ruled.withColumn("canonical", F.when(F.col("host") != "", canonical(F.col("host"), F.col("path"))))
    known = listed_pages(keyed, "canonical", listed)
    return known.select("page_id", "host", "path", "rule", F.coalesce("_v", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")

"""Revisit resolution for web archives: an as-of join with validators and header merging.

A "not modified" revisit holds no body: it stands for the latest full response of the same
canonical URL before it, if their validators agree.  Its headers then update the stored ones,
but for those that describe the body.  Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, materialise

#: Header fields of a 304 that never replace those of the stored response.
BODY_FIELDS = ["content-encoding", "content-length", "content-range", "content-type", "transfer-encoding", "connection"]
#: Slices of time in which a URL's records are met.
SLICES = 64


def canonical_url(url: Column) -> Column:
    """The key of the join: no scheme, ``www.``, query or fragment; lower-case host; no slashes at the end."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, r"[?#][\s\S]*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/]*", 0)), r"^www\.", "")
    return F.concat(host, F.regexp_replace(F.regexp_extract(rest, r"^[^/]*([\s\S]*)$", 1), r"/+$", ""))


def as_of(times: DataFrame, full: DataFrame, slices: int = SLICES) -> DataFrame:
    """``times`` (url, ts: distinct) with ``found_ts``, the latest ts of ``full`` (url, ts:
    distinct) of the same url that is strictly earlier, or null.

    Time is cut into ``slices`` that hold about as many rows each, so a url's rows in a slice are
    a small share of all whatever its own share is.  Within a slice a window looks back; what a
    slice begins with comes from a window over the url's slices.
    """
    both = times.select("url", "ts", F.lit(False).alias("is_full")).unionByName(full.select("url", "ts", F.lit(True).alias("is_full")))
    # Rows of one (url, ts) meet here: a revisit doesn't see a response of its own time.
    both = both.groupBy("url", "ts").agg(F.bool_or("is_full").alias("is_full"), F.bool_or(~F.col("is_full")).alias("asked"))
    cuts = both.agg(F.percentile_approx("ts", [k / slices for k in range(1, slices)], 10_000).alias("c")).first()["c"] or []
    number = F.lit(0)
    for cut in sorted(set(cuts)):
        number = number + (F.col("ts") > cut).cast("int")
    both = both.withColumn("slice", number)
    full_ts = F.when(F.col("is_full"), F.col("ts"))
    tops = both.groupBy("url", "slice").agg(F.max(full_ts).alias("top"))
    earlier = Window.partitionBy("url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select("url", "slice", F.max("top").over(earlier).alias("carried"))
    inner = Window.partitionBy("url", "slice").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    seen = both.join(carry, ["url", "slice"]).withColumn("found_ts", F.coalesce(F.max(full_ts).over(inner), "carried"))
    return seen.where("asked").select("url", "ts", "found_ts")


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers (map of lower-case names), replaced and added to by the 304's permitted ones."""
    allowed = F.map_filter(fresh, lambda k, v: ~k.isin(BODY_FIELDS))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(allowed, k)), allowed)


def agrees(stored: Column, fresh: Column) -> Column:
    """Validators: entity tags decide where both records have one (weak marks aside), else the
    dates of last modification where both have one, else nothing contradicts."""
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    by_tag = tag(stored) == tag(fresh)
    by_date = stored["last-modified"] == fresh["last-modified"]
    return F.coalesce(by_tag, by_date, F.lit(True))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """The revisits of ``records`` (record_id long, url, ts long, kind, headers map), resolved.

    ``kind`` is ``response`` for full responses and ``revisit``; others are passed over.  Rows
    (record_id, canonical_url, ts, status, response_id, headers): status is ``resolved``,
    ``validator_mismatch`` (the latest earlier response has other validators) or ``no_response``;
    response_id names the earlier response where there is one, and headers are merged where it
    is resolved, else the revisit's own.  Of responses of one URL and time the one of the largest
    record_id counts, of rows that repeat it the one of the largest headers.  Revisits with a null url or ts have no response; null headers count as
    none; repeated rows come out as often as they came in.
    """
    held = records.where("kind in ('response', 'revisit')").select("record_id", "kind", canonical_url(F.col("url")).alias("url"), "ts", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"))
    responses = held.where("kind = 'response' and url is not null and ts is not null")
    revisits = held.where("kind = 'revisit'")
    # One row for each (url, ts): maps can't be compared, so the largest (id, sorted entries) stands for it.
    entries = F.array_sort(F.map_entries("headers"))
    full = responses.groupBy("url", "ts").agg(F.max(F.struct(F.col("record_id").alias("response_id"), entries.alias("stored"))).alias("r"))
    full = materialise(full.select("url", "ts", "r.response_id", F.map_from_entries("r.stored").alias("stored")), "full")
    asked = revisits.where("url is not null and ts is not null")
    seen = as_of(asked.select("url", "ts").distinct(), full.select("url", "ts")).where("found_ts is not null")
    named = materialise(seen.join(full.withColumnRenamed("ts", "found_ts"), ["url", "found_ts"]).select("url", "ts", "response_id", "stored"), "named")
    # Revisits meet their response by url and time; those of a popular pair, and those that can't have one, stay spread.
    nothing = {"response_id": F.lit(None).cast(named.schema["response_id"].dataType), "stored": F.lit(None).cast(named.schema["stored"].dataType)}
    found = lookup(asked, named, ["url", "ts"], "left").unionByName(revisits.where("url is null or ts is null").withColumns(nothing))
    same = F.col("response_id").isNotNull() & agrees(F.col("stored"), F.col("headers"))
    status = F.when(F.col("response_id").isNull(), "no_response").when(same, "resolved").otherwise("validator_mismatch")
    headers = F.when(same, merged_headers(F.col("stored"), F.col("headers"))).otherwise(F.col("headers"))
    return found.select("record_id", F.col("url").alias("canonical_url"), "ts", status.alias("status"), "response_id", headers.alias("headers"))

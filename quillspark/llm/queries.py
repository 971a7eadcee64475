"""One query for each operator, over its whole table, with its production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chunking, fim, knn, langid, media, mixing, packing, quality, simhash, urlfilter, warc, whitening
from .common import doc_bucket, materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 4096 tokens."""
    pieces = packing.tokenise(_table(spark, sf_dir, "documents"), ranked=True)
    slim = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "_part", "_rank")
    return packing.pack_ranked(slim)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and the component of every document, links at 4 or fewer bits."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def learnable_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may be learned from: crc32(doc_id) mod 5 is not 0."""
    return _table(spark, sf_dir, "labels").where(doc_bucket(F.col("doc_id"), 5) != 0)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learned from the labels that aren't held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, learnable_labels(spark, sf_dir)))
    return scored.select("doc_id", (doc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, for sources weighing 5, 2, 1 in turn."""
    sized = materialise(mixing.with_sizes(_table(spark, sf_dir, "documents")).select("doc_id", "source", "size"), "sizes")
    return mixing.schedule(sized).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = """
with sized as (select row_number() over () as row_id, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
totals as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (select *, row_number() over (order by source is null, source) - 1 as turn from totals),
capped as (select *, 2.0::double * source_size as cap, case turn % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w from weighed),
levels as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, source is null, source rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by cap / w, source is null, source rows between current row and unbounded following) as level from capped),
targets as (select source, source_size, turn, least(cap, w * max(level) over ()) as target from levels),
timed as (select d.row_id, d.doc_id, d.size, t.source_size, t.target, t.turn,
    (sum(d.size) over (partition by d.source order by md5(coalesce(d.doc_id::varchar, '')), d.doc_id, d.size rows between unbounded preceding and current row))::bigint as upto
    from sized d join targets t on d.source is not distinct from t.source),
copies as (select row_id, size, turn, target, upto - size as start from timed where size > 0
    union all select row_id, size, turn, target, upto - size + source_size from timed where size > 0),
packets as (select row_id, turn, target, start + least(64 * (k + 1), size) as ending, least(64 * (k + 1), size) - 64 * k as words from (select *, unnest(range(0, (size - 1) // 64 + 1)) as k from copies)),
mixed as (select row_id, words as size, sum(words) over (order by ending::double / target, turn, ending rows between unbounded preceding and current row) - words as before from packets),
budget as (select floor(1.5::double * sum(size) + 0.5)::bigint as words from sized),
got as (select row_id, sum(greatest(0, least(size, words - before)))::bigint as taken from mixed, budget group by row_id)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken from timed left join got using (row_id)
"""


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 20 words or more that a document of smaller doc_id, or the text before
    it, has already: the document, its bytes, and the first document it was found in."""
    spans = chunking.repeated_spans(_table(spark, sf_dir, "documents"), min_words=20)
    return spans.select("doc_id", "span_start", "span_end", "words", "first_doc_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose crc32(doc_id) mod 3 is not 1."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(doc_bucket(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang"))
    found = langid.identify(docs, model)
    return found.select("doc_id", (doc_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


#: The rules (verdict, host, path) of the URL query, and the host labels whose pages make its list.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
LISTED_LABELS = "cheap-pills|casino-win|free-bets|spam-farm|adult-x|ads-track"


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL; the list holds the canonical URLs of unwanted hosts."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = urlfilter.host_of(F.col("url")), urlfilter.path_of(F.col("url"))
    listed = pages.where(host.rlike(LISTED_LABELS)).select(urlfilter.canonical(host, path).alias("canonical"))
    return urlfilter.judge(pages, URL_RULES, listed)


OP3_SQL = """
with parsed as (select page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
keyed as (select *, case when host <> '' then concat(regexp_replace(host, '^www[.]', ''), regexp_replace(path, '/+$', '')) end as canonical,
    case when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
         when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
         when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
         when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule from parsed),
listed as (select distinct canonical from keyed where regexp_matches(host, 'cheap-pills|casino-win|free-bets|spam-farm|adult-x|ads-track'))
select page_id, host, path, rule,
    case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
         when l.canonical is not null then 'block' else 'allow' end as verdict,
    l.canonical is not null as listed
from keyed k left join listed l on k.canonical = l.canonical
"""


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all other vectors for every vector whose id is divisible by 100."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), knn.quantised(F.col("embedding")).alias("vector"))
    return knn.top_k(rows, F.col("vec_id") % 100 == 0, k=10)


OP5_SQL = """
with valid as (select vec_id, [floor(1024 * x::double)::bigint for x in embedding] as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, d.vec_id as vec_id, list_sum([q.v[i] * d.v[i] for i in range(1, len(q.v) + 1)])::bigint as score
    from valid q join valid d on q.vec_id % 100 = 0 and d.vec_id <> q.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as media, sniffed, and read back from the stored bytes."""
    found = media.inspect(media.store(_table(spark, sf_dir, "documents")))
    feature = F.concat_ws(";", F.concat(F.lit("kind="), "kind"), F.concat(F.lit("corrected="), F.col("corrected").cast("string")), F.concat(F.lit("embedded="), F.size("embedded").cast("string")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def archive_records(pages: DataFrame) -> DataFrame:
    """Archive records of ``pages``: a full response of each, a second one of every third, and a
    revisit of each by another form of its URL; ids are 4 page_id + 0, 2, 1.

    Times and validators follow from page_id and html: some revisits are as old as the response
    or have another entity tag.
    """
    tag, at = F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit(1_700_000_000) + F.col("page_id") * 37 % 1_000_000
    first = F.struct((F.col("page_id") * 4).alias("record_id"), F.col("url"), at.alias("ts"), F.lit("response").alias("kind"),
                     F.create_map(F.lit("etag"), tag, F.lit("content-length"), F.length("html").cast("string"), F.lit("content-type"), F.lit("text/html"), F.lit("server"), F.lit("a")).alias("headers"))
    second = F.struct((F.col("page_id") * 4 + 2).alias("record_id"), F.col("url"), (at + 1800 * (F.col("page_id") % 4)).alias("ts"), F.lit("response").alias("kind"),
                      F.create_map(F.lit("etag"), F.concat(F.lit("b"), tag), F.lit("content-length"), F.lit("1"), F.lit("content-type"), F.lit("text/html"), F.lit("server"), F.lit("b")).alias("headers"))
    other = F.concat(F.regexp_replace("url", "^https?://", "HTTP://"), F.lit("#again"))
    changed = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("x"), tag)).otherwise(tag)
    revisit = F.struct((F.col("page_id") * 4 + 1).alias("record_id"), other.alias("url"), (at + 3600 * (F.col("page_id") % 5)).alias("ts"), F.lit("revisit").alias("kind"),
                       F.create_map(F.lit("etag"), F.concat(F.lit("W/"), changed), F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("server"), F.lit("c")).alias("headers"))
    made = F.when(F.col("page_id") % 3 == 0, F.array(first, revisit, second)).otherwise(F.array(first, revisit))
    return pages.select(F.explode(made).alias("r")).select("r.*")


def op10_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of the pages' archive records with the response it stands for."""
    # Records are written once: their digests of the pages are read more than once.
    records = materialise(archive_records(_table(spark, sf_dir, "pages")), "records")
    found = warc.resolve_revisits(records)
    pairs = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("record_id", F.floor(F.col("record_id") / 4).alias("page_id"), "canonical_url", "ts", "status", "response_id", F.array_join(pairs, "; ").alias("headers"))


OP10_SQL = """
with base as (select page_id, url, html, md5(coalesce(html, '')) as tag, 1700000000 + page_id * 37 % 1000000 as born from pages),
urls as (select *, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#](.|\n)*$', '') as rest from base),
keyed as (select *, concat(regexp_replace(lower(regexp_extract(rest, '^[^/]*')), '^www[.]', ''), regexp_replace(regexp_extract(rest, '^[^/]*((.|\n)*)$', 1), '/+$', '')) as canonical_url from urls),
responses as (
    select page_id * 4 as record_id, canonical_url, born as ts, tag as etag, length(html)::varchar as size, 'a' as server from keyed
    union all select page_id * 4 + 2, canonical_url, born + 1800 * (page_id % 4), 'b' || tag, '1', 'b' from keyed where page_id % 3 = 0),
latest as (select * from (select *, row_number() over (partition by canonical_url, ts order by record_id desc) as n from responses) where n = 1),
revisits as (select page_id * 4 + 1 as record_id, page_id, canonical_url, born + 3600 * (page_id % 5) as ts, case when page_id % 7 = 0 then 'x' || tag else tag end as etag from keyed),
found as (select v.record_id, v.page_id, v.canonical_url, v.ts, v.etag, r.record_id as response_id, r.etag as stored, r.size from revisits v
    asof left join latest r on v.canonical_url = r.canonical_url and v.ts > r.ts)
select record_id, page_id, canonical_url, ts,
    case when response_id is null then 'no_response' when stored = etag then 'resolved' else 'validator_mismatch' end as status, response_id,
    case when stored = etag then 'cache-control=max-age=60; content-length=' || size || '; content-type=text/html; etag=W/' || etag || '; server=c'
         else 'cache-control=max-age=60; content-length=0; etag=W/' || etag || '; server=c' end as headers
from found
"""


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 8 leading components of all vectors' covariance, scaled to unit variance."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", whitening.quantised(F.col("embedding")).alias("x"))
    blocks = whitening.blocks_of(rows, "vec_id", "x")
    return whitening.project(blocks, whitening.fit(blocks, components=8)).withColumnRenamed("id", "vec_id")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte-level BPE ids of every whole text and the bytes they decode to, as digests."""
    found = bpe.encode(_table(spark, sf_dir, "documents"), decoded=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text cut at two drawn places and rearranged, and the text rebuilt from that."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fim.transform(docs, F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).select("doc_id", "fim.*")
    digests = (F.sha2(c.cast("binary"), 256) for c in (F.col("output"), fim.restore(F.col("output"), F.col("form"))))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *[d.alias(name) for d, name in zip(digests, ("output_sha256", "restored_sha256"), strict=True)])


OP13_SQL = """
with units as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
drawn as (select *, len(u)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from units),
cut as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from drawn),
parts as (select *, coalesce(array_to_string(u[1:a], ''), '') as prefix, coalesce(array_to_string(u[a + 1:b], ''), '') as middle, coalesce(array_to_string(u[b + 1:n], ''), '') as suffix from cut)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
    sha256(case form when 'plain' then text else prefix || middle || suffix end) as restored_sha256
from parts
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_language_id,
        op3_url_filters,
        op4_simhash_near_dedup,
        op5_exact_top_k,
        op6_media_columns,
        op7_quality_classifier,
        op8_source_mixing,
        op9_substring_dedup,
        op10_revisit_resolution,
        op11_embedding_whitening,
        op12_byte_bpe,
        op13_fill_in_middle,
    )
}
ORACLE_SQL: dict[str, str] = {"op3_url_filters": OP3_SQL, "op5_exact_top_k": OP5_SQL, "op8_source_mixing": OP8_SQL, "op10_revisit_resolution": OP10_SQL, "op13_fill_in_middle": OP13_SQL}

"""Queries of operational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich, operations
from ..views import table

NOW = "2024-01-10 00:00:00"


def rate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("function_name"), (F.col("user_id") % 20).alias("client"), F.col("ts").alias("created_at"))


def rate_limit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19, W7, ST2: requests of the hour up to each request, by function and client."""
    return operations.rate_counts(rate_events(spark, sf_dir)).select("event_id", "in_window", (F.col("in_window") <= operations.HOURLY_LIMITS["search"]).alias("within"))


def rate_limit_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which requests are let through if refused ones don't count."""
    return operations.admitted(rate_events(spark, sf_dir), limit=3, seconds=6 * 3600)


def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4: failures of each provider's last five minutes and whether the breaker opens."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("key"), (F.unix_seconds(F.col("ts").cast("timestamp")) / 60).cast("long").alias("at"), (F.col("event_id") % 3 == 0).alias("failed"))
    return operations.breaker(e).select("event_id", "attempts", "failures", "opens")


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("lookup_key"), "event_id", F.col("props").alias("payload"), F.col("ts").alias("fetched_at"), (F.col("ts") + F.make_dt_interval(days=(F.col("event_id") % 9).cast("int"))).alias("expires_at"))


def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: the newest answer of each key after new ones came in."""
    c = cache(spark, sf_dir)
    return operations.upsert(c.where("event_id % 4 < 3"), c.where("event_id % 4 = 3"), ["lookup_key"], ["fetched_at", "event_id"]).select("lookup_key", "event_id", "payload")


def cache_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: old answers, and new ones of new keys."""
    c = cache(spark, sf_dir)
    return operations.insert_ignore(c.where("lookup_key % 3 = 0 and event_id % 2 = 0"), c.where("event_id % 2 = 1"), ["lookup_key"]).select("lookup_key", "event_id")


def cache_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5, D2, ST3: answers that are fresh, may be served stale, or are expired."""
    now = F.lit("2024-04-05 00:00:00").cast("timestamp_ntz")
    return enrich.cache_state(cache(spark, sf_dir), now).groupBy("state").agg(F.count(F.lit(1)).alias("answers"))


def cache_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """answers that haven't expired."""
    return operations.unexpired(cache(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz")).select("event_id")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 4 == 0, "queued").when(F.col("event_id") % 4 == 1, "processing").otherwise("completed")
    return e.select(F.col("event_id").alias("job_id"), status.alias("status"), (F.col("event_id") % 7).cast("int").alias("attempt_count"), F.col("ts").alias("created_at"), (F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 48).cast("int"))).alias("next_run_at"), (F.col("event_id") % 3 == 0).alias("succeeded"))


def jobs_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 oldest jobs that are due."""
    return operations.claim_jobs(jobs(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"), 100).select("job_id")


def jobs_after_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M17, ST5: jobs after one more attempt."""
    return operations.after_attempt(jobs(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz")).select("job_id", "attempt_count", "status", "delay_seconds", F.unix_seconds(F.col("next_run_at").cast("timestamp")).alias("next_run"))


def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST9: the state of each run of a log."""
    e = table(spark, sf_dir, "events")
    event = F.when(F.col("event_id") % 5 == 0, "RUN_FAILED").when(F.col("event_id") % 2 == 0, "RUN_COMPLETED").otherwise("RUN_STARTED")
    return operations.run_states(e.select(F.col("user_id").alias("run_id"), event.alias("event"), F.struct("ts", "event_id").alias("at")))


def latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile sample of each kind of event."""
    e = table(spark, sf_dir, "events").select("event_type", F.round("value", 4).alias("value"))
    return operations.percentile_95(e, "value", "event_type")


def hourly_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2: requests by function in tumbling hours, the batch twin of the stream."""
    e = rate_events(spark, sf_dir)
    w = F.window(F.col("created_at").cast("timestamp"), "1 hour")
    return e.groupBy("function_name", w.alias("w")).agg(F.count(F.lit(1)).alias("requests")).select("function_name", F.unix_seconds("w.start").alias("hour"), "requests")


RATE = "WITH r AS (SELECT event_id, event_type AS function_name, user_id % 20 AS client, epoch_us(ts) AS at_ FROM events)"
CACHE = "WITH c AS (SELECT user_id AS lookup_key, event_id, props AS payload, ts AS fetched_at, ts + to_days((event_id % 9)::int) AS expires_at FROM events)"
JOBS = "WITH j AS (SELECT event_id AS job_id, CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' ELSE 'completed' END AS status, (event_id % 7)::int AS attempt_count, ts AS created_at, ts + to_hours((event_id % 48)::int) AS next_run_at, event_id % 3 = 0 AS succeeded FROM events)"
QUERIES = {
    f.__name__: f
    for f in (rate_limit_counts, rate_limit_admitted, circuit_breaker, cache_upsert, cache_insert_ignore, cache_states, cache_valid, jobs_claim, jobs_after_attempt, run_states, latency_p95, hourly_requests)
}
ORACLE_SQL = {
    "rate_limit_counts": RATE + " SELECT event_id, count(*) OVER w AS in_window, count(*) OVER w <= 10 AS within FROM r WINDOW w AS (PARTITION BY function_name, client ORDER BY at_ RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)",
    "circuit_breaker": "WITH a AS (SELECT event_id, event_type AS k, floor(floor(epoch(ts)) / 60)::bigint AS at_, event_id % 3 = 0 AS failed FROM events), n AS (SELECT *, count(*) OVER w AS attempts, (count(*) FILTER (failed) OVER w)::bigint AS failures FROM a WINDOW w AS (PARTITION BY k ORDER BY at_ RANGE BETWEEN 300 PRECEDING AND CURRENT ROW)) SELECT event_id, attempts, failures, failed AND attempts >= 8 AND failures::double / attempts >= 0.4 AS opens FROM n",
    "cache_upsert": CACHE + " SELECT lookup_key, event_id, payload FROM (SELECT *, row_number() OVER (PARTITION BY lookup_key ORDER BY fetched_at DESC, event_id DESC) AS place FROM c) WHERE place = 1",
    "cache_insert_ignore": CACHE + ", o AS (SELECT * FROM c WHERE lookup_key % 3 = 0 AND event_id % 2 = 0) SELECT lookup_key, event_id FROM o UNION ALL SELECT lookup_key, event_id FROM c WHERE event_id % 2 = 1 AND lookup_key NOT IN (SELECT lookup_key FROM o)",
    "cache_states": CACHE + " SELECT CASE WHEN expires_at > timestamp '2024-04-05 00:00:00' THEN 'fresh' WHEN fetched_at + to_days(90) > timestamp '2024-04-05 00:00:00' THEN 'stale' ELSE 'expired' END AS state, count(*) AS answers FROM c GROUP BY 1",
    "cache_valid": CACHE + f" SELECT event_id FROM c WHERE expires_at > timestamp '{NOW}'",
    "jobs_claim": JOBS + f" SELECT job_id FROM j WHERE status = 'queued' AND next_run_at <= timestamp '{NOW}' ORDER BY created_at, job_id LIMIT 100",
    "jobs_after_attempt": JOBS + f""", n AS (SELECT job_id, attempt_count + 1 AS attempt_count, CASE WHEN succeeded THEN 'completed' WHEN attempt_count + 1 >= 5 THEN 'failed' ELSE 'queued' END AS status FROM j),
d AS (SELECT *, CASE WHEN status = 'queued' THEN least(60.0::double, pow(2.0::double, least(attempt_count, 7) - 1)) END AS delay_seconds FROM n)
SELECT *, epoch(timestamp '{NOW}')::bigint + delay_seconds::bigint AS next_run FROM d""",
    "run_states": "WITH l AS (SELECT user_id AS run_id, CASE WHEN event_id % 5 = 0 THEN 'RUN_FAILED' WHEN event_id % 2 = 0 THEN 'RUN_COMPLETED' ELSE 'RUN_STARTED' END AS event, ts, event_id FROM events), s AS (SELECT run_id, arg_max(event, (ts, event_id)) AS state, count(*) AS events FROM l GROUP BY run_id) SELECT *, state IN ('RUN_COMPLETED', 'RUN_FAILED') AS ended FROM s",
    "latency_p95": "WITH v AS (SELECT event_type, round(value, 4) AS value FROM events), p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM v) SELECT event_type, value AS p95 FROM p WHERE place = floor(n * 0.95::double)",
    "hourly_requests": "SELECT event_type AS function_name, epoch(date_trunc('hour', ts))::bigint AS hour, count(*) AS requests FROM events GROUP BY ALL",
}

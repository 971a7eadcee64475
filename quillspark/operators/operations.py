"""Operational tables: upserts, caches, rate limits, circuit breaker, job queue."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import backoff_seconds
from .slices import order_statistic

#: Requests an hour by function.
HOURLY_LIMITS = {"search": 10, "synthesis": 20, "chat": 30, "download": 15}
#: The breaker opens at 40 % failures of 8 attempts in 5 minutes, for 5 minutes.
FAILURE_RATE, MIN_ATTEMPTS, WINDOW_SECONDS, COOLDOWN_SECONDS = 0.4, 8, 300, 300


def upsert(old: DataFrame, new: DataFrame, key: list[str], newest: list[str]) -> DataFrame:
    """Rows of both with one row per key: the newest by the columns ``newest``, new over old."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in newest], F.desc("_new"))
    return both.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place", "_new")


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows, and new ones whose key is not there yet."""
    return old.unionByName(new.join(old.select(*key).distinct(), key, "left_anti"))


def unexpired(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at") > now)


def rate_counts(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """Each event with how many of its function and client the window up to it holds, both ends
    included, to the microsecond."""
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    window = Window.partitionBy("function_name", "client").orderBy("at").rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("at", at).withColumn("in_window", F.count(F.lit(1)).over(window)).drop("at")


def admitted(events: DataFrame, limit: int, seconds: int = 3600) -> DataFrame:
    """Which events are let through if refused ones don't count: exact and in order, by key.

    A key is one function and client; its events of a batch are one task's.
    """
    schema = "event_id long, function_name string, client string, allowed boolean"
    rows = events.select("event_id", "function_name", F.col("client").cast("string").alias("client"), F.unix_seconds(F.col("created_at").cast("timestamp")).alias("at"))

    def admit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "event_id"])
        passed: list[int] = []
        first, allowed = 0, []
        for at in pdf["at"]:
            while first < len(passed) and passed[first] < at - seconds:
                first += 1
            ok = len(passed) - first < limit
            if ok:
                passed.append(at)
            allowed.append(ok)
        return pdf.assign(allowed=allowed)[["event_id", "function_name", "client", "allowed"]]

    return rows.groupBy("function_name", "client").applyInPandas(admit, schema)


def breaker(attempts: DataFrame) -> DataFrame:
    """Each attempt (key, at seconds, failed) with the window's counts and whether they would
    open the breaker."""
    window = Window.partitionBy("key").orderBy("at").rangeBetween(-WINDOW_SECONDS, 0)
    counted = attempts.withColumns({"attempts": F.count(F.lit(1)).over(window), "failures": F.sum(F.col("failed").cast("int")).over(window)})
    return counted.withColumn("opens", F.col("failed") & (F.col("attempts") >= MIN_ATTEMPTS) & (F.col("failures") / F.col("attempts") >= FAILURE_RATE))


def claim_jobs(jobs: DataFrame, now: Column, batch: int) -> DataFrame:
    """The oldest jobs that are due, ``batch`` of them."""
    return jobs.where((F.col("status") == "queued") & (F.col("next_run_at") <= now)).orderBy("created_at", "job_id").limit(batch)


def after_attempt(jobs: DataFrame, now: Column, max_attempts: int = 5) -> DataFrame:
    """Jobs (job_id, attempt_count, succeeded) after one more attempt: completed, failed for good,
    or queued again after a doubling delay."""
    count = F.col("attempt_count") + 1
    status = F.when(F.col("succeeded"), "completed").when(count >= max_attempts, "failed").otherwise("queued")
    delay = F.when(status == "queued", backoff_seconds(count))
    return jobs.select("job_id", count.alias("attempt_count"), status.alias("status"), delay.alias("delay_seconds"), F.when(status == "queued", now + F.make_dt_interval(secs=delay)).alias("next_run_at"))


def run_states(log: DataFrame) -> DataFrame:
    """The last state of each run in a log (run_id, event, at), and whether it ended."""
    last = log.groupBy("run_id").agg(F.max_by("event", F.struct("at", "event")).alias("state"), F.count(F.lit(1)).alias("events"))
    return last.withColumn("ended", F.col("state").isin("RUN_COMPLETED", "RUN_FAILED"))


def percentile_95(samples: DataFrame, column: str, by: str) -> DataFrame:
    """The sample at place floor(0.95 n) of each group, counted from 0."""
    return order_statistic(samples, column, by, 0.95).withColumnRenamed("value", "p95")

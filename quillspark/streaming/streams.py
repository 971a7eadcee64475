"""Structured Streaming: windowed request counts, cached answers, circuit breaker, incremental dedup."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import operations
from ..operators.runs import run_id


def request_counts(events: DataFrame, every: str = "1 minute", window: str = "60 minutes", late: str = "2 hours") -> DataFrame:
    """Requests (function_name, client, created_at timestamp) per sliding window; state older
    than ``late`` is dropped, as the rate limiter's own rows are."""
    marked = events.withWatermark("created_at", late)
    counted = marked.groupBy("function_name", "client", F.window("created_at", window, every)).agg(F.count(F.lit(1)).alias("requests"))
    return counted.select("function_name", "client", F.col("window.start").alias("start"), "requests")


def first_answers(answers: DataFrame, ttl: str = "6 hours") -> DataFrame:
    """One answer per lookup_key and time to live (fetched_at timestamp)."""
    return answers.withWatermark("fetched_at", ttl).dropDuplicatesWithinWatermark(["lookup_key"])


def breaker_states(attempts: DataFrame) -> DataFrame:
    """Each attempt (key, attempt_id, at seconds, failed) with whether it was let through, exactly:
    attempts while the breaker is open are neither made nor counted.

    State per key holds the attempts of the last five minutes alone.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, open_until = state.get if state.exists else ([], 0)
        times = [(int(x) // 2, bool(int(x) % 2)) for x in held]
        for pdf in batches:
            out = []
            for row in pdf.sort_values(["at", "attempt_id"]).itertuples():
                allowed = row.at >= open_until
                if allowed:
                    times = [t for t in times if t[0] >= row.at - operations.WINDOW_SECONDS] + [(row.at, row.failed)]
                    failures = sum(f for _, f in times)
                    if row.failed and len(times) >= operations.MIN_ATTEMPTS and failures / len(times) >= operations.FAILURE_RATE:
                        open_until = row.at + operations.COOLDOWN_SECONDS
                out.append((key[0], row.attempt_id, allowed))
            yield pd.DataFrame(out, columns=["key", "attempt_id", "allowed"])
        state.update(([t * 2 + f for t, f in times], int(open_until)))

    return attempts.groupBy("key").applyInPandasWithState(step, "key string, attempt_id long, allowed boolean", "held array<long>, open_until long", "append", GroupStateTimeout.NoTimeout)


def _named_once(spark: SparkSession, ledger: str, number: int) -> str:
    """The run id of a batch: by the time at which it was first tried, kept in a row of its own."""
    path, schema = f"{ledger}/batch={number}", "run_id string"
    try:
        held = spark.read.schema(schema).parquet(path).collect()
    except AnalysisException:  # not tried yet
        held = []
    if not held:
        # A try that ended before its row was committed left none, and used no id.
        spark.range(1).select(run_id(F.current_timestamp()).alias("run_id")).coalesce(1).write.mode("overwrite").parquet(path)
        held = spark.read.schema(schema).parquet(path).collect()
    return held[0]["run_id"]


def incremental(stream: DataFrame, run: Callable[[DataFrame, str], None], checkpoint: str) -> StreamingQuery:
    """Feed all that is new to ``run(batch, run_id)``, batch by batch, and stop.

    A run id holds the time of its batch.  It is written down under the batch's number before the
    run begins, so a batch that is tried again has the same one and overwrites its own run.
    """

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            run(batch, _named_once(batch.sparkSession, f"{checkpoint}/run_ids", number))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

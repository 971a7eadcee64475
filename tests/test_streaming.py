import re

from pyspark.sql import functions as F

from quillspark.streaming import streams


def sink(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def events(spark, sf, tmp_path):
    path = str(tmp_path / "in")
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("event_type").alias("function_name"), (F.col("user_id") % 5).alias("client"), F.col("ts").cast("timestamp").alias("created_at"))
    rows.repartition(2).write.parquet(path)
    return path, rows


def test_request_counts_match_batch(spark, sf, tmp_path):
    path, rows = events(spark, sf, tmp_path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    got = sink(spark, streams.request_counts(stream, "1 hour", "1 hour"), "counts", "complete")
    assert got.agg(F.sum("requests")).first()[0] == rows.count()


def test_breaker_opens_and_closes(spark, tmp_path):
    path = str(tmp_path / "attempts")
    rows = [("a", i, i, True) for i in range(12)] + [("a", 100, 400, True)]
    spark.createDataFrame(rows, "key string, attempt_id long, at long, failed boolean").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("key string, attempt_id long, at long, failed boolean").parquet(path)
    got = {r["attempt_id"]: r["allowed"] for r in sink(spark, streams.breaker_states(stream), "breaker").collect()}
    assert [got[i] for i in range(12)] == [True] * 8 + [False] * 4 and got[100]


def test_incremental_batches(spark, sf, tmp_path):
    path, rows = events(spark, sf, tmp_path)
    seen = []
    q = streams.incremental(spark.readStream.schema(rows.schema).parquet(path), lambda b, r: seen.append((r, b.count())), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sum(n for _, n in seen) == rows.count()
    assert all(re.fullmatch(r"inc_\d{17}", r) for r, _ in seen)


def test_a_retried_batch_keeps_its_run_id(spark, tmp_path):
    ledger = str(tmp_path / "ids")
    first = streams._named_once(spark, ledger, 3)
    assert streams._named_once(spark, ledger, 3) == first != streams._named_once(spark, ledger, 4)
    (tmp_path / "ids" / "batch=5").mkdir()  # a try that left nothing
    assert streams._named_once(spark, ledger, 5).startswith("inc_20")

"""Writers: text exports, append logs, partitioned snapshots and their publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import report


def write_outcome_csv(studies: DataFrame, path: str) -> None:
    """The outcome-grain CSV as text parts in order of study, the header before all."""
    _write_lines(report.outcome_csv(studies), report.OUTCOME_HEADER, path)


def write_paper_csv(studies: DataFrame, path: str) -> None:
    """The paper-grain CSV in the same form."""
    _write_lines(report.paper_csv(studies).withColumn("place", F.lit(0)), report.PAPER_HEADER, path)


def _write_lines(lines: DataFrame, header: str, path: str) -> None:
    rows = lines.select(F.lit(1).alias("kind"), "study_id", "place", "line")
    head = rows.sparkSession.range(1).select(F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["study_id"].dataType).alias("study_id"), F.lit(0).alias("place"), F.lit(header).alias("line"))
    head.unionByName(rows).orderBy("kind", "study_id", "place").select("line").write.mode("overwrite").text(path)


def write_ris(studies: DataFrame, path: str) -> None:
    report.ris(studies).orderBy("study_id").select("entry").write.mode("overwrite").option("lineSep", "\n\n").text(path)


def append_events(events: DataFrame, path: str, by: str | None = None) -> None:
    """Append to an event log, by a partition column if given."""
    writer = events.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def publish(df: DataFrame, base: str, run_id: str) -> str:
    """Write a snapshot below ``base`` and then the pointer to it; readers follow the pointer, so
    a failed write leaves the earlier snapshot in place.  Returns the snapshot's path."""
    path = f"{base}/snapshots/run_id={run_id}"
    df.write.mode("overwrite").parquet(path)
    df.sparkSession.createDataFrame([(run_id,)], "run_id string").coalesce(1).write.mode("overwrite").text(f"{base}/current")
    return path


def published(spark: SparkSession, base: str) -> DataFrame:
    """The snapshot that the pointer names."""
    run_id = spark.read.text(f"{base}/current").first()["value"]
    return spark.read.parquet(f"{base}/snapshots/run_id={run_id}")

"""Tables in the folder that driver and executors share, to cut lineage and to publish results."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.  Where that is unset and all tasks run in this
    process, as in tests, a temporary folder is made and remembered; on a cluster it raises,
    since executors wouldn't see that folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.quill.shared.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors share (master: {master})")
        found = "file://" + tempfile.mkdtemp(prefix="spark-quill-", dir="/tmp")
        spark.conf.set("spark.quill.shared.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The lineage ends in storage that survives the loss of any executor; a retried task rewrites
    only its own part, and the commit protocol keeps one attempt of each.
    """
    path = f"{shared_dir(df.sparkSession)}/quill-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((df.sparkSession, path))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote and nothing reads any more."""
    path = getattr(df, "_quill_path", None)
    if path:
        delete(df.sparkSession, path.rpartition("/")[0])
        _written[:] = [x for x in _written if x[1] != path]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that it belongs to."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete(spark, path.rpartition("/")[0])
        except Exception:  # the session has ended; the folder's owner clears it then
            return

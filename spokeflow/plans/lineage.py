"""Cutting lineage with written tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset a local master gets a fresh one; on a cluster, whose
    machines share no local folders, it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        named = "file://" + tempfile.mkdtemp(prefix="spokeflow-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    The table outlives the executors that wrote it, holds one copy of each row and keeps column
    pruning for its readers. It is removed when the driver ends. The shuffle files behind it are
    dropped as soon as it stands, since nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/spokeflow-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _written.append((spark, path))
    return spark.read.schema(schema).parquet(path)


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Let Arrow batches hold at most `most` bytes, unless the session already asks for less.

    A batch lies in memory several times over: in the JVM's buffers, in the worker's, and as Python strings.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    bytes_now = int(now[:-1]) if now.endswith("b") and now[:-1].isdigit() else int(now) if now.isdigit() else 1 << 62
    if bytes_now > most:
        spark.conf.set(key, str(most))


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended before the interpreter
            return

"""Tables that operators write between steps, in the folder that the session shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where all runs in one process may it be a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lodeway-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _at(spark, path)
    return store.exists(at)


def text_of(spark: SparkSession, path: str) -> str:
    """A small text file, hidden ones too; empty where it is missing."""
    at, store = _at(spark, path)
    if not store.exists(at):
        return ""
    stream = store.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def children(spark: SparkSession, path: str) -> list[str]:
    """Folders and files of a folder, sorted; none where it is missing."""
    at, store = _at(spark, path)
    return sorted(x.getPath().toString() for x in store.listStatus(at)) if store.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder below the shared one."""
    at, store = _at(spark, path)
    store.delete(at, True)


def saver(spark: SparkSession, keep: int = 0) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a DataFrame to the shared folder and reads it back, which cuts its lineage.

    With ``keep`` only the last so many tables stay; older ones are removed as
    new ones come, for loops that read their last rounds alone.
    """
    base, written = shared_dir(spark), []

    def save(df: DataFrame) -> DataFrame:
        path = f"{base}/round-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        written.append(path)
        if keep and len(written) > keep:
            delete(spark, written.pop(0))
        return spark.read.schema(df.schema).parquet(path)

    return save


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt out to all cores, where they come in fewer partitions: a small file is one task, however much its rows cost."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows

"""Change streams that keep file metadata and counts up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeway.sources.scratch import children, delete, exists, shared_dir


def _state(spark: SparkSession, given: str | None) -> str:
    return given or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def committed(spark: SparkSession, base: str) -> dict[int, str]:
    """Finished outputs of batches by batch id."""
    found = {int(p.rpartition("-")[2]): p for p in children(spark, base) if p.rpartition("/")[2].startswith("batch-")}
    return {i: p for i, p in found.items() if exists(spark, f"{p}/_SUCCESS")}


def changes(spark: SparkSession, path: str, per_batch: int = 1) -> DataFrame:
    """A stream over Parquet files of ``path``, with their schema."""
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_batch)
    return reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and _is_file(spark, path) else reader.parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def latest_meta(spark: SparkSession, path: str, state: str | None = None) -> DataFrame:
    """``(file, mtime, n)``: the newest change of each file, and how many there were.

    Every batch merges into the snapshot of the batch before and is written
    under its own id, so a batch that is run again replaces what it wrote and
    counts nothing twice. With the ``state`` folder of an earlier run only new
    files of ``path`` are read.
    """
    base = _state(spark, state)

    def merge(batch: DataFrame, i: int) -> None:
        new = batch.groupBy(F.col("user_id").alias("file")).agg(F.max("event_id").alias("mtime"), F.count("*").alias("n"))
        done = committed(spark, base)
        before = max((k for k in done if k < i), default=None)
        if before is not None:
            new = spark.read.parquet(done[before]).unionByName(new).groupBy("file").agg(F.max("mtime").alias("mtime"), F.sum("n").alias("n"))
        new.write.mode("overwrite").parquet(f"{base}/batch-{i:08d}")
        for k, old in done.items():  # the one before stays, for a batch that is run again
            if before is not None and k < before:
                delete(spark, old)

    query = changes(spark, path).writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    done = committed(spark, base)
    return spark.read.parquet(done[max(done)]) if done else spark.createDataFrame([], "file long, mtime long, n long")


def tumbling_counts(spark: SparkSession, path: str, window: str = "1 day", late: str = "1 hour", state: str | None = None) -> DataFrame:
    """``(start, event_type, n, total)`` of event-time windows.

    Update mode: a batch writes the windows that it changed, under its own id,
    and the newest version of a window counts. The watermark drops the state of
    windows that ended ``late`` before the newest event, and events that come
    for them later.
    """
    base = _state(spark, state)
    rows = changes(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    rows = rows.agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    rows = rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")

    def put(batch: DataFrame, i: int) -> None:
        batch.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{base}/batch-{i:08d}")

    query = rows.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    done = list(committed(spark, base).values())
    every = spark.read.parquet(*done) if done else spark.createDataFrame([], "start timestamp_ntz, event_type string, n long, total double, batch long")
    last = every.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("last"))
    return last.select("start", "event_type", "last.n", "last.total")

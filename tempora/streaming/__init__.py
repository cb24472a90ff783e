"""Structured Streaming over change logs (an extension: the query language has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_changes(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """A growing folder of Parquet change files as a stream (watches the folder)."""
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def windowed_counts(changes: DataFrame, ts: str, keys: list[str], width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events per window and key, with a watermark that bounds the state."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return changes.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select("w.start", "w.end", *keys, "n")


def sessions(changes: DataFrame, ts: str, keys: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return changes.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select("w.start", "w.end", *keys, "n")


def deduplicated(changes: DataFrame, ts: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return changes.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def commit_batches(changes: DataFrame, log: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch becomes a revision folder ``rev=<batch>`` of a change log.

    A batch that is run again after a failure overwrites its own folder, so the
    log holds every change once.
    """

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/rev={n + 1}")

    w = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()

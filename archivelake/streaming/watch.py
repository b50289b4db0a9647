"""Folder watching: a re-scan that sees edited files, and a file stream for folders that only grow."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources import scan


def changed(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose digest isn't the one known for their path."""
    old = known.select("path", F.col("sha256").alias("_sha"))
    return found.join(old, "path", "left").where(F.col("_sha").isNull() | (F.col("_sha") != F.col("sha256"))).drop("_sha")


def watch_once(spark: SparkSession, folder: str, known: DataFrame) -> DataFrame:
    """New and edited files of one re-scan; the same folder again gives nothing once they are known."""
    return changed(scan.hashed(scan.files(spark, folder)), known)


def watch(spark: SparkSession, folder: str, known: Callable[[], DataFrame], ingest: Callable[[DataFrame], None], seconds: float = 5.0, stop: Callable[[], bool] = lambda: False) -> None:
    while not stop():
        ingest(watch_once(spark, folder, known()))
        time.sleep(seconds)


def stream(spark: SparkSession, folder: str, checkpoint: str, ingest: Callable[[DataFrame, int], None], files_per_batch: int = 1000):
    """Each file of a growing folder once, in bounded batches, until all present ones are done."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    rows = rows.withColumn("path", scan.clean_path(F.col("path"))).where(text.is_indexable(F.col("path")))
    return scan.hashed(rows).writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per type and window with a watermark; the zone-free time column is read as UTC."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")

"""Stage timings, throughput, tallies and worker sizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGES = ("extract", "vlm", "finalize", "write")


def stage_timings(events: DataFrame, stages: tuple = STAGES) -> DataFrame:
    """Count, mean in ms and total seconds per stage of (stage, seconds); zeros for a stage without events."""
    every = events.sparkSession.createDataFrame([(s,) for s in stages], "stage string")
    per = events.groupBy("stage").agg(F.count("*").alias("n"), F.round(1000 * F.avg("seconds"), 2).alias("avg_ms"), F.round(F.sum("seconds"), 3).alias("total_s"))
    return F.broadcast(every).join(per, "stage", "left").select("stage", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("avg_ms", F.lit(0.0)).alias("avg_ms"), F.coalesce("total_s", F.lit(0.0)).alias("total_s"))


def throughput(processed: Column, wall: Column) -> Column:
    return F.round(F.when(wall > 0, F.try_divide(processed.cast("double"), wall)).otherwise(0.0), 3)


def tally(statuses: DataFrame, column: str = "status") -> DataFrame:
    return statuses.groupBy(column).agg(F.count("*").alias("n"))


def workers(ram_mb: Column, cpus: Column, share: float = 0.7, per_worker: int = 900, models: int = 1400, base: int = 300) -> Column:
    """Workers that fit a share of memory beside models and base, from 1 to the number of CPUs."""
    return F.greatest(F.lit(1), F.least(F.floor((ram_mb * share - models - base) / per_worker).cast("int"), cpus.cast("int")))

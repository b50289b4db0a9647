"""Asset versions: append-only rows (asset_id, version, op, ...), of which the latest counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(versions: DataFrame) -> DataFrame:
    """Current rows: the last version of each asset, without deleted ones. Aggregates before the shuffle, so a hot asset is one row per task."""
    return versions.groupBy(F.col("asset_id").alias("_id")).agg(F.max_by(F.struct("*"), "version").alias("r")).select("r.*").where("op <> 'delete'")


def insert(current: DataFrame, new: DataFrame, version: int) -> DataFrame:
    """Version rows for new assets; a path that was deleted comes back, one that is live is replaced."""
    return new.withColumn("version", F.lit(version)).withColumn("op", F.lit("insert")).withColumn("indexed", F.lit(True))


def update(current: DataFrame, new: DataFrame, version: int) -> DataFrame:
    """Version rows for assets that are live already."""
    return insert(current, new.join(current.select("asset_id"), "asset_id", "left_semi"), version).withColumn("op", F.lit("update"))


def upsert(versions: DataFrame, new: DataFrame, version: int) -> DataFrame:
    return latest(versions.unionByName(insert(versions, new, version), allowMissingColumns=True))


def delete(current: DataFrame, ids: DataFrame, version: int) -> DataFrame:
    """Tombstone rows; readers drop the asset and its vectors from then on."""
    return current.join(ids.select("asset_id"), "asset_id", "left_semi").withColumn("version", F.lit(version)).withColumn("op", F.lit("delete"))


def recover(assets: DataFrame, derive) -> tuple[DataFrame, DataFrame]:
    """Assets left unindexed by a crash, marked indexed, and their vectors derived anew by ``derive``."""
    broken = assets.where("state = 'active' and not indexed")
    return broken.withColumn("indexed", F.lit(True)), derive(broken)


def reconcile(assets: DataFrame, vectors: DataFrame) -> DataFrame:
    """Counts of tombstones to finish and orphan vectors to purge."""
    from .vectors import orphans

    gone = assets.select(F.when(F.col("state") == "deleted", 1).otherwise(0).alias("t"), F.lit(0).alias("o"))
    lost = orphans(vectors, assets).select(F.lit(0).alias("t"), F.lit(1).alias("o"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)
    return gone.unionByName(lost).agg(total("t", "tombstones_finished"), total("o", "orphans_purged"))


def listing(assets: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Newest first, live and indexed only."""
    return assets.where("state = 'active' and indexed").orderBy(F.desc("updated_at"), "asset_id").offset(offset).limit(limit)

"""Vectors as a pure function of assets, and checks of them against live assets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import is_nonzero


def flatten(assets: DataFrame) -> DataFrame:
    """One row per vector: an image's own in each space; a document's pages in ``text``, its regions in ``visual`` and ``clip``. Zero vectors are skipped."""
    whole = assets.where("kind <> 'pdf'").select("asset_id", F.explode(F.array(*[F.struct(F.lit(s).alias("space"), F.col(f"embeddings.{s}").alias("embedding")) for s in ("visual", "text", "clip")])).alias("v"))
    none = F.lit(None).cast("int")
    images = whole.select("v.space", F.col("asset_id").alias("vec_id"), "asset_id", none.alias("page_index"), none.alias("region_index"), "v.embedding")
    pages = assets.where("kind = 'pdf'").select("asset_id", F.explode("pages").alias("p"))
    page_id = F.concat("asset_id", F.lit("#p"), "p.page_index")
    texts = pages.select(F.lit("text").alias("space"), page_id.alias("vec_id"), "asset_id", "p.page_index", none.alias("region_index"), F.col("p.text_vector").alias("embedding"))
    regions = pages.select("asset_id", page_id.alias("page_id"), "p.page_index", F.posexplode("p.regions").alias("region_index", "r"))
    regions = regions.select("*", F.explode(F.array(*[F.struct(F.lit(s).alias("space"), F.col(f"r.{s}").alias("embedding")) for s in ("visual", "clip")])).alias("v"))
    regions = regions.select("v.space", F.concat("page_id", F.lit("#r"), "region_index").alias("vec_id"), "asset_id", "page_index", "region_index", "v.embedding")
    return images.unionByName(texts).unionByName(regions).where(is_nonzero(F.col("embedding")))


def orphans(vectors: DataFrame, assets: DataFrame) -> DataFrame:
    """Vectors without a live asset."""
    live = assets.where("state = 'active'").select(F.col("asset_id").alias("_live"))
    return vectors.join(live, F.coalesce("asset_id", "vec_id") == F.col("_live"), "left_anti")


def stats(assets: DataFrame, vectors: DataFrame) -> DataFrame:
    """Active assets and vectors per space, with 0 for an empty space."""
    spark = assets.sparkSession
    spaces = spark.createDataFrame([(s,) for s in ("visual", "text", "clip")], "name string")
    counts = vectors.groupBy(F.col("space").alias("name")).agg(F.count("*").alias("n"))
    per = F.broadcast(spaces).join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return per.unionByName(assets.agg(F.lit("assets").alias("name"), F.count_if(F.col("state") == "active").alias("n")))

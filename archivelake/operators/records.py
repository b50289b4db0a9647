"""Asset records from scanned files: images in three stages, paged documents page by page, as nested rows of ``schema.ASSETS``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import models as M
from .. import schema
from ..functions import hashing
from ..functions import text as T

REGIONS_PER_PAGE = 8
RENDERED = ("scanned", "mixed", "figure")


def to_schema(rows: DataFrame) -> DataFrame:
    """The columns of an asset in order and type; missing ones are null."""
    from pyspark.sql.types import _parse_datatype_string

    own = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in _parse_datatype_string(schema.ASSETS)])


def extract_partial(files: DataFrame, models: M.Models) -> DataFrame:
    """Stage 1, in parallel: objects, faces and text of files (path, sha256, pixel_hash, phash, size_bytes, width, height)."""
    path = F.col("path")
    return files.withColumns({"_objects": M.objects(path, models), "_faces": M.faces(path, models), "_ocr": M.ocr(path, models)})


def add_scene(rows: DataFrame, models: M.Models, at_once: int | None = None) -> DataFrame:
    """Stage 2: caption and tags; ``at_once`` bounds how many tasks use the captioning model."""
    rows = rows.coalesce(at_once) if at_once else rows
    return rows.withColumn("_scene", M.scene(F.col("path"), models))


def finalize(rows: DataFrame, models: M.Models) -> DataFrame:
    """Stage 3: embedding inputs, vectors and the record of what made them."""
    labels = F.transform("_objects.value", lambda o: o["label"])
    visual, text = T.visual_input(F.col("_scene.value.caption"), F.col("_scene.value.tags"), labels), T.strip(F.col("_ocr.value.full_text"))
    rows = rows.withColumns({"_visual": visual, "_text": text})
    vectors = F.struct(
        M.embedding(F.col("_visual"), models).alias("visual"), M.embedding(F.col("_text"), models).alias("text"), M.pixels(F.col("path"), models).alias("clip"),
        F.col("_visual").alias("visual_input"), F.col("_text").alias("text_input"), F.lit(M.embedding_label(models)).alias("model"),
    )
    used = F.create_map(*[x for k in ("objects", "faces", "scene", "ocr") for x in (F.lit(k), F.col(f"_{k}.backend"))])
    out = rows.select(
        F.col("path").alias("asset_id"), "path", F.lit("image").alias("kind"), "sha256", "pixel_hash", "phash", hashing.hex_to_long(F.col("phash")).alias("phash64"), "size_bytes",
        F.struct("width", "height").alias("resolution"), F.upper(T.extension(F.col("path"))).alias("format"), F.lit(True).alias("indexed"), F.lit("active").alias("state"), F.current_timestamp().alias("updated_at"),
        F.col("_objects.value").alias("objects"), F.col("_faces.value").alias("faces"), F.col("_scene.value").alias("scene"), F.col("_ocr.value").alias("ocr"), vectors.alias("embeddings"), used.alias("models_used"),
        F.lit(schema.VERSION).alias("version"),
    )
    return to_schema(out)


def images(files: DataFrame, models: M.Models, at_once: int | None = None) -> DataFrame:
    return finalize(add_scene(extract_partial(files, models), models, at_once), models)


def documents(files: DataFrame, pages: DataFrame, models: M.Models, rendered: bool = True) -> DataFrame:
    """Paged files (path, sha256, size_bytes) with their pages (path, page_index, text, boxes) as records.

    A page is classified by its text and images. Pages that can be shown have a region per embedded image, at most eight, or, if they are
    an image as a whole, one region; scanned pages without text get it from recognition. Regions take the place of images: their
    id stands for the path.
    """
    text = T.strip(F.coalesce("text", F.lit("")))
    rows = pages.select("path", "page_index", text.alias("text"), F.coalesce("boxes", F.array().cast("array<array<double>>")).alias("boxes"))
    rows = rows.withColumn("page_type", T.page_type(F.length("text"), F.size("boxes"))).withColumn("page_id", F.concat("path", F.lit("#p"), "page_index"))
    if models.ocr is not None and rendered:
        read = M.ocr(F.col("page_id"), models)["value"]["full_text"]
        rows = rows.withColumn("text", F.when((F.col("page_type") == "scanned") & (F.col("text") == ""), T.strip(read)).otherwise(F.col("text")))
    shown = F.col("page_type").isin(*RENDERED) if rendered else F.lit(False)
    none = F.array().cast("array<array<double>>")
    whole = F.when(F.col("page_type").isin("scanned", "figure"), F.array(F.array().cast("array<double>"))).otherwise(none)
    wanted = F.when(shown, F.when(F.size("boxes") > 0, F.slice("boxes", 1, REGIONS_PER_PAGE)).otherwise(whole)).otherwise(none)
    regions = rows.select("page_id", F.posexplode(wanted).alias("j", "bbox")).withColumn("path", F.concat("page_id", F.lit("#r"), "j"))
    regions = regions.withColumns({"_o": M.objects(F.col("path"), models), "_s": M.scene(F.col("path"), models)})
    regions = regions.withColumn("visual_input", T.visual_input(F.col("_s.value.caption"), F.col("_s.value.tags"), F.transform("_o.value", lambda o: o["label"])))
    regions = regions.withColumns({"visual": M.embedding(F.col("visual_input"), models), "clip": M.pixels(F.col("path"), models)})
    region = F.struct("j", F.struct(F.col("path").alias("region_id"), "bbox", F.col("_o.value").alias("objects"), F.col("_s.value").alias("scene"), "visual_input", "visual", "clip").alias("r"))
    held = regions.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(region), lambda a, b: a["j"] - b["j"]), lambda x: x["r"]).alias("regions"))
    kind = held.schema["regions"].dataType
    rows = rows.join(held, "page_id", "left").withColumn("text_vector", F.when(F.col("text") != "", M.embedding(F.col("text"), models)))
    page = F.struct("page_index", "page_type", "text", F.col("text").alias("text_input"), "text_vector", F.coalesce("regions", F.array().cast(kind)).alias("regions"))
    made = rows.groupBy("path").agg(F.array_sort(F.collect_list(page), lambda a, b: a["page_index"] - b["page_index"]).alias("pages"))
    return to_schema(
        files.join(made, "path", "left").select(
            F.col("path").alias("asset_id"), "path", F.lit("pdf").alias("kind"), "sha256", F.lit("").alias("pixel_hash"), F.lit("").alias("phash"), "size_bytes", F.coalesce(F.size("pages"), F.lit(0)).alias("n_pages"),
            F.lit("PDF").alias("format"), F.lit(True).alias("indexed"), F.lit("active").alias("state"), F.current_timestamp().alias("updated_at"), "pages", F.lit(schema.VERSION).alias("version"),
        )
    )


def summaries(assets: DataFrame) -> DataFrame:
    """What a library shows of each asset: id, path, kind, caption (``PDF · N pages`` where there is none), has_text, n_faces."""
    number = F.concat(F.lit("PDF · "), F.coalesce(F.size("pages"), F.lit(0)), F.lit(" pages"))
    caption = F.coalesce(F.nullif("scene.caption", F.lit("")), F.when(F.col("kind") == "pdf", number).otherwise(""))
    return assets.select(F.col("asset_id").alias("id"), "path", "kind", caption.alias("caption"), F.coalesce("ocr.has_text", F.lit(False)).alias("has_text"), F.greatest(F.lit(0), F.coalesce(F.size("faces"), F.lit(0))).alias("n_faces"))


def to_json(assets: DataFrame) -> DataFrame:
    """One JSON text per asset, with all its fields."""
    return assets.select("asset_id", F.to_json(F.struct(*assets.columns)).alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    """Assets from their JSON texts (column json); fields that are missing are null."""
    return rows.select(F.from_json("json", schema.ASSETS).alias("a")).select("a.*")

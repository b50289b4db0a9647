"""Folder scans, hashed files, decoded images and page-level documents."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, text


def clean_path(path: Column) -> Column:
    """The image and binary readers spell local paths differently; one form for joins."""
    return F.regexp_replace(path, "^file:/+", "/")


def plain(path: str) -> str:
    """A path that Spark's readers take by the letter: signs of patterns lose their meaning."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def is_file(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(at) and fs.getFileStatus(at).isFile()


def files(spark: SparkSession, where: str | list[str], every: bool = False) -> DataFrame:
    """Files of a folder and its subfolders with an indexed extension in any case; a single file, or each of a list, is taken as it is."""
    every = every or isinstance(where, list) or is_file(spark, where)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(located(where))
    rows = rows.withColumn("path", clean_path(F.col("path")))
    return rows if every else rows.where(text.is_indexable(F.col("path")))


def located(where: str | list[str]) -> str | list[str]:
    return [plain(p) for p in where] if isinstance(where, list) else plain(where)


def listing(spark: SparkSession, folders: list[str]) -> DataFrame:
    """path, size_bytes and modificationTime of all files below the folders; contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(located(folders))
    return rows.select(clean_path(F.col("path")).alias("path"), F.col("length").alias("size_bytes"), "modificationTime")


def outermost(folders: list[str]) -> list[str]:
    """Without those that lie in another one."""
    out: list[str] = []
    for f in sorted({f.rstrip("/") for f in folders}):
        if not out or not f.startswith(f"{out[-1]}/"):
            out.append(f)
    return out


def hashed(rows: DataFrame) -> DataFrame:
    return rows.select("path", "modificationTime", F.col("length").alias("size_bytes"), hashing.file_digest(F.col("content")).alias("sha256"))


def rgb(data: bytes | None, channels: int) -> np.ndarray | None:
    """Decoded pixels of the image source (blue first, 1, 3 or 4 channels) as RGB rows; None if nothing was decoded."""
    if not data or channels not in (1, 3, 4):
        return None
    px = np.frombuffer(data, np.uint8).reshape(-1, channels)
    return np.repeat(px, 3, axis=1) if channels == 1 else px[:, 2::-1]


def lanczos(gray: np.ndarray, width: int = 9, height: int = 8, lobes: int = 3) -> np.ndarray:
    """Resize by a separable windowed sinc, widened when shrinking."""
    def weights(n: int, m: int) -> np.ndarray:
        scale = max(n / m, 1.0)
        centre = (np.arange(m) + 0.5) * n / m
        x = (np.arange(n)[None, :] + 0.5 - centre[:, None]) / scale
        w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
        return w / w.sum(axis=1, keepdims=True)

    return np.clip(np.rint(weights(gray.shape[0], height) @ gray @ weights(gray.shape[1], width).T), 0, 255).astype(int)


def images(spark: SparkSession, where: str | list[str]) -> DataFrame:
    """path, width, height, pixel_hash and phash of decodable images; empty hashes for the rest."""
    raw = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(located(where)).select("image.*")

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in batches:
            pixel, gray = [], []
            for data, n, w, h in zip(b["data"], b["nChannels"], b["width"], b["height"], strict=True):
                px = rgb(bytes(data) if data is not None else None, n)
                pixel.append("" if px is None else "px:" + hashlib.sha256(px.tobytes()).hexdigest())
                gray.append(None if px is None else lanczos((px @ np.array([0.299, 0.587, 0.114])).reshape(h, w)).ravel().tolist())
            yield pd.DataFrame({"path": b["origin"], "width": b["width"], "height": b["height"], "pixel_hash": pixel, "gray": gray})

    rows = raw.mapInPandas(one, "path string, width int, height int, pixel_hash string, gray array<int>")
    phash = F.when(F.col("gray").isNotNull(), hashing.bits_to_hex(hashing.dhash_bits(F.col("gray")))).otherwise("")
    return rows.select(clean_path(F.col("path")).alias("path"), "width", "height", "pixel_hash", phash.alias("phash"))


def documents(rows: DataFrame, reader: Callable[[bytes], list[tuple[str, list]]]) -> DataFrame:
    """Pages of binary documents: ``reader`` turns bytes into (text, image boxes) per page and is called in the workers; a document
    that it fails on has no pages."""
    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    out += [(path, i, t, [[float(v) for v in box] for box in boxes]) for i, (t, boxes) in enumerate(reader(bytes(content)))]
                except Exception:  # noqa: BLE001 - an unreadable document must not stop the others
                    continue
            yield pd.DataFrame(out, columns=["path", "page_index", "text", "boxes"])

    return rows.select("path", "content").mapInPandas(one, "path string, page_index int, text string, boxes array<array<double>>")

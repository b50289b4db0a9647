"""Shared pieces of the corpus operators: scratch tables, whole-text batches and word hashes.

Scratch tables go to the folder named by ``spark.checkpoint.dir``, which every executor sees, so a
lost executor costs a re-run of tasks and never data.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are hashed in groups of about so many bytes, to keep the arrays of a task small.
GROUP_BYTES = 2_000_000


#: Setting under which shuffle files go at the end of the query that made them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that go to a Python worker at a time: with whole texts, the default of 10,000 holds too much at once.
BATCH_ROWS = 500


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's batch size for Python workers to BATCH_ROWS where it is larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


@contextmanager
def session_settings(spark: SparkSession, settings: dict):
    """Settings that hold for the jobs run inside and are put back afterwards."""
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, str(value))
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session; a local one is made only for local masters without a setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = f"file://{tempfile.mkdtemp(prefix='archivelake-')}"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


_MADE: list["Scratch"] = []


def _remove_all() -> None:
    """When the driver ends, remove what its calls left in the shared folder."""
    for scratch in _MADE:
        with suppress(Exception):  # the session may have ended first
            scratch.keep_only()


class Scratch:
    """Tables of one operator call, written to the shared folder and read back with their lineage cut. Operators drop tables once used; those
    that a result still reads stay until ``keep_only()`` or the end of the driver. With ``clean`` Spark removes the shuffle files of a table once it is written."""

    def __init__(self, spark: SparkSession, name: str, clean: bool = False):
        bounded_batches(spark)
        self.settings = {CLEANUP: "true"} if clean else {}
        self.spark, self.path = spark, f"{scratch_root(spark)}/archivelake/{name}-{uuid.uuid4().hex}"
        if not _MADE:
            atexit.register(_remove_all)
        _MADE.append(self)

    def write(self, df: DataFrame, table: str) -> DataFrame:
        with session_settings(self.spark, self.settings):
            df.write.mode("overwrite").parquet(f"{self.path}/{table}")
        return self.read(table, df)

    def read(self, table: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{table}")

    def drop(self, *tables: str) -> None:
        for table in tables:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def keep_only(self, *tables: str) -> None:
        """Remove all other tables of this call."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(at):
            for s in fs.listStatus(at):
                if s.getPath().getName() not in tables:
                    fs.delete(s.getPath(), True)


def text_or_empty(text) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def grouped(texts: list, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of the list that hold about ``most`` characters, at least one text each."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def text_groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[str]]]:
    """Lists of keys and texts (the first two columns, null texts as empty) of about ``most`` characters, over the borders of batches."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(key)
            texts.append(text or "")
            size += len(text or "")
            if size >= most:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a sequence of two hashed parts."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def hashed_words(texts: list, lower: bool = False, key: str = "0123456789123456") -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes (under a key of 16 characters) of the words of all texts in a row, and the number of words of each text."""
    words: list[bytes] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        raw = text_or_empty(text)
        own = (raw.lower() if lower else raw).split()  # bytes: A-Z only; splits at WORD's gaps exactly
        counts[i] = len(own)
        words += own
    values = np.empty(len(words), dtype=object)
    values[:] = words
    return (pd.util.hash_array(values, hash_key=key, categorize=False) if words else np.zeros(0, np.uint64)), counts


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values, by doubling."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    result, have, power, size, left = None, 0, h, 1, width
    while left:
        if left & 1:
            if result is None:
                result = power
            else:
                n = len(h) - have - size + 1
                result = joined(result[:n], power[have : have + n])
            have += size
        left >>= 1
        if left:
            n = len(power) - size
            power, size = joined(power[:n], power[size : size + n]), 2 * size
    return result[: len(h) - width + 1]


def inside(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows of ``width`` over texts in a row: which start positions stay in one text, and the text of each of those."""
    total = int(counts.sum())
    owner = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)[owner] if total else np.zeros(0, np.int64)
    ok = np.flatnonzero(np.arange(total) + width <= ends)
    return ok, owner[ok]


def give_back() -> None:
    """Return to the system what this worker has freed; workers live on from stage to stage, and their unused memory would add up."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every system has it
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose workers give memory back at the end of a task."""
    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(trimmed, schema)


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict], schema: str) -> DataFrame:
    """Apply ``fn`` to column lists of each Arrow batch; it returns column lists by name."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_batches(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return mapped(df, run, schema)


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64, copy=False).view(np.int64)


def prepared(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, in that order; other columns, whatever their names, stay outside."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


#: Tables of at most so many narrow rows (a few MB) may be sent to all tasks; the number is checked first.
MOST_SENT_ROWS = 100_000


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Mark a join side of a counted size as sendable; beyond the bound Spark shuffles and splits skewed keys."""
    return F.broadcast(df) if rows <= MOST_SENT_ROWS else df

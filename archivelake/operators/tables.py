"""Tables that several branches of a plan read, in the shared folder, and their removal."""

from __future__ import annotations

import atexit
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

_OWN = threading.local()
_LEFT: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_left() -> None:
    for spark, path in _LEFT:
        with suppress(Exception):  # the session may have ended first
            _remove(spark, path)


def kept(df: DataFrame) -> DataFrame:
    """The rows, computed once and written as a table, so that no branch computes them again and a lost executor costs nothing. The table goes with the ``scope`` it is
    made in, or else with the driver."""
    from ..sources.store import shared_folder

    spark = df.sparkSession
    path = f"{shared_folder(spark)}/archivelake/kept-{uuid.uuid4().hex}"
    if not _LEFT:
        atexit.register(_remove_left)
    getattr(_OWN, "tables", _LEFT).append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope() -> Iterator[None]:
    """Tables that this thread keeps inside are removed at the end; results that read them must be taken before."""
    outer, _OWN.tables = getattr(_OWN, "tables", None), []
    try:
        yield
    finally:
        made = _OWN.tables
        if outer is None:
            del _OWN.tables
        else:
            _OWN.tables = outer
        for spark, path in made:
            _remove(spark, path)

"""Versioned store: immutable Parquet deltas under an optimistic commit log.

A commit writes the changed assets and the vectors derived from them to a folder of its own and then appends an entry to the log, which names that folder and the version that
the commit has read. If others have committed since, it follows them where it can (they touch none of its assets, or it reads nothing) and is made
anew from what holds now where it can't. A snapshot replaces what it has read and keeps what came meanwhile. Readers take one state of the log: the latest row of each
asset counts, with the vectors of the same commit. All deltas are read in one scan, whatever their number.

What no state needs stays for ``retention`` seconds, for readers at work, and is then removed by ``vacuum``. A folder that never got into the log is never seen. It
is removed when its commit fails; ``recover`` removes those of writers that died, by age, so it can't touch one at work.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .commit_log import CommitConflict, CommitLog

#: Seconds after which files outside the log count as left behind, and for which replaced files stay.
ABANDONED, RETENTION = 24 * 3600.0, 3600.0
#: Deltas after which a commit is followed by a snapshot, and tries of a change that others keep overtaking.
COMPACT_AFTER, TRIES = 32, 5
DELTA = "_delta"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only for a local master without a setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = f"file://{tempfile.mkdtemp(prefix='archivelake-')}"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Store:
    """Assets (asset_id, state, indexed, ...) and their vectors (space, asset_id, ...) at a path on any file system that Spark reads.

    ``derive`` turns assets into vectors. ``assets()`` are the current rows; ``_op`` and commit numbers stay inside.
    """

    def __init__(self, spark: SparkSession, path: str, derive, compact_after: int = COMPACT_AFTER, retention: float = RETENTION):
        self.spark, self.path, self.derive = spark, path.rstrip("/"), derive
        self.compact_after, self.retention = compact_after, retention
        self.log = CommitLog(spark, f"{self.path}/commits")
        self._jvm, self._fs = self.log._jvm, self.log.fs

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at) if not s.getPath().getName().startswith(".")) if self._fs.exists(at) else []

    # reading

    def commits(self) -> list[dict]:
        """The commits that count, oldest first: the last whole snapshot and what came after."""
        return self.log.state()["live"]

    def current(self) -> str | None:
        """Name of the newest commit."""
        version = self.log.state()["version"]
        return f"{version:012d}" if version else None

    def _versions(self, kind: str, state: dict) -> DataFrame | None:
        """All rows of a kind since the last whole snapshot, with the number of their commit as ``_commit``: one scan."""
        live = [c for c in state["live"] if kind == "assets" or c["vectors"]]
        if not live:
            return None
        schema = StructType.fromJson(state["schemas"][kind]).add(DELTA, StringType())
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/{DELTA}={c['folder']}" for c in live])
        numbers = F.map_from_arrays(F.array(*[F.lit(c["folder"]) for c in live]), F.array(*[F.lit(c["number"]).cast("bigint") for c in live]))
        return rows.withColumn("_commit", F.element_at(numbers, F.col(DELTA))).drop(DELTA)

    def _latest(self, state: dict) -> DataFrame | None:
        rows = self._versions("assets", state)
        return rows.groupBy(F.col("asset_id").alias("_id")).agg(F.max_by(F.struct("*"), "_commit").alias("r")).select("r.*").where("_op <> 'delete'") if rows is not None else None

    def assets(self, version: int | None = None) -> DataFrame | None:
        """The current rows, or those of an earlier version that is still kept; tombstones (state 'deleted') are included until they are finished."""
        rows = self._latest(self.log.state(version))
        return rows.drop("_op", "_commit") if rows is not None else None

    def vectors(self, version: int | None = None) -> DataFrame | None:
        """Vectors of the commit that wrote the current row of their active asset."""
        state = self.log.state(version)
        rows = self._versions("vectors", state)
        if rows is None:
            return self.derive(self._latest(state).drop("_op", "_commit").where("state = 'active'")).limit(0) if state["live"] else None
        live = self._latest(state).where("state = 'active'").select("asset_id", "_commit")
        return rows.join(live, ["asset_id", "_commit"], "left_semi").drop("_commit")

    # writing

    def _write(self, assets: DataFrame, op: str, whole: bool, before_pointer=None, vectors: bool = True, read: int | None = None, of: int | None = None, fits=None) -> str:
        """Write a commit and append it to the log. ``of`` is the version that a snapshot shows; ``fits`` is asked about commits since ``read``."""
        folder = uuid.uuid4().hex
        read = self.log.state()["version"] if read is None else read
        try:
            assets = assets.withColumn("_op", F.lit(op))
            assets.write.parquet(f"{self.path}/assets/{DELTA}={folder}")
            schemas = {"assets": json.loads(assets.schema.json())}
            if vectors:
                stored = self.spark.read.schema(assets.schema).parquet(f"{self.path}/assets/{DELTA}={folder}").drop("_op")
                derived = self.derive(stored.where("state = 'active'"))
                derived.write.partitionBy("space").parquet(f"{self.path}/vectors/{DELTA}={folder}")
                vectors = any(n.startswith("space=") for n in self._names(f"vectors/{DELTA}={folder}"))
                schemas["vectors"] = json.loads(derived.schema.json())
            if before_pointer:
                before_pointer()
            entry = {"folder": folder, "op": op, "whole": whole, "vectors": vectors, "schemas": schemas} | ({} if of is None else {"of": of})
            number = self.log.append(entry, read, fits)
        except BaseException:
            for kind in ("assets", "vectors"):
                self._fs.delete(self._at(kind, f"{DELTA}={folder}"), True)
            raise
        if not whole and len(self.log.state()["live"]) > self.compact_after:
            try:
                self.compact()
                self.vacuum()
            except Exception as e:  # noqa: BLE001 - the commit itself is done
                warnings.warn(f"the snapshot after commit {number} failed: {e}", stacklevel=2)
        return f"{number:012d}"

    def _changed(self, make, ids, op: str, vectors: bool = True) -> str:
        """Commit what ``make(assets)`` says, made from the current rows, for the assets of ``ids``; made again if others change those assets meanwhile."""
        for left in reversed(range(TRIES)):
            state = self.log.state()
            rows = self._latest(state)
            if rows is None:
                raise ValueError(f"the store at {self.path} is empty")

            def fits(newer: list[dict]) -> None:
                folders = [f"{self.path}/assets/{DELTA}={e['folder']}" for e in newer if "of" not in e]
                if folders and not self.spark.read.schema("asset_id " + ids.schema["asset_id"].dataType.simpleString()).parquet(*folders).join(ids, "asset_id", "left_semi").isEmpty():
                    raise CommitConflict(f"assets of this {op} were changed since version {state['version']}")

            try:
                return self._write(make(rows.drop("_op", "_commit")), op, False, vectors=vectors, read=state["version"], fits=fits)
            except CommitConflict:
                if not left:
                    raise
        raise AssertionError

    def commit(self, assets: DataFrame, before_pointer=None) -> str:
        """Replace everything, whatever others have committed, by a whole new snapshot; ``before_pointer`` is called between writing and logging (for tests of crashes)."""
        return self._write(assets, "insert", True, before_pointer)

    def insert(self, assets: DataFrame) -> str:
        """Add assets with their vectors; one that is there already, or was deleted, is replaced."""
        return self._write(self._ready(assets), "insert", False)

    upsert = insert

    def update(self, assets: DataFrame) -> str:
        """Replace assets that are there; others are left out. Their old vectors are no longer read."""
        make = lambda own: self._ready(assets.join(own.where("state = 'active'").select("asset_id"), "asset_id", "left_semi"))
        return self._changed(make, assets.select("asset_id"), "update")

    def delete(self, ids: DataFrame) -> str:
        """Remove assets (asset_id) and their vectors."""
        make = lambda own: own.join(ids.select("asset_id"), "asset_id", "left_semi").withColumn("state", F.lit("deleted"))
        return self._changed(make, ids.select("asset_id"), "delete", vectors=False)

    @staticmethod
    def _ready(assets: DataFrame) -> DataFrame:
        rows = assets.withColumn("state", F.lit("active")).withColumn("indexed", F.lit(True))
        return rows.withColumn("updated_at", F.current_timestamp()) if "updated_at" in rows.columns else rows

    # care

    def compact(self, before_pointer=None) -> str | None:
        """Write the current rows as one whole snapshot, so that readers need no older commit. What others commit meanwhile stays on top of it."""
        state = self.log.state()
        if not state["live"]:
            return None
        return self._write(self._latest(state).drop("_op", "_commit"), "insert", True, before_pointer, read=state["version"], of=state["version"])

    def vacuum(self, retention: float | None = None) -> int:
        """Remove folders and log entries that were replaced at least ``retention`` seconds ago; returns the number of folders."""
        retention, state, removed = self.retention if retention is None else retention, self.log.state(), 0
        live = {c["folder"] for c in state["live"]}
        for g in state["gone"]:
            if time.time() - g["time"] >= retention and g["folder"] not in live:
                removed += sum(bool(self._fs.delete(self._at(kind, f"{DELTA}={g['folder']}"), True)) for kind in ("assets", "vectors")) > 0
        self.log.clean(retention)
        return removed

    def recover(self, older_than: float = ABANDONED) -> dict:
        """Remove files that never got into the log and are older than ``older_than`` seconds, and derive the vectors of active rows that aren't indexed."""
        before = {kind: self._names(kind) for kind in ("assets", "vectors")}  # listed before the log is read: what is committed in between is in the log
        state = self.log.state()
        held = {f"{DELTA}={c['folder']}" for c in (*state["live"], *state["gone"])}
        removed = 0
        for kind, names in before.items():
            for name in names:
                if name not in held and time.time() - self._fs.getFileStatus(self._at(kind, name)).getModificationTime() / 1000 >= older_than:
                    self._fs.delete(self._at(kind, name), True)
                    removed += kind == "assets"
        own = self.assets()
        broken = own.where("state = 'active' and not indexed") if own is not None and "indexed" in own.columns else None
        n = broken.count() if broken is not None else 0
        if n:
            self._changed(lambda rows: self._ready(rows.where("state = 'active' and not indexed")), broken.select("asset_id"), "insert")
        return {"abandoned": removed, "reindexed": n}

    def reconcile(self) -> dict:
        """Finish tombstones; where vectors are left that no current asset of their commit owns, write a snapshot without them and remove replaced files by retention."""
        own = self.assets()
        if own is None:
            return {"tombstones_finished": 0, "orphans_purged": 0}
        tombstones = own.where("state = 'deleted'").select("asset_id")
        n = tombstones.count()
        if n:
            self.delete(tombstones)
        state = self.log.state()
        stored = self._versions("vectors", state)
        orphans = stored.count() - self.vectors(state["version"]).count() if stored is not None else 0
        if orphans:
            self.compact()
        self.vacuum()
        return {"tombstones_finished": n, "orphans_purged": orphans}

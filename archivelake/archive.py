"""An archive: a store with its models, and what users do with it."""

from __future__ import annotations

import hashlib
import re
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import models as M
from . import schema
from .functions import hashing
from .functions import text as T
from .operators import dedup, records, reporting, search, vectors
from .operators.tables import kept, scope
from .sources import scan
from .sources.store import Store
from .streaming.folder_source import FolderSource

EMPTY = "asset_id string, path string, sha256 string, pixel_hash string, phash bigint"
#: Files that are indexed again at a time.
BATCH = 5000


class Job:
    """A call in a thread of the driver, whose state and progress can be asked for while it runs."""

    def __init__(self, call: Callable[["Job"], dict], spark: SparkSession | None = None):
        self.name, self.state, self.report, self.error, self.began = uuid.uuid4().hex, "running", {}, "", time.time()
        self._context = spark.sparkContext if spark else None
        self._thread = threading.Thread(target=self._run, args=(call,), daemon=True)
        self._thread.start()

    def _run(self, call) -> None:
        _WORK.job = self
        if self._context:
            self._context.setJobGroup(self.name, f"job {self.name}")
        try:
            self.report = self.report | call(self)
            self.state = "done"
        except Exception as e:  # noqa: BLE001 - kept for whoever asks
            self.state, self.error = "failed", str(e)

    def tasks(self) -> dict:
        """Spark's tasks of this call so far: planned and done."""
        if not self._context:
            return {}
        tracker, out = self._context.statusTracker(), {"tasks": 0, "tasks_done": 0}
        stages = {s for j in tracker.getJobIdsForGroup(self.name) if (info := tracker.getJobInfo(j)) for s in info.stageIds}
        for s in filter(None, map(tracker.getStageInfo, stages)):
            out = {"tasks": out["tasks"] + s.numTasks, "tasks_done": out["tasks_done"] + s.numCompletedTasks}
        return out

    def status(self) -> dict:
        return {"state": self.state, "seconds": round(time.time() - self.began, 3), "error": self.error} | self.tasks() | self.report

    def wait(self) -> dict:
        self._thread.join()
        return self.status()


#: The job that a thread works for.
_WORK = threading.local()


def note(**facts) -> None:
    """Show facts in the status of the job that is running."""
    if job := getattr(_WORK, "job", None):
        job.report = job.report | facts


class Archive:
    """``reader`` turns the bytes of a paged document into (text, image boxes) per page; without it such files are skipped."""

    def __init__(self, spark: SparkSession, path: str, models: M.Models | None = None, reader=None):
        self.spark, self.models, self.reader = spark, models or M.Models(), reader
        self.store = Store(spark, path, vectors.flatten)
        self.jobs: dict[str, Job] = {}
        self._watch = None
        self._watched = {"folder": "", "batches": 0, "files": 0, "stats": {}}

    # indexing

    def assets(self) -> DataFrame:
        own = self.store.assets()
        return own if own is not None else records.to_schema(self.spark.createDataFrame([], "asset_id string"))

    def vectors(self) -> DataFrame:
        own = self.store.vectors()
        return own if own is not None else self.spark.createDataFrame([], schema.VECTORS)

    def _known(self) -> DataFrame:
        return self.assets().where("state = 'active'").select("asset_id", "path", "sha256", "pixel_hash", F.col("phash64").alias("phash"))

    def _files(self, where: str | list[str]) -> DataFrame:
        """Files with all three hashes; those that aren't decodable images have only the first."""
        found = scan.hashed(scan.files(self.spark, where))
        seen = found.join(scan.images(self.spark, where), "path", "left")
        return kept(seen.withColumns({c: F.coalesce(c, F.lit("")) for c in ("pixel_hash", "phash")}).withColumn("phash_hex", F.col("phash")).withColumn("phash", hashing.hex_to_long(F.col("phash_hex"))).withColumn("id", F.col("path")))

    def index(self, where: str | list[str], force: bool = False, at_once: int | None = None) -> dict:
        """Index a folder, a file, or files: plan against the store and within the batch, extract, caption, finalise, commit. Returns statuses, number processed,
        wall time and seconds per stage."""
        with scope():
            return self._index(where, force, at_once)

    def _index(self, where: str | list[str], force: bool, at_once: int | None) -> dict:
        began, spent = time.time(), {}
        note(stage="scan")

        def timed(stage: str, make):
            t = time.time()
            note(stage=stage)
            out = make()
            spent[stage] = time.time() - t
            return out

        files = self._files(where)
        is_document = T.extension(F.col("path")) == "pdf"
        plan = kept(dedup.batch_plan(files if self.reader else files.where(~is_document), self._known(), force))
        names = {"insert": "indexed", "update": "updated"}
        tally = {names.get(r["action"], r["action"]): r["n"] for r in reporting.tally(plan, "action").collect()}
        if not self.reader and (n := files.where(is_document).count()):
            tally["skipped"] = n
        note(stage="extract", files=sum(tally.values()), total=sum(tally.get(k, 0) for k in ("indexed", "updated")), stats=dict(tally))
        taken = files.join(plan.where("action in ('insert', 'update')"), "id", "left_semi")
        pictures = taken.where(~is_document).drop("phash").withColumnRenamed("phash_hex", "phash")
        partial = timed("extract", lambda: kept(records.extract_partial(pictures, self.models)))
        scenes = timed("vlm", lambda: kept(records.add_scene(partial, self.models, at_once)))
        rows = timed("finalize", lambda: kept(records.finalize(scenes, self.models)))
        if self.reader:
            papers = taken.where(is_document)
            raw = scan.files(self.spark, where).join(papers.select("path"), "path", "left_semi")
            rows = rows.unionByName(records.documents(papers, kept(scan.documents(raw, self.reader)), self.models))
        processed = sum(tally.get(k, 0) for k in ("indexed", "updated"))
        if processed:
            timed("write", lambda: self.store.insert(rows))
        wall = time.time() - began
        per = {s: {"count": processed, "avg_ms": round(1000 * spent.get(s, 0.0) / processed, 2) if processed else 0.0, "total_s": round(spent.get(s, 0.0), 3)} for s in reporting.STAGES}
        return {"stats": tally, "processed": processed, "wall_s": round(wall, 3), "per_s": round(processed / wall, 3) if wall > 0 else 0.0, "timings": per}

    def process(self, name: str, content: bytes) -> dict:
        """Index an upload; its bytes are kept beside the store."""
        path = f"{self.store.path}/uploads/{uuid.uuid4().hex}/{name.rsplit('/', 1)[-1] or 'upload.bin'}"
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        out = self.store._fs.create(at, False)
        out.write(bytearray(content))
        out.close()
        return self.index(path) | {"path": path}

    def reindex_all(self) -> dict:
        """Process exactly the indexed files that still exist again, in batches."""
        known = self.assets().where("state = 'active'").select("path")
        fs, path = self.store._fs, self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        folders = [r["path"] for r in known.select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct().collect()]
        folders = [f for f in scan.outermost(folders) if fs.exists(path(f))]
        report = {"processed": 0, "files": 0, "batches": 0}
        if folders:
            with scope():  # what is indexed again is as it was before the first batch
                paths, batch = kept(scan.listing(self.spark, folders).join(known, "path", "left_semi").select("path")), []
                rows = paths.toLocalIterator()
                while batch := [r["path"] for _, r in zip(range(BATCH), rows)]:
                    report = {"processed": report["processed"] + self.index(batch, force=True)["processed"], "files": report["files"] + len(batch), "batches": report["batches"] + 1}
        return report

    def start(self, call: Callable[["Archive"], dict]) -> str:
        """Run a call in the background; returns the name to ask ``status`` for."""
        job = Job(lambda _: call(self), self.spark)
        self.jobs[job.name] = job
        return job.name

    def status(self, name: str) -> dict:
        return self.jobs[name].status() if name in self.jobs else {"state": "unknown"}

    # watching

    def watch(self, folder: str, seconds: float = 5.0, files_per_batch: int = 1000, settle: float = 0.5) -> None:
        """Index new and edited files of a folder from now on, in the background and in bounded batches. Started again, also by another driver, it goes on where it was;
        files that are as before aren't opened."""
        self.unwatch()
        self.spark.dataSource.register(FolderSource)
        folder = self._uri(folder)
        base = self._uri(f"{self.store.path}/watch/{hashlib.sha256(folder.encode()).hexdigest()[:16]}")
        options = {"path": folder, "log": f"{base}/files", "filesPerBatch": files_per_batch, "settleSeconds": settle, "extensions": ",".join(T.EXTENSIONS)}
        self._watched = {"folder": folder, "batches": 0, "files": 0, "stats": {}}
        found = self.spark.readStream.format("archive_folder").options(**options).load()
        self._watch = found.writeStream.foreachBatch(self._take).option("checkpointLocation", f"{base}/checkpoint").trigger(processingTime=f"{round(1000 * seconds)} milliseconds").start()

    def _uri(self, path: str) -> str:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return re.sub("^file:/+", "file:///", at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString())

    def _take(self, found: DataFrame, number: int) -> None:
        """A batch of the folder stream (at most ``files_per_batch`` names)."""
        paths = [r["path"] for r in found.select("path").collect()]
        there = [p for p in paths if scan.is_file(self.spark, p)]
        if there:
            for status, n in self.index(there)["stats"].items():
                self._watched["stats"][status] = self._watched["stats"].get(status, 0) + n
        self._watched["batches"] += 1
        self._watched["files"] += len(there)

    def unwatch(self) -> None:
        if self._watch:
            self._watch.stop()

    @property
    def watching(self) -> bool:
        return self._watch is not None and self._watch.isActive

    def watch_status(self) -> dict:
        """What the watch has done so far, whether it is at work, and why it failed, if it did."""
        error = self._watch.exception() if self._watch is not None else None
        return self._watched | {"active": self.watching, "error": str(error) if error else ""}

    # asking

    def search(self, text: str | DataFrame, limit: int = 10, rerank=None, gap: float | None = None, kind: str | None = None, has_text: bool | str = False, label: str | None = None) -> DataFrame:
        """Result rows for a text, or for many (query_id, text)."""
        asked = self.spark.createDataFrame([(1, text)], "query_id bigint, text string") if isinstance(text, str) else text
        wanted = has_text if isinstance(has_text, bool) else has_text.strip().lower() in ("1", "true", "on")
        clip = self.models.clip_text
        own = (lambda t: M.pixels(t, replace(self.models, clip=clip))) if clip else None
        return search.text_search(asked, self.vectors(), self.assets(), lambda t: M.embedding(t, self.models, "query"), limit, embed_clip=own, rerank=rerank, gap=gap, kind=kind, with_text=wanted, label=label)

    def search_image(self, vector: list[float], limit: int = 24, **filters) -> DataFrame:
        asked = self.spark.createDataFrame([(1, [float(v) for v in vector])], "query_id bigint, embedding array<double>")
        return search.image_search(asked, self.vectors(), self.assets(), limit, **filters)

    def _document(self, asset_id: str) -> str:
        """The asset of an id: itself if there is one, or else the document of a page or region."""
        doc = re.sub("#p[0-9]+(#r[0-9]+)?$", "", asset_id)
        return asset_id if doc == asset_id or self.asset(asset_id) else doc

    def similar(self, asset_id: str, limit: int = 12) -> DataFrame:
        """More like an image, by its stored clip vector; a page's or region's id stands for its document, which has none of its own."""
        doc = self._document(asset_id)
        own = self.vectors().where(F.col("space") == "clip")
        stored = own.where((F.col("asset_id") == doc) & F.col("page_index").isNull()).select(F.lit(1).cast("bigint").alias("query_id"), "embedding", F.lit("clip").alias("space"))
        ranks = search.ranked_entities(stored, own, limit + 1).where(F.col("asset_id") != doc)
        return search.results(ranks, self.assets(), limit=limit)

    def ask(self, question: str, model=None) -> DataFrame:
        """An answer from the five best results, or the note that no model could be reached, with the sources."""
        asked = self.spark.createDataFrame([(1, question)], "query_id bigint, text string")
        found = kept(self.search(asked, 5))
        own = self.assets().join(found.select(F.col("path")).distinct(), "path", "left_semi")  # of at most five
        pages = own.select("asset_id", F.explode("pages").alias("p")).select(F.concat("asset_id", F.lit("#p"), "p.page_index").alias("id"), F.col("p.text").alias("text"))
        return search.ask(found, own.select(F.col("asset_id").alias("id"), F.col("ocr.full_text").alias("text")).unionByName(pages), asked, model)

    def asset(self, asset_id: str) -> dict | None:
        row = self.assets().where((F.col("asset_id") == asset_id) & (F.col("state") == "active")).first()
        return row.asDict(recursive=True) if row else None

    def library(self, limit: int = 200, offset: int = 0) -> DataFrame:
        """Summaries, newest first."""
        rows = self.assets().where("state = 'active' and indexed").orderBy(F.desc("updated_at"), "asset_id").offset(offset).limit(limit)
        return records.summaries(rows)

    def duplicates(self, folder: str) -> dict[str, DataFrame]:
        """Groups of equal and of near files of a folder."""
        files = self._files(folder)
        return {"exact": dedup.exact_groups(files), "near": dedup.near_groups(files)}

    def delete(self, asset_id: str) -> None:
        """Remove the asset of an id; a page's or region's id removes its document."""
        self.store.delete(self.spark.createDataFrame([(self._document(asset_id),)], "asset_id string"))

    def stats(self) -> dict[str, int]:
        return {r["name"]: r["n"] for r in vectors.stats(self.assets(), self.vectors()).collect()}

    # care

    def reconcile(self) -> dict:
        return self.store.reconcile()

    def recover(self) -> dict:
        return self.store.recover()

    def settings(self, enable_faces: str | None = None) -> dict:
        """The settings in force; ``enable_faces`` changes one of them (1, true, on and yes switch it on)."""
        if enable_faces is not None:
            self.models = self.models.with_faces(enable_faces)
        m = self.models
        return {"store": self.store.path, "enable_faces": m.enable_faces, "models": {k: getattr(m, k).label if getattr(m, k) else M.STUB for k in ("objects", "faces", "scene", "ocr", "embed", "clip")}}

    def health(self) -> dict:
        """Which models can be loaded on the driver."""
        out = {}
        for k in ("objects", "faces", "scene", "ocr", "embed", "clip"):
            model = getattr(self.models, k)
            try:
                out[k] = bool(model and model.load())
            except Exception:  # noqa: BLE001 - a model that can't be loaded isn't healthy
                out[k] = False
        return out


def report_text(report: dict, warm: bool = False) -> str:
    """The report of an index run for people."""
    lines = [f"processed  {report['processed']} files in {report['wall_s']} s{' (warm)' if warm else ''}", f"throughput {report['per_s']} files/s"]
    lines += [f"{stage:9} {t['avg_ms']:>9} ms a file, {t['total_s']:>8} s" for stage, t in report["timings"].items()]
    return "\n".join([*lines, "result     " + ", ".join(f"{k}={v}" for k, v in sorted(report["stats"].items()))])

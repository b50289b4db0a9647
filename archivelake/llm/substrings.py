"""Substring removal with a log-structured fingerprint index.

A document's words covered by a window of ``width`` words that also starts earlier are removed; windows are equal if their hashes of 128 bits are.

1. Each text gives the fingerprints of its sampled windows: hashes of ``gram`` words, of which the
   smallest in every window of ``width`` words is taken. Equal windows take the same fingerprint, so a repeated window always shows as a
   repeated fingerprint, and about one fingerprint per ``width - gram`` / 2 words is kept.
2. A batch becomes a sorted immutable run: counts of its fingerprints, dealt to a fixed number of buckets and sorted in them, one
   file per bucket. Runs lie in levels; a new run is merge-joined with all earlier ones bucket by bucket, with no exchange and no
   sort, since all runs share buckets and order. ``fanout`` runs of a level are merged to one of the next in the same way. What is
   found twice is shared.
3. Verification: only texts with shared fingerprints are read again; their whole windows that took those are compared across
   all documents by two hashes, of 64 and 32 bits, from word hashes under different keys (of 10^13 windows, some pair that differs has equal
   hashes with a chance below 1 in 1000).
4. The texts with repeated windows are read once more and cut.

``SubstringIndex`` is stored in a folder and can be opened again: ``add`` gives the results of a new batch, to which all batches
before it are earlier. ``deduplicated`` does a whole table: its batches, in ascending doc_id order, go through an index of its own,
and verification is done once for all.

Exact copies of an earlier document are settled by their digest before step 3. A frequent window
is aggregated before it is shuffled; joins on it are between stored tables, which Spark splits when skewed.

Defined cases: null texts count as empty (0 words, digest of the empty string); texts of fewer than ``width`` words stay whole; a
null doc_id sorts first (ids are taken to be above -2^63 + 1); rows with the same doc_id are separate texts of which neither is earlier; an
empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CLEANUP, Scratch, grouped, hashed_words, inside, map_batches, prepared, session_settings, signed, text_or_empty, window_hashes

#: Places in the order of documents: those of earlier batches, then those without doc_id, then by doc_id.
EARLIER, LEAST = -(2**63), -(2**63) + 1
EMPTY = hashlib.sha256(b"").hexdigest()
ROWS = "doc_id bigint, doc bigint, t bigint, n_words bigint, sha string, anchors array<bigint>, rid bigint"


def sliding_min(g: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values; none if there are fewer."""
    if len(g) < width:
        return g[:0]
    size, m = 1, g
    while 2 * size <= width:
        m, size = np.minimum(m[: len(m) - size], m[size:]), 2 * size
    rest = width - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def window_keys(h: np.ndarray, width: int, gram: int) -> np.ndarray:
    """For each window of ``width`` words, the fingerprint that it takes."""
    return sliding_min(window_hashes(h, gram), width - gram + 1)


class FingerprintIndex:
    """Sorted immutable runs (h, n) of fingerprint counts in levels, as bucketed tables under a path."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 2, buckets: int | None = None, levels: list[list[str]] | None = None):
        self.spark, self.path, self.fanout = spark, path, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = levels or []
        self.merged = 0
        for name in self.names():
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (h BIGINT, n BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{path}/{name}'")

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _settings(self):
        """One file per bucket when writing; its order is relied on when reading."""
        return session_settings(
            self.spark, {CLEANUP: "true", "spark.sql.shuffle.partitions": self.buckets, "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}
        )

    def _put(self, counts: DataFrame, level: int) -> str:
        name = f"archivelake_run_{uuid.uuid4().hex}"
        counts.write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        return name

    def compact(self) -> list[str]:
        """Merge the runs of each full level into one of the next; returns the runs that are no longer part of the index."""
        gone: list[str] = []
        for level in range(64):
            if level >= len(self.levels) or len(names := self.levels[level]) < self.fanout:
                break
            both = reduce(self._merge, map(self.spark.table, names))
            self.levels[level] = []
            self._put(both, level + 1)
            self.merged += 1
            gone += names
        return gone

    @staticmethod
    def _merge(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.join(b.withColumnRenamed("n", "m").hint("merge"), "h", "full_outer")
        return both.select("h", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

    def shared(self, name: str) -> DataFrame:
        """The fingerprints of a run that it holds twice or that an earlier run holds."""
        batch, found = self.spark.table(name), self.spark.table(name).where("n > 1").select("h")
        for other in self.names():
            if other != name:
                found = found.unionByName(batch.join(self.spark.table(other).select("h").hint("merge"), "h", "left_semi").select("h"))
        return found

    def add(self, fingerprints: DataFrame, scratch: Scratch, table: str) -> tuple[DataFrame, list[str]]:
        """Make a batch (column h) a run, merge-join it with all earlier runs, store what they share as ``table``, compact."""
        with self._settings():
            name = self._put(fingerprints.groupBy("h").agg(F.count("*").alias("n")), 0)
            shared = scratch.write(self.shared(name), table)
            return shared, self.compact()

    def drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, f"{self.path}/{name}")


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def with_keys(docs: DataFrame) -> DataFrame:
    rows = prepared(docs, "doc_id", "text")
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(LEAST)).alias("doc"), F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))


def sampled(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """Per text: number of words, digest, and the fingerprints of its windows (twice if a window is repeated in the text)."""
    def run(cols):
        texts, out, digests, n_words = cols["text"], [], [], []
        for a, b in grouped(texts):
            h, counts = hashed_words(texts[a:b])
            keys, (ok, owner) = window_keys(h, width, gram), inside(counts, width)
            whole = window_hashes(h, width)[ok] if len(ok) else np.zeros(0, np.uint64)
            keys = keys[ok] if len(ok) else np.zeros(0, np.uint64)
            ends = np.searchsorted(owner, np.arange(b - a + 1))
            for i in range(b - a):
                at = slice(ends[i], ends[i + 1])
                own = np.unique(keys[at])
                _, first = np.unique(whole[at], return_index=True)
                if len(first) < at.stop - at.start:  # repeated in this text: counts twice
                    again = np.ones(at.stop - at.start, bool)
                    again[first] = False
                    own = np.concatenate([own, np.unique(keys[at][again])])
                out.append(signed(own).tolist())
                n_words.append(int(counts[i]))
                digests.append(hashlib.sha256(b" ".join(text_or_empty(texts[a + i]).split())).hexdigest())
        return {"doc_id": cols["doc_id"], "doc": cols["doc"], "t": cols["t"], "n_words": n_words, "sha": digests, "anchors": out}

    made = map_batches(rows, run, "doc_id bigint, doc bigint, t bigint, n_words bigint, sha string, anchors array<bigint>")
    return made.withColumn("rid", F.monotonically_increasing_id())


def whole_windows(width: int, gram: int):
    """Both hashes and the first start of each distinct window that took a shared fingerprint, and the starts of its repeats in the text."""
    def run(cols):
        out = {name: cols[name] for name in ("gen", "rid", "doc")} | {"a": [], "b": [], "starts": [], "own": []}
        for text, hs in zip(cols["text"], cols["hs"], strict=True):
            h, _ = hashed_words([text])
            other, _ = hashed_words([text], key="fedcba9876543210")
            at = np.flatnonzero(np.isin(window_keys(h, width, gram), np.array(hs, np.int64).view(np.uint64)))
            a, b = window_hashes(h, width)[at], window_hashes(other, width)[at]
            order = np.lexsort((at, b, a))
            again = np.zeros(len(at), bool)
            again[order[1:]] = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
            out["a"].append(signed(a[~again]).tolist())
            out["b"].append(signed(b[~again]).tolist())
            out["starts"].append(at[~again].tolist())
            out["own"].append(at[again].tolist())
        return out

    return run


def verified(scratch: Scratch, made: DataFrame, texts: DataFrame, shared: DataFrame, width: int, gram: int, done=()) -> tuple[DataFrame, DataFrame]:
    """From rows (gen, ROWS) and texts (gen, doc, t, text) with the shared fingerprints: rows without anchors but with ``copy``,
    and the starts of repeated windows per (gen, doc, t). ``done`` are called once anchors are no longer needed."""
    key = ["gen", "doc", "t"]
    copies = made.where(F.col("n_words") >= width).groupBy("sha").agg(F.min("doc").alias("first"), F.count("*").alias("c")).where("c > 1").select("sha", "first")
    meta = made.drop("anchors").join(scratch.write(copies, "copies"), "sha", "left").withColumn("copy", F.coalesce(F.col("doc") > F.col("first"), F.lit(False))).drop("first")
    meta = scratch.write(meta, "meta")
    holds = made.select("gen", "rid", F.explode("anchors").alias("h")).join(shared, "h", "left_semi").groupBy("gen", "rid").agg(F.collect_list("h").alias("hs"))
    holds = holds.join(meta.where(~F.col("copy")).select("gen", "rid", "doc", "t", F.col("text_doc")), ["gen", "rid"]).dropDuplicates(["gen", "text_doc", "t"])
    holds = scratch.write(holds, "holds")
    for f in done:
        f()
    windows = texts.select("gen", F.col("doc").alias("text_doc"), "t", "text").join(holds, ["gen", "text_doc", "t"]).select("gen", "rid", "doc", "text", "hs")
    windows = scratch.write(map_batches(windows, whole_windows(width, gram), "gen bigint, rid bigint, doc bigint, a array<bigint>, b array<bigint>, starts array<int>, own array<int>"), "windows")
    scratch.drop("copies", "holds")
    each = windows.select("gen", "rid", "doc", F.inline(F.arrays_zip("a", "b", "starts")))
    firsts = scratch.write(each.groupBy("a", "b").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where(F.col("first") < F.col("last")).select("a", "b", "first"), "firsts")
    late = each.join(firsts, ["a", "b"]).where(F.col("doc") > F.col("first")).select("gen", "rid", F.col("starts").alias("start"))
    late = late.unionByName(windows.select("gen", "rid", F.explode("own").alias("start")))
    late = late.groupBy("gen", "rid").agg(F.collect_list("start").alias("starts")).join(meta.select("gen", "rid", F.col("text_doc").alias("doc"), "t"), ["gen", "rid"])
    late = scratch.write(late.select(*key, "starts"), "late")
    scratch.drop("windows", "firsts")
    return meta, late


def results(rows: DataFrame, meta: DataFrame, late: DataFrame, width: int) -> DataFrame:
    """Words, removed words and the digest of what is kept, per row (doc_id, doc, t, text)."""
    def cut(cols):
        out = {"doc_id": cols["doc_id"], "n_words": [], "n_removed": [], "kept_sha256": []}
        for text, starts in zip(cols["text"], cols["starts"], strict=True):
            words = text_or_empty(text).split()
            change = np.zeros(len(words) + 1, np.int64)
            at = np.unique(np.array(starts, np.int64))
            change[at] += 1
            np.subtract.at(change, at + width, 1)
            gone = np.cumsum(change)[:-1] > 0
            out["n_words"].append(len(words))
            out["n_removed"].append(int(gone.sum()))
            out["kept_sha256"].append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)).hexdigest())
        return out

    changed = map_batches(rows.join(late.select("doc", "t", "starts"), ["doc", "t"]).select("doc_id", "text", "starts"), cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
    same = meta.join(late.select(F.col("doc").alias("text_doc"), "t"), ["text_doc", "t"], "left_anti")
    same = same.select("doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.lit(0)).cast("bigint").alias("n_removed"), F.when(F.col("copy"), F.lit(EMPTY)).otherwise(F.col("sha")).alias("kept_sha256"))
    return changed.unionByName(same)


def deduplicated(docs: DataFrame, spark: SparkSession, width: int = 20, gram: int = 6, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Words, removed words and the digest of what is kept, per document."""
    scratch = Scratch(spark, "substrings", clean=True)
    rows = with_keys(docs)
    made = scratch.write(sampled(rows, width, gram), "sampled")
    points = made.select(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 1000).alias("p")).first()["p"] if batches > 1 else []
    index, shared = FingerprintIndex(spark, f"{scratch.path}/runs", fanout), None
    bounds = [None, *sorted(set(points or [])), None]
    for i in range(len(bounds) - 1):
        batch = made
        if bounds[i] is not None:
            batch = batch.where(F.col("doc") > bounds[i])
        if bounds[i + 1] is not None:
            batch = batch.where(F.col("doc") <= bounds[i + 1])
        found, gone = index.add(batch.select(F.explode("anchors").alias("h")), scratch, f"shared-{i}")
        index.drop(gone)
        shared = found if shared is None else shared.unionByName(found)
    shared = scratch.write(shared.distinct(), "shared")
    index.drop(index.names())
    scratch.drop(*(f"shared-{i}" for i in range(len(bounds) - 1)))
    one = lambda df: df.withColumn("gen", F.lit(0).cast("bigint"))
    meta, late = verified(scratch, one(made).withColumn("text_doc", F.col("doc")), one(rows), shared, width, gram, [lambda: scratch.drop("sampled", "shared")])
    return results(rows, meta, late, width)


class SubstringIndex:
    """A stored index to which batches are added one after the other: its runs, and rows and texts of each batch.

    A batch counts once its manifest is written; what an interrupted call leaves behind is never read.
    """

    def __init__(self, spark: SparkSession, path: str, width: int = 20, gram: int = 6, fanout: int = 2):
        self.spark, self.path = spark, path.rstrip("/")
        state = self._manifest() or {"width": width, "gram": gram, "fanout": fanout, "buckets": int(spark.conf.get("spark.sql.shuffle.partitions")), "levels": [], "batches": []}
        self.width, self.gram, self.batches = state["width"], state["gram"], state["batches"]
        self.index = FingerprintIndex(spark, f"{self.path}/runs", state["fanout"], state["buckets"], state["levels"])

    def _fs(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self) -> dict | None:
        at, fs = self._fs()
        names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{names[-1]}", wholetext=True).first()[0]) if names else None

    def _commit(self) -> None:
        """The next manifest, by exclusive creation: of two writers one fails."""
        at, fs = self._fs()
        state = {"width": self.width, "gram": self.gram, "fanout": self.index.fanout, "buckets": self.index.buckets, "levels": self.index.levels, "batches": self.batches}
        out = fs.create(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, f"{len(self.batches):012d}.json"), False)
        out.writeBytes(json.dumps(state))
        out.close()

    def add(self, docs: DataFrame) -> DataFrame:
        """The results of a new batch, which becomes part of the index."""
        spark, name, gen = self.spark, uuid.uuid4().hex, len(self.batches)
        scratch = Scratch(spark, "substring-batch", clean=True)
        with_keys(docs).write.parquet(f"{self.path}/texts/{name}")
        rows = spark.read.parquet(f"{self.path}/texts/{name}")
        sampled(rows, self.width, self.gram).write.parquet(f"{self.path}/rows/{name}")
        batch = spark.read.schema(ROWS).parquet(f"{self.path}/rows/{name}")
        shared, gone = self.index.add(batch.select(F.explode("anchors").alias("h")), scratch, "shared-0")
        shared = scratch.write(shared.distinct(), "shared")
        all_of = lambda kind: reduce(
            DataFrame.unionByName, (spark.read.parquet(f"{self.path}/{kind}/{b}").withColumn("gen", F.lit(g).cast("bigint")) for g, b in enumerate([*self.batches, name]))
        )
        made, texts = all_of("rows"), all_of("texts")
        # of earlier batches only rows that share a fingerprint or a digest with this one matter
        made = made.withColumn("text_doc", F.col("doc")).withColumn("doc", F.when(F.col("gen") < gen, F.lit(EARLIER)).otherwise(F.col("doc")))
        meta, late = verified(scratch, made, texts, shared, self.width, self.gram)
        self.batches = [*self.batches, name]
        self._commit()
        self.index.drop(gone)
        return results(rows, meta.where(F.col("gen") == gen), late.where(F.col("gen") == gen), self.width)

"""Token-ID output: raw little-endian id payloads with a minimal perfect hash index from document keys to offsets.

Documents are range-partitioned and sorted by key, then by text, so that the rows of one hot key spread over tasks; each task cuts its
ids into shards of about ``shard_ids`` ids. A shard row holds the raw payload, its key range, and its index:
displacement seeds of a minimal perfect hash over its keys and, at each slot, a 32-bit fingerprint of the
key and the number of its first row; ``row_starts`` gives the id offset of each row. A lookup finds the part and its shard by
key range, hashes once, compares the fingerprint and slices the payload. Spark's committed
writer stores the rows, so retried tasks and lost executors leave no partial shard.

Defined cases: a null text counts as empty and has just the end id; a null key sorts first; rows with equal keys
follow one another, in each task ordered by text (null as empty), and are found together; an empty table gives no shard; only the key
and text columns are read.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_batches, mapped, prepared, text_groups
from .tokens import GROUP_CHARS, loaded

#: Keys per displacement bucket.
PER_BUCKET = 4
SHARD_SCHEMA = (
    "part int, seq int, min_key bigint, max_key bigint, has_null boolean, n_rows int, n_ids bigint, first bigint, width int,"
    " payload binary, keys array<bigint>, row_starts binary, seeds binary, fingerprints binary, slots binary"
)



def spread(key: int | None, seed: int) -> int:
    """A 64-bit hash by multiplication, good for any seed."""
    x = (0x51ED270B if key is None else key & 0xFFFFFFFFFFFFFFFF) ^ (seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return x ^ x >> 31 ^ (0x2545F4914F6CDD1D if key is None else 0)


def spread_all(keys: np.ndarray, seeds: np.ndarray | int) -> np.ndarray:
    """``spread`` of many known keys, each with its seed."""
    u = np.uint64
    x = keys.astype(np.int64, copy=False).view(u) ^ (np.asarray(seeds).astype(u) * u(0x9E3779B97F4A7C15))
    x = (x ^ x >> u(30)) * u(0xBF58476D1CE4E5B9)
    x = (x ^ x >> u(27)) * u(0x94D049BB133111EB)
    return x ^ x >> u(31)


def fingerprint(key: int | None) -> int:
    return spread(key, 0xF1) >> 32


def perfect_hash(keys: list[int | None]) -> tuple[list[int], list[int]]:
    """Seeds per bucket and the slot of each key: every distinct key gets its own slot in 0..n-1."""
    n = len(keys)
    buckets: list[list[int]] = [[] for _ in range(max(1, -(-n // PER_BUCKET)))]
    for i, key in enumerate(keys):
        buckets[spread(key, 0) % len(buckets)].append(i)
    seeds, slots, taken = [0] * len(buckets), [0] * n, bytearray(n)
    for b in sorted(range(len(buckets)), key=lambda b: -len(buckets[b])):
        seed = 1
        while buckets[b]:
            found = [spread(keys[i], seed) % n for i in buckets[b]]
            if len(set(found)) == len(found) and not any(taken[s] for s in found):
                for i, s in zip(buckets[b], found, strict=True):
                    slots[i], taken[s] = s, 1
                seeds[b] = seed
                break
            seed += 1
    return seeds, slots


@dataclass
class Shard:
    """One stored shard, read back."""

    row: dict

    def __post_init__(self):
        self.ids = np.frombuffer(self.row["payload"], dtype="<u2" if self.row["width"] == 2 else "<u4")
        self.starts = np.frombuffer(self.row["row_starts"], dtype="<i8")
        self.seeds = np.frombuffer(self.row["seeds"], dtype="<u4")
        self.fingerprints = np.frombuffer(self.row["fingerprints"], dtype="<u4")
        self.slots = np.frombuffer(self.row["slots"], dtype="<u4").reshape(-1, 2)

    def rows_of(self, key: int | None) -> range:
        """Numbers of the rows with this key, found by one hash; empty if the fingerprint differs."""
        n = len(self.fingerprints)
        seed = int(self.seeds[spread(key, 0) % len(self.seeds)]) if n else 0
        if not seed:
            return range(0)
        slot = spread(key, seed) % n
        if self.fingerprints[slot] != fingerprint(key):
            return range(0)
        first, count = map(int, self.slots[slot])
        return range(first, first + count)

    def rows_of_sorted(self, keys: list[int | None]) -> np.ndarray:
        """The row of each of the shard's keys, nulls first and repeats one after the other, found through the index."""
        nulls = keys.count(None)
        known = np.array(keys[nulls:], np.int64)
        n, u = len(self.fingerprints), np.uint64
        seeds = self.seeds[spread_all(known, np.zeros(1)) % u(len(self.seeds))]
        slot = spread_all(known, seeds) % u(n)
        if (self.fingerprints[slot] != spread_all(known, np.array([0xF1])) >> u(32)).any():
            raise ValueError("a key of the shard isn't in its index")
        repeat = np.arange(len(known)) - np.searchsorted(known, known)
        return np.concatenate([np.array(self.rows_of(None) if nulls else [], np.int64), self.slots[slot, 0] + repeat])

    def ids_of(self, row: int) -> np.ndarray:
        return self.ids[self.starts[row] : self.starts[row + 1]].astype("<u4")


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, shard_ids: int = 1_000_000) -> DataFrame:
    """Rows of SHARD_SCHEMA, to be stored by the caller."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(SHARD_SCHEMA))

    def shard(part: int, seq: int, first: int, width: int, keys: list, lens: np.ndarray, payload: bytes) -> pa.RecordBatch:
        starts = np.concatenate([[0], np.cumsum(lens)]).astype("<i8")
        distinct = list(dict.fromkeys(keys))
        firsts = {k: i for i, k in reversed(list(enumerate(keys)))}
        counts: dict = {}
        for k in keys:
            counts[k] = counts.get(k, 0) + 1
        seeds, slots = perfect_hash(distinct)
        prints, places = np.zeros(len(distinct), "<u4"), np.zeros((len(distinct), 2), "<u4")
        for key, slot in zip(distinct, slots, strict=True):
            prints[slot], places[slot] = fingerprint(key), (firsts[key], counts[key])
        known = [k for k in keys if k is not None]
        row = {
            "part": part, "seq": seq, "min_key": known[0] if known else None, "max_key": known[-1] if known else None, "has_null": len(known) < len(keys),
            "n_rows": len(keys), "n_ids": int(starts[-1]), "first": first, "width": width, "payload": payload, "keys": keys,
            "row_starts": starts.tobytes(), "seeds": np.array(seeds, "<u4").tobytes(), "fingerprints": prints.tobytes(), "slots": places.tobytes(),
        }
        return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in arrow], schema=arrow)

    def run(batches):
        own = loaded(tokenizer)
        kind, width = ("<u2", 2) if max(own.size, end_id + 1) <= 65536 else ("<u4", 4)
        part, seq, first, size = TaskContext.get().partitionId(), 0, 0, 0
        keys, lens, chunks = [], [], []
        for own_keys, texts in text_groups(batches, GROUP_CHARS):
            ids, counts = own.flat(texts)
            stop = np.cumsum(counts + 1)
            closed = np.full(int(stop[-1]), end_id, kind)  # an end id after each document
            inner = np.ones(len(closed), bool)
            inner[stop - 1] = False
            closed[inner] = ids
            row = begin = 0
            while row < len(texts):
                upto = min(len(texts), int(np.searchsorted(stop, begin + shard_ids - size)) + 1)
                keys += own_keys[row:upto]
                lens.append(counts[row:upto] + 1)
                chunks.append(closed[begin : stop[upto - 1]].tobytes())
                size, row, begin = size + int(stop[upto - 1]) - begin, upto, int(stop[upto - 1])
                if size >= shard_ids:
                    yield shard(part, seq, first, width, keys, np.concatenate(lens), b"".join(chunks))
                    seq, first, size, keys, lens, chunks = seq + 1, first + size, 0, [], [], []
        if keys:
            yield shard(part, seq, first, width, keys, np.concatenate(lens), b"".join(chunks))

    # equal keys may be so many that they must lie in several tasks; rows that are equal throughout are alike, so any order of them will do
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 16), F.col("text")]
    return mapped(rows.repartitionByRange(order[0], order[1], F.monotonically_increasing_id()).sortWithinPartitions(order[0], order[2]), run, SHARD_SCHEMA)


class TokenStore:
    """Stored shards, a folder per part; ``starts`` and key ranges of parts are known once all are written (one row per task reaches the driver)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
        sums = [F.sum("n_ids").alias("n"), F.min("min_key").alias("low"), F.max("max_key").alias("high"), F.max("has_null").alias("has_null")]
        self.bases, self.ranges, at = {}, {}, 0
        for r in sorted(self.shards.groupBy("part").agg(*sums).collect(), key=lambda r: r["part"]):
            self.bases[r["part"]], at = at, at + r["n"]
            self.ranges[r["part"]] = (r["low"], r["high"], r["has_null"])

    @classmethod
    def create(cls, docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, shard_ids: int = 1_000_000) -> "TokenStore":
        write_shards(prepared(docs, "doc_id", "text"), tokenizer, end_id, shard_ids).write.mode("overwrite").partitionBy("part").parquet(path)
        return cls(docs.sparkSession, path)

    def lookup(self, key: int | None) -> list[np.ndarray]:
        """The ids of each row with this key. Part ranges, known since the store was opened, name the folder (more than one only for a key
        that spans parts); of its shards only those that may hold the key are read, and one hash finds the row."""
        parts = [p for p, (low, high, null) in self.ranges.items() if (null if key is None else low is not None and low <= key <= high)]
        if not parts:
            return []
        hit = F.col("has_null") if key is None else (F.col("min_key") <= key) & (F.col("max_key") >= key)
        rows = self.shards.where(F.col("part").isin(parts) & hit).select("part", "seq", "payload", "width", "row_starts", "seeds", "fingerprints", "slots").collect()
        return [s.ids_of(i) for s in (Shard(r.asDict()) for r in sorted(rows, key=lambda r: (r["part"], r["seq"]))) for i in s.rows_of(key)]

    def documents(self) -> DataFrame:
        """Start, length and checksum of every row's ids, read from the payloads through the index."""
        bases = self.bases

        def run(cols):
            out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
            for i in range(len(cols["part"])):
                s = Shard({k: v[i] for k, v in cols.items()})
                rows = s.rows_of_sorted(s.row["keys"])
                begin, stop = s.starts[rows], s.starts[rows + 1]
                raw = memoryview(s.ids.astype("<u4").view(np.uint8))
                out["doc_id"] += s.row["keys"]
                out["start"] += (bases[s.row["part"]] + s.row["first"] + begin).tolist()
                out["n_tokens"] += (stop - begin).tolist()
                out["ids_crc32"] += [zlib.crc32(raw[4 * b : 4 * e]) for b, e in zip(begin.tolist(), stop.tolist(), strict=True)]
            return out

        used = self.shards.select("part", "first", "width", "payload", "keys", "row_starts", "seeds", "fingerprints", "slots")
        return map_batches(used, run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def encoded(docs: DataFrame, spark: SparkSession, **options) -> DataFrame:
    return TokenStore.create(docs, f"{Scratch(spark, 'token-files').path}/shards", **options).documents()

"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by their number of distinct five-word shingles. The sketch of an item is its
bottom-k MinHash values, where k follows from the largest size of its partition: an item of n
shingles of which a document holds at least 0.8 n misses at most 0.2 n, so one of any
floor(0.2 n) + 1 of them is in the document. Taking k at least that large makes the candidate search
complete, however long the document is. Candidates are verified by exact containment of whole shingle sets; a shingle is its 64-bit
hash, so two different ones are taken for one with a chance of 2^-64.

Items are taken in blocks of at most ``block_words`` words or one item, rows that repeat an item once with their number; a block's sketches
and shingles are the only data sent to all tasks, so what is sent has a fixed bound however large the benchmark is.

Defined cases: words are compared with A-Z lower-cased; an item of fewer than five words is one shingle of all its words; null or
empty items and documents match nothing; repeated rows give repeated matches; an empty table on either side gives no match;
other columns are never read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, bounded_batches, grouped, hashed_words, inside, joined, map_batches, mapped, prepared, window_hashes

WIDTH = 5
#: Upper ends of the size partitions grow by this factor.
STEP = 1.25
#: Repeated matches are made from rows that stand for at most so many.
COPIES = 10_000


def sized(h: np.ndarray, width: int) -> np.ndarray:
    return joined(h, np.full(len(h), width, np.uint64))


class Sketches:
    """Sorted sketch values of a block of items, with the item of each, and all their shingles."""

    def __init__(self, items: list[tuple[int, str, int]], threshold: float):
        self.threshold = threshold
        self.ids: list[int] = []
        self.rows: list[int] = []
        self.shingles: list[np.ndarray] = []
        widths = set()
        for item_id, text, rows in items:
            h, _ = hashed_words([text], lower=True)
            if not len(h):
                continue
            width = min(WIDTH, len(h))
            widths.add(width)
            self.ids.append(item_id)
            self.rows.append(rows)
            self.shingles.append(np.unique(sized(window_hashes(h, width), width)))
        self.widths = sorted(widths)
        values, owners = [], []
        for i, s in enumerate(self.shingles):
            upper = int(np.ceil(STEP ** np.ceil(np.log(len(s)) / np.log(STEP))))
            k = min(len(s), int((1 - threshold) * max(upper, len(s)) + 1e-9) + 1)
            values.append(s[:k])  # sorted, so these are the smallest
            owners.append(np.full(k, i))
        flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.values, self.owners = flat[order], (np.concatenate(owners) if owners else np.zeros(0, int))[order]

    def matches(self, texts: list) -> list[tuple[int, int, int, int]]:
        """(text number, item number, shingles found, shingles of the item) of each verified match."""
        found = []
        if not len(self.values):
            return found
        for a, b in grouped(texts):
            h, counts = hashed_words(texts[a:b], lower=True)
            values, owners = [], []
            for width in self.widths:
                ok, owner = inside(counts, width)
                values.append(sized(window_hashes(h, width), width)[ok] if len(ok) else np.zeros(0, np.uint64))
                owners.append(owner)
            values, owners = np.concatenate(values), np.concatenate(owners)
            left = np.searchsorted(self.values, values, "left")
            hit = np.flatnonzero(self.values[np.minimum(left, len(self.values) - 1)] == values)
            if not len(hit):
                continue
            right = np.searchsorted(self.values, values[hit], "right")
            pairs = {(int(d), int(i)) for d, lo, hi in zip(owners[hit], left[hit], right, strict=True) for i in self.owners[lo:hi]}
            sets: dict[int, np.ndarray] = {}
            for d, i in sorted(pairs):
                if d not in sets:
                    sets[d] = np.unique(values[owners == d])
                own = self.shingles[i]
                n = int(np.isin(own, sets[d], assume_unique=True).sum())
                if n >= self.threshold * len(own) - 1e-9:
                    found.append((a + d, i, n, len(own)))
        return found


def item_blocks(items: DataFrame, block_words: int):
    """Blocks of (item_id, text, number of rows), each of at most ``block_words`` words or one item; the first may be empty."""
    rows = prepared(items, "item_id", "text").where("text is not null").groupBy("item_id", "text").agg(F.count("*").alias("n"))
    rows = rows.withColumn("w", F.regexp_count("text", F.lit(WORD)))
    total = rows.agg(F.sum("w")).first()[0] or 0
    parts = max(1, -(-2 * total // block_words))
    for p in range(parts):
        block, words = [], 0
        for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect():
            if block and words + r["w"] > block_words:
                yield block
                block, words = [], 0
            block.append((r["item_id"], r["text"], r["n"]))
            words += r["w"]
        if block or not p:
            yield block


def search(docs: DataFrame, items: DataFrame, spark: SparkSession, threshold: float = 0.8, block_words: int = 2_000_000) -> DataFrame:
    """One row per (item, document) whose containment reaches the threshold."""
    found = []
    for block in item_blocks(items, block_words):
        sent = spark.sparkContext.broadcast(Sketches(block, threshold))

        def run(cols, sent=sent):
            s, out = sent.value, {"item_id": [], "doc_id": [], "n_found": [], "n_shingles": [], "containment": [], "copies": []}
            for d, i, n, of in s.matches(cols["text"]):
                for a in range(0, s.rows[i], COPIES):
                    for name, v in zip(out, (s.ids[i], cols["doc_id"][d], n, of, n / of, min(COPIES, s.rows[i] - a)), strict=True):
                        out[name].append(v)
            return out

        found.append(map_batches(prepared(docs, "doc_id", "text"), run, "item_id bigint, doc_id bigint, n_found bigint, n_shingles bigint, containment double, copies int"))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")


def clean(docs: DataFrame, items: DataFrame, spark: SparkSession, threshold: float = 0.8, block_words: int = 2_000_000) -> DataFrame:
    """The documents, with all their columns, in which no item is found."""
    bounded_batches(spark)
    for block in item_blocks(items, block_words):
        sent = spark.sparkContext.broadcast(Sketches(block, threshold))

        def run(batches, sent=sent):
            import pyarrow as pa

            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                keep = np.ones(len(texts), bool)
                keep[[d for d, *_ in sent.value.matches(texts)]] = False
                yield batch.filter(pa.array(keep))

        docs = mapped(docs, run, docs.schema)
    return docs

"""Ranked lexical search over dual-sorted postings in wavelet trees, one per shard of documents.

Build: tasks cut their documents in shards (no exchange). In a shard documents are numbered by doc_id, and the postings of all terms
are put in one sequence of document numbers, by term and then by descending impact. A wavelet tree over the
numbers keeps that order in every node: a term's postings inside a range of documents are an interval of the node, best first. So one sequence is
sorted both ways, by impact at the root and by doc_id towards the leaves. Shards are rows of a Parquet table, with the bits of the tree's levels packed.

Search: items go to all shards in blocks of bounded size. For an item, a node of the tree holds one interval per term; the sum of weight times impact of
the intervals' first postings bounds every document below the node, and at a leaf it is the document's score. Nodes are taken by descending bound, a
few at a time; those that can't beat the k best so far are left out, where a task's later shards begin with the bound of the earlier ones. Equal scores go
to the smaller doc_id, so of nodes with a bound equal to the last of the k best only those with smaller ids are entered.

Scores are exact 64-bit integers over statistics of all documents.

Defined cases: null and empty texts have no terms, count nowhere and are never found; an item without terms, or whose terms no
document holds, has no rows; items repeated exactly repeat their rows; documents that share a doc_id rank one by one; a document without doc_id comes
last among equals and is given as null; an empty table on either side gives no rows; other columns are never read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, bounded_batches, grouped, mapped, prepared, text_or_empty

#: Bytes of a term stay, A-Z in lower case; all others become blanks.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: A shard is closed at so many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 4096, 1_000_000
#: Impacts lie below 2^20, document numbers of a shard below 2^12.
IMPACT_BITS, DOC_BITS = 20, 12
#: Nodes taken at a time, and intervals of nodes that wait before deeper nodes go first.
FEW, MANY, WAITING = 8, 64, 4_000_000
SHARD = "ids binary, named binary, terms binary, counts binary, bits binary, impacts binary"


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of letters, digits and everything beyond ASCII."""
    return text_or_empty(text).translate(TERM_BYTES).split()


def counted(docs: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and all their terms with repeats."""
    def run(batches):
        n = total = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = len(terms(text))
                n, total = n + (own > 0), total + own
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "total": pa.array([total], pa.int64())})

    bounded_batches(docs.sparkSession)
    row = mapped(prepared(docs, "text"), run, "n bigint, total bigint").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


class Shard:
    """Documents on their way into a tree."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.lens: list[int] = []
        self.postings: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, ids: list, texts: list) -> None:
        words: list[bytes] = []
        lens = []
        for i, text in zip(ids, texts, strict=True):
            if own := terms(text):
                words += own
                lens.append(len(own))
                self.ids.append(i)
        if not words:
            return
        coded = pa.array(words, pa.large_binary()).dictionary_encode()
        known = np.array([self.numbers.setdefault(w, len(self.numbers)) for w in coded.dictionary.to_pylist()], np.int64)
        docs = np.repeat(np.arange(len(self.lens), len(self.lens) + len(lens)), lens)
        keys, tf = np.unique(known[coded.indices.to_numpy()] << DOC_BITS | docs, return_counts=True)
        self.lens += lens
        self.postings.append((keys, tf))
        self.size += len(keys)

    def row(self, n_docs: int, n_terms: int) -> dict[str, bytes]:
        """The dual-sorted sequence as a tree, as a row of SHARD."""
        named = np.array([i is not None for i in self.ids])
        ids = np.array([i or 0 for i in self.ids], np.int64)
        order = np.lexsort((ids, ~named))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        m = np.array([75 + 25 * n * n_docs // n_terms for n in self.lens], np.int64)
        keys, tf = (np.concatenate(x) for x in zip(*self.postings, strict=True))
        tf = tf.astype(np.int64)
        doc = keys & (1 << DOC_BITS) - 1
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
        top = (1 << IMPACT_BITS) - 1
        packed = np.sort(((keys >> DOC_BITS) << IMPACT_BITS | top - impact) << DOC_BITS | number[doc])
        seq = packed & (1 << DOC_BITS) - 1
        impacts = (top - (packed >> DOC_BITS & top)).astype(np.int32)
        counts = np.bincount(packed >> DOC_BITS + IMPACT_BITS, minlength=len(self.numbers)).astype(np.int64)
        bits = []
        for level in reversed(range(height(len(ids)))):
            ones = (seq >> level & 1).astype(bool)
            bits.append(np.packbits(ones).tobytes())
            seq = np.concatenate([seq[~ones], seq[ones]])
        return {"ids": ids[order].tobytes(), "named": named[order].tobytes(), "terms": b" ".join(self.numbers), "counts": counts.tobytes(), "bits": b"".join(bits), "impacts": impacts.tobytes()}


def height(n_docs: int) -> int:
    return max(1, (n_docs - 1).bit_length())


def shards(docs: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """Rows of SHARD of all documents that have a term."""
    names = [x.split()[0] for x in SHARD.split(", ")]

    def closed(shard: Shard) -> pa.RecordBatch:
        row = shard.row(n_docs, n_terms)
        return pa.RecordBatch.from_arrays([pa.array([row[c]], pa.binary()) for c in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]):
        shard = Shard()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in grouped(texts):
                while a < b:
                    z = min(b, a + SHARD_DOCS - len(shard.ids))
                    shard.add(ids[a:z], texts[a:z])
                    a = z
                    if len(shard.ids) >= SHARD_DOCS or shard.size >= SHARD_POSTINGS:
                        yield closed(shard)
                        shard = Shard()
        if shard.ids:
            yield closed(shard)

    bounded_batches(docs.sparkSession)
    return mapped(prepared(docs, "doc_id", "text"), run, SHARD)


class Tree:
    """A shard as it is searched: per level the ones before each place, and the impacts in the order of each level."""

    def __init__(self, row: dict):
        self.ids, self.named = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["named"], bool)
        self.terms = row["terms"]
        self.offsets = np.concatenate([[0], np.cumsum(np.frombuffer(row["counts"], np.int64))])
        impacts = np.frombuffer(row["impacts"], np.int32)
        self.n, self.height = len(impacts), height(len(self.ids))
        packed = np.frombuffer(row["bits"], np.uint8).reshape(self.height, -1)
        ranks, kept = np.zeros((self.height, self.n + 1), np.int32), [impacts]
        for level in range(self.height):
            ones = np.unpackbits(packed[level], count=self.n).astype(bool)
            np.cumsum(ones, out=ranks[level, 1:])
            kept.append(np.concatenate([kept[-1][~ones], kept[-1][ones]]))
        self.zeros = self.n - ranks[:, -1].astype(np.int64)
        self.ranks, self.impacts = ranks.ravel(), np.concatenate(kept)

    def search(self, codes: np.ndarray, weights: np.ndarray, best: "Best") -> None:
        """Bring into ``best`` what beats it; ``codes`` are the item's distinct terms that the shard holds."""
        left, right = self.offsets[codes][None, :], self.offsets[codes + 1][None, :]
        bound = self.impacts[left].astype(np.int64) @ weights
        level, node = np.zeros(1, np.int64), np.zeros(1, np.int64)
        few = FEW
        while True:
            live = best.beaten_by(bound, self, node << self.height - level)
            if not live.all():
                left, right, bound, level, node = left[live], right[live], bound[live], level[live], node[live]
            if not len(bound):
                return
            key = level if left.size > WAITING else bound
            take = np.argpartition(-key, few)[:few] if len(bound) > few else np.arange(len(bound))
            few = MANY
            rest = np.ones(len(bound), bool)
            rest[take] = False
            at, own, l, r = level[take], node[take], left[take], right[take]
            base = (at * (self.n + 1))[:, None]
            ones_l, ones_r, zeros = self.ranks[base + l].astype(np.int64), self.ranks[base + r].astype(np.int64), self.zeros[at][:, None]
            l, r = np.concatenate([l - ones_l, zeros + ones_l]), np.concatenate([r - ones_r, zeros + ones_r])
            at, own = np.concatenate([at, at]) + 1, np.concatenate([own * 2, own * 2 + 1])
            full = r > l
            first = np.where(full, self.impacts[np.minimum(at[:, None] * self.n + l, len(self.impacts) - 1)], 0)
            sums = first.astype(np.int64) @ weights
            leaf = at == self.height
            if leaf.any():
                best.add(sums[leaf], self.ids[(own[leaf]).clip(max=len(self.ids) - 1)], self.named[(own[leaf]).clip(max=len(self.ids) - 1)])
            deeper = ~leaf & (sums > 0)
            left, right = np.concatenate([left[rest], l[deeper]]), np.concatenate([right[rest], r[deeper]])
            bound, level, node = np.concatenate([bound[rest], sums[deeper]]), np.concatenate([level[rest], at[deeper]]), np.concatenate([node[rest], own[deeper]])


class Best:
    """The k best of an item so far; ``entered`` counts leaves that were scored."""

    def __init__(self, k: int):
        self.k, self.entered = k, 0
        self.scores, self.ids, self.named = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def beaten_by(self, bound: np.ndarray, tree: Tree, first: np.ndarray) -> np.ndarray:
        """Which nodes, with their first document, may hold something better."""
        if len(self.scores) < self.k:
            return bound > 0
        floor, last, named = self.scores[-1], self.ids[-1], self.named[-1]
        at = first.clip(max=len(tree.ids) - 1)
        before = tree.named[at] & (tree.ids[at] < last) if named else tree.named[at]
        return (bound > floor) | (bound == floor) & before

    def add(self, scores: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        good = scores > (0 if len(self.scores) < self.k else self.scores[-1] - 1)
        self.entered += len(scores)
        if good.any():
            scores, ids, named = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]]), np.concatenate([self.named, named[good]])
            order = np.lexsort((ids, ~named, -scores))[: self.k]
            self.scores, self.ids, self.named = scores[order], ids[order], named[order]


class Index:
    """A stored index over documents; ``n_docs`` and ``n_terms`` are the statistics its impacts were made with."""

    def __init__(self, spark: SparkSession, table: DataFrame, n_docs: int, n_terms: int):
        self.spark, self.table, self.n_docs, self.n_terms = spark, table, n_docs, n_terms

    @staticmethod
    def build(docs: DataFrame, spark: SparkSession, path: str) -> "Index":
        """Index every document and store the shards, and the statistics beside them, under a path that all executors share."""
        n_docs, n_terms = counted(docs)
        shards(docs, n_docs, n_terms).write.parquet(f"{path}/shards")
        spark.createDataFrame([(n_docs, n_terms)], "n_docs bigint, n_terms bigint").coalesce(1).write.parquet(f"{path}/statistics")
        return Index.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> "Index":
        bounded_batches(spark)
        stats = spark.read.schema("n_docs bigint, n_terms bigint").parquet(f"{path}/statistics").first()
        return Index(spark, spark.read.schema(SHARD).parquet(f"{path}/shards"), stats["n_docs"], stats["n_terms"])

    def frequencies(self, wanted: list[bytes]) -> np.ndarray:
        """In how many documents each of the terms is."""
        sent = self.spark.sparkContext.broadcast(wanted)

        def run(batches):
            asked, total = pa.array(sent.value, pa.large_binary()), np.zeros(len(sent.value), np.int64)
            for batch in batches:
                for own, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    at = places(asked, own)
                    total[at >= 0] += np.frombuffer(counts, np.int64)[at[at >= 0]]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["term", "df"])

        found = np.zeros(len(wanted), np.int64)
        for r in mapped(self.table.select("terms", "counts"), run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
            found[r["term"]] = r["df"]
        sent.unpersist()
        return found

    def weights(self, wanted: list[bytes]) -> dict[bytes, int]:
        return {t: math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * int(df) + 1))) for t, df in zip(wanted, self.frequencies(wanted), strict=True)} if wanted and self.n_docs else {}

    def _block(self, asked: list[tuple[int, str]], k: int, counter) -> DataFrame:
        """(q, doc_id, score): of each task the k best documents of each text."""
        words = [(q, Counter(terms(t))) for q, t in asked]
        wanted = sorted({t for _, own in words for t in own})
        weight = self.weights(wanted)
        place = {t: i for i, t in enumerate(wanted)}
        items = [(q, np.array([place[t] for t in own], np.int64), np.array([n * weight.get(t, 0) for t, n in own.items()], np.int64)) for q, own in words if own]
        sent = self.spark.sparkContext.broadcast((wanted, items))

        def run(batches):
            wanted, items = sent.value
            asked, best = pa.array(wanted, pa.large_binary()), [Best(k) for _ in items]
            for batch in batches:
                for i in range(batch.num_rows):
                    tree = Tree({c: batch.column(c)[i].as_py() for c in batch.schema.names})
                    codes = places(asked, tree.terms)
                    for (_, own, weights), top in zip(items, best, strict=True):
                        at = codes[own]
                        held = (at >= 0) & (weights > 0)
                        if held.any():
                            tree.search(at[held], weights[held], top)
            if counter is not None:
                counter.add(sum(b.entered for b in best))
            for (q, *_), top in zip(items, best, strict=True):
                if len(top.scores):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top.scores), q)), pa.array(top.ids, pa.int64(), mask=~top.named), pa.array(top.scores)], names=["q", "doc_id", "score"])

        return mapped(self.table, run, "q bigint, doc_id bigint, score bigint")

    def search(self, items: DataFrame, k: int = 20, block_words: int = 200_000, counter=None) -> DataFrame:
        """item_id, rank, doc_id, score of each item's k best documents. Equal texts are searched once, in blocks of about ``block_words`` words;
        ``counter``, an accumulator of a number, gets the documents scored."""
        scratch = Scratch(self.spark, "lexical-items")
        rows = prepared(items, "item_id", "text").where("text is not null")
        texts = rows.select("text").distinct().withColumn("size", F.length("text"))
        texts = scratch.write(texts.withColumn("q", F.monotonically_increasing_id()), "texts")
        total = texts.agg(F.sum("size")).first()[0] or 0
        parts = max(1, -(-total // (4 * block_words)))
        found = None
        for p in range(parts):
            asked = [(r["q"], r["text"]) for r in texts.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == p).collect()]
            own = self._block(asked, k, counter)
            found = own if found is None else found.unionByName(own)
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        named = rows.join(texts.select("text", "q"), "text").select("item_id", "q")
        return named.join(best, "q").select("item_id", "rank", "doc_id", "score")


def places(asked: pa.Array, own: bytes) -> np.ndarray:
    """The number of each asked term among a shard's terms, -1 where it has none."""
    return pc.fill_null(pc.index_in(asked, value_set=pa.array(own.split(b" "), pa.large_binary())), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def search(docs: DataFrame, items: DataFrame, spark: SparkSession, k: int = 20, **options) -> DataFrame:
    """Index the documents in the shared folder and search them."""
    return Index.build(docs, spark, f"{Scratch(spark, 'lexical').path}").search(items, k, **options)

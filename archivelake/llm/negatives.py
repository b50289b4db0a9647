"""Hard-negative mining over a vector-approximation file.

Each component x becomes floor(256 x). Each dimension is quantised into cells whose borders lie where a normal distribution of the dimension's mean
and deviation, counted over all vectors, has equal shares; its smallest and largest value close the outer cells. The file holds
a byte per component, and beside it the exact integers in the smallest type that holds them. Chunks of one label lie in rows of a stored table.

Anchors are stored in blocks. A task takes a block with a share of the chunks. For a chunk it looks up each component's cell in the tables of cell ends;
with the anchors' components they give a lower and an upper bound of every score. Only pairs that may enter are scored exactly:

1. Positives: the upper bound reaches the anchor's floor, which is the k-th best score so far or the k-th largest lower bound of the chunk.
2. Negatives: each positive score p opens the window of scores s with low * p <= 100 s <= high * p; the bounds overlap the window,
   above its k-th best score so far.

The best of all shares are the result. Every pair of an anchor and a vector is bounded once a step, in blocks: that is the stated work. Vectors are
shuffled once for ``block`` anchors and step, each with a byte a component and its exact integers.

Defined cases: rows with a null label, a null or empty vector, or a null or non-finite component take no part; vectors of different length don't meet; a
candidate with the anchor's vec_id counts as the anchor's own row; anchors repeated exactly are mined once; other repeated rows each take a place, as
positive and as negative; ties go to the smaller vec_id (null last); fewer candidates give fewer rows, an anchor without a positive none; a negative positive score
has an empty window; an empty table gives no row; lengths whose product passes 2^62 raise an error; only vec_id, embedding and label are read.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, mapped, prepared

SCALE = 256
FILE = "dim int, label int, ids binary, named binary, codes binary, ints binary"


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label, integer components and their number, without rows that take no part."""
    v = F.col("embedding")
    rows = prepared(vectors, "vec_id", "label", "embedding").where(F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return rows.where(fine).select("vec_id", "label", F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("bigint")).alias("v"), F.size(v).alias("dim"))


class Cells:
    """The cells of one number of dimensions: per dimension the first and last integer of each cell."""

    def __init__(self, n: int, sums: np.ndarray, squares: np.ndarray, least: np.ndarray, most: np.ndarray, bits: int):
        share = NormalDist()
        z = np.array([share.inv_cdf(i / (1 << bits)) for i in range(1, 1 << bits)])
        mean = sums / n
        deviation = np.sqrt(np.maximum(squares / n - mean**2, 0))
        inner = np.clip(np.rint(mean[:, None] + deviation[:, None] * z), least[:, None], most[:, None]).astype(np.int64)
        self.inner = inner
        self.first = np.concatenate([least[:, None], inner], axis=1)
        self.last = np.concatenate([inner - 1, most[:, None]], axis=1)
        self.last = np.maximum(self.last, self.first)  # cells without an integer aren't used
        biggest = int(max(-least.min(), most.max()))
        self.kind = next(t for t in (np.int16, np.int32, np.int64) if biggest <= np.iinfo(t).max)

    def codes(self, ints: np.ndarray) -> np.ndarray:
        out = np.empty(ints.shape, np.uint8)
        for d in range(ints.shape[1]):
            out[:, d] = np.searchsorted(self.inner[d], ints[:, d], "right")
        return out

    def ends(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By look-up, the middle and half width of the cell of each component."""
        d = np.arange(codes.shape[1])
        first, last = self.first[d, codes].astype(float), self.last[d, codes].astype(float)
        return (first + last) / 2, (last - first) / 2


def cells_of(ints: DataFrame, bits: int) -> dict[int, Cells]:
    """Cells per number of dimensions, from sums over all vectors (a row per dimension reaches the driver)."""
    def partial(batches):
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            dims = np.asarray(batch.column(1).to_pylist())
            rows = batch.column(0).to_pylist()
            for d in set(dims.tolist()):
                x = np.array([r for r, k in zip(rows, dims, strict=True) if k == d], np.int64)
                f = x.astype(float)
                own = [np.full(d, len(x)), f.sum(axis=0), (f * f).sum(axis=0), x.min(axis=0), x.max(axis=0)]
                old = total.get(d)
                total[d] = own if old is None else [old[0] + own[0], old[1] + own[1], old[2] + own[2], np.minimum(old[3], own[3]), np.maximum(old[4], own[4])]
        out = [(d, i, *(x[i].item() for x in own)) for d, own in total.items() for i in range(d)]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate(kinds)], names=["dim", "i", "n", "s", "ss", "least", "most"])

    sums = mapped(ints.select("v", "dim"), partial, "dim int, i int, n bigint, s double, ss double, least bigint, most bigint")
    found: dict[int, dict[int, tuple]] = {}
    for r in sums.groupBy("dim", "i").agg(F.sum("n"), F.sum("s"), F.sum("ss"), F.min("least"), F.max("most")).collect():
        found.setdefault(r[0], {})[r[1]] = tuple(r)[2:]
    out = {}
    for d, rows in found.items():
        n, s, ss, least, most = (np.array([rows[i][j] for i in range(d)]) for j in range(5))
        squares = float((np.maximum(np.abs(least), np.abs(most)).astype(float) ** 2).sum())
        if squares > 2.0**62:
            raise ValueError("vectors are too long for exact scores")
        out[d] = Cells(int(n[0]), s, ss, least, most, bits)
    return out


def approximated(rows: DataFrame, cells: dict[int, Cells], most: int) -> DataFrame:
    """Rows (vec_id, label, v, dim) that lie in order as rows of FILE, each of one label and at most ``most`` vectors."""
    def run(batches):
        def made():
            dim, label = held
            own = cells[dim]
            ints = np.array(vectors, np.int64)
            row = [[dim], [label], [np.array([i or 0 for i in ids], np.int64).tobytes()], [np.array([i is not None for i in ids]).tobytes()], [own.codes(ints).tobytes()], [ints.astype(own.kind).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=[c.split()[0] for c in FILE.split(", ")])

        held, ids, vectors = None, [], []
        for batch in batches:
            for i, label, v, dim in zip(*(batch.column(n).to_pylist() for n in range(4)), strict=True):
                if ids and (held != (dim, label) or len(ids) >= most):
                    yield made()
                    ids, vectors = [], []
                held = (dim, label)
                ids.append(i)
                vectors.append(v)
        if ids:
            yield made()

    return mapped(rows.select("vec_id", "label", "v", "dim"), run, FILE)


class Chunk:
    """A row of the file."""

    def __init__(self, cells: Cells, dim: int, label: int, ids: bytes, named: bytes, codes: bytes, ints: bytes):
        self.label, self.ids, self.named = label, np.frombuffer(ids, np.int64), np.frombuffer(named, bool)
        self.middle, self.half = cells.ends(np.frombuffer(codes, np.uint8).reshape(-1, dim))
        self.ints = np.frombuffer(ints, cells.kind).reshape(-1, dim)


class Kept:
    """The k best candidates of each of n places so far."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.floor = n, k, np.full(n, -np.inf)
        self.rows = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))  # place, score, id, has id

    def add(self, place: np.ndarray, score: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        good = score >= self.floor[place]
        if not good.any():
            return
        place, score, ids, named = (np.concatenate([old, new[good]]) for old, new in zip(self.rows, (place, score, ids, named), strict=True))
        order = np.lexsort((ids, ~named, -score, place))
        at = np.arange(len(order)) - np.searchsorted(place[order], place[order])
        order = order[at < self.k]
        self.rows = (place[order], score[order], ids[order], named[order])
        full = np.flatnonzero(np.bincount(self.rows[0], minlength=self.n) == self.k)
        self.floor[full] = self.rows[1][np.searchsorted(self.rows[0], full, "right") - 1]


class Anchors:
    """A block of anchors of one number of dimensions; ``windows`` (first and last score, per anchor and place) are there in the second step. ``pairs``
    and ``scored`` count pairs bounded and scored exactly."""

    def __init__(self, rows: list[tuple[int, int, int, list[int], list[int]]], k: int, low: int, high: int):
        self.keys, self.ids, self.labels = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        self.ints = np.array([r[3] for r in rows], np.int64)
        self.turned, self.sizes = self.ints.astype(float), np.abs(self.ints).astype(float)
        self.reach = 1e-9 * (1 + np.linalg.norm(self.turned, axis=1))
        self.opened = max(len(r[4]) for r in rows)
        self.scores = np.zeros((len(rows), self.opened), np.int64)
        self.first, self.last = np.ones((2, len(rows), self.opened))
        self.last -= 2  # nothing lies between
        for i, r in enumerate(rows):
            self.scores[i, : len(r[4])] = r[4]
            self.first[i, : len(r[4])] = [-(-low * p // 100) for p in r[4]]
            self.last[i, : len(r[4])] = [high * p // 100 for p in r[4]]
        self.kept = Kept(len(rows) * max(1, self.opened), k)
        self.pairs = self.scored = 0

    def bounds(self, own: np.ndarray, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        middle, half = self.turned[own] @ chunk.middle.T, self.sizes[own] @ chunk.half.T
        longest = float(np.sqrt(((np.abs(chunk.middle) + chunk.half) ** 2).sum(axis=1).max()))
        half += (self.reach[own] * (1 + longest))[:, None]
        return middle - half, middle + half

    def exact(self, own: np.ndarray, p: np.ndarray, c: np.ndarray, chunk: Chunk) -> np.ndarray:
        self.scored += len(p)
        out = np.empty(len(p), np.int64)
        for a in range(0, len(p), 1 << 16):
            z = a + (1 << 16)
            out[a:z] = np.einsum("ij,ij->i", self.ints[own[p[a:z]]], chunk.ints[c[a:z]].astype(np.int64))
        return out

    def near(self, chunk: Chunk) -> None:
        """Candidates of the anchors' own label."""
        own = np.flatnonzero(self.labels == chunk.label)
        if not len(own):
            return
        low, high = self.bounds(own, chunk)
        self.pairs += low.size
        other = ~chunk.named[None, :] | (chunk.ids[None, :] != self.ids[own, None])
        low[~other] = -np.inf
        floor, k = self.kept.floor[own], self.kept.k
        if low.shape[1] >= k:
            floor = np.maximum(floor, np.partition(low, -k, axis=1)[:, -k])
        p, c = np.nonzero((high >= floor[:, None]) & other)
        self.kept.add(own[p], self.exact(own, p, c, chunk), chunk.ids[c], chunk.named[c])

    def inside(self, chunk: Chunk) -> None:
        """Candidates of other labels in the windows."""
        own = np.flatnonzero(self.labels != chunk.label)
        if not len(own) or not self.opened:
            return
        low, high = self.bounds(own, chunk)
        self.pairs += low.size
        other = ~chunk.named[None, :] | (chunk.ids[None, :] != self.ids[own, None])
        floor = self.kept.floor.reshape(-1, self.opened)[own]
        live = [(high >= np.maximum(self.first[own, j], floor[:, j])[:, None]) & (low <= self.last[own, j][:, None]) for j in range(self.opened)]
        p, c = np.nonzero(np.logical_or.reduce(live) & other)
        score = self.exact(own, p, c, chunk)
        for j in range(self.opened):
            fits = (score >= self.first[own[p], j]) & (score <= self.last[own[p], j])
            self.kept.add(own[p[fits]] * self.opened + j, score[fits], chunk.ids[c[fits]], chunk.named[c[fits]])

    def found(self) -> pa.RecordBatch:
        """anchor, score of the positive (0 in the first step), candidate and its score."""
        place, score, ids, named = self.kept.rows
        at, j = np.divmod(place, max(1, self.opened))
        opened = self.scores[at, j] if self.opened else np.zeros(len(at), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(self.keys[at], pa.int64()), pa.array(opened, pa.int64()), pa.array(ids, pa.int64(), mask=~named), pa.array(score, pa.int64())], names=["anchor", "opened", "vec_id", "score"])


def met(anchors: DataFrame, file: DataFrame, cells: dict[int, Cells], k: int, low: int, high: int, n_blocks: int, shares: int, counter) -> DataFrame:
    """Each block of anchors (anchor, vec_id, label, v, dim, block, scores) with each share of the file; of each share the k best."""
    left = anchors.select("dim", "block", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("kind"), F.struct("anchor", "vec_id", "label", "v", "scores").alias("own"))
    share = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shares)).cast("int").alias("share")
    names = [c.split()[0] for c in FILE.split(", ")][1:]
    right = file.select("dim", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), share, F.lit(1).alias("kind"), F.struct(*names).alias("chunk"))
    group = ["dim", "block", "share"]
    dealt = left.unionByName(right, allowMissingColumns=True).repartition(min(100_000, n_blocks * shares), *group).sortWithinPartitions(*group, "kind").select(*group, "kind", "own", "chunk")

    def run(batches):
        at, rows, own = None, [], None

        def closed():
            if own is None:
                return
            if counter is not None:
                counter.add((own.pairs, own.scored))
            yield own.found()

        for batch in batches:
            for i in range(batch.num_rows):
                dim, block, share, kind = (batch.column(j)[i].as_py() for j in range(4))
                if (dim, block, share) != at:
                    yield from closed()
                    at, rows, own = (dim, block, share), [], None
                if kind == 0:
                    x = batch.column(4)[i].as_py()
                    rows.append((x["anchor"], x["vec_id"], x["label"], x["v"], x["scores"]))
                elif rows or own:
                    if own is None:
                        own, rows = Anchors(rows, k, low, high), []
                    x = batch.column(5)[i].as_py()
                    chunk = Chunk(cells[dim], dim, *(x[c] for c in names))
                    own.inside(chunk) if own.opened else own.near(chunk)
        yield from closed()

    return mapped(dealt, run, "anchor bigint, opened bigint, vec_id bigint, score bigint")


def mine(vectors: DataFrame, spark: SparkSession, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, bits: int = 6, block: int = 4096, chunk: int = 256, counter=None) -> DataFrame:
    """For each anchor (rows for which the condition on vec_id holds) and each of its best rows of the same label, the best rows of other labels whose score lies
    between ``low`` and ``high`` percent of the positive's. ``counter``, an accumulator with topk.PairCounts, gets the pairs bounded and scored exactly."""
    scratch = Scratch(spark, "negatives")
    ints = scratch.write(integers(vectors), "ints")
    cells = cells_of(ints, bits)
    order = ["dim", "label", F.xxhash64("vec_id", "v")]  # and the row's number, so that rows may be many that are equal
    file = scratch.write(approximated(ints.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order), cells, chunk), "file")
    asked = scratch.write(ints.where(anchors).dropDuplicates(["vec_id", "label", "v"]).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    n_blocks = max(1, -(-2 * asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(n_blocks)).cast("int"))
    shares = max(1, min(file.count() // 8, -(-2 * spark.sparkContext.defaultParallelism // n_blocks)))

    first = met(asked.withColumn("scores", F.array().cast("array<bigint>")), file, cells, positives, low, high, n_blocks, shares, counter)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    near = first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    near = scratch.write(near.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "place"), "positives")
    windows = near.groupBy("anchor").agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))  # of at most ``positives`` rows
    second = met(asked.join(windows, "anchor"), file, cells, negatives, low, high, n_blocks, shares, counter)
    order = Window.partitionBy("anchor", "opened").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    hard = second.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    hard = hard.select("anchor", F.col("opened").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = near.join(hard, ["anchor", "positive_score"]).join(asked.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

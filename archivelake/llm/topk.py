"""Exact top-k inner products: norm-sorted candidates, SVD-rotated partial sums, Cauchy-Schwarz pruning.

Each component x becomes floor(256 x). The rotation comes from the second moments of all candidates, gathered as sums
(dimension x dimension numbers reach the driver). Candidates are range-partitioned and sorted by descending length and stored in
chunks. Each query's first floor is its k-th best score in the chunk of the longest vectors (one chunk per dimension, a fixed size,
reaches the driver); its floor over its length is the least length that a partner of its needs. Queries of like need share blocks of
about half ``block`` rows, and a chunk is dealt only to blocks whose least need its longest vector meets: nothing is sent where
lengths alone decide (the needs, one number per block, reach the driver; where lengths are alike, each block gets all chunks).
One plan deals each block, with a share of its chunks, to a task of its own, which takes its chunks by descending length and keeps each
query's k best so far, whose last score is the query's floor from then on. A candidate is left out as soon as a bound falls below the floor:

* the largest length of the chunk times the query's length (then all that follow are left out too),
* after each of several levels of rotated coordinates, the partial sum plus the product of the residual lengths.

What survives is scored exactly in integers. The best of all shares are the result. How much is pruned depends on the data:
vectors of one length in all directions leave little to prune, and all pairs are then scored.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; vectors of different length don't meet; a
candidate with the query's vec_id counts as the query's own row, so repeated ids are never partners; rows that repeat a
query's id share one ranking; ties go to the smaller vec_id (null last), then repeated rows each take a rank; fewer candidates give
fewer rows; empty tables give no row; lengths whose product passes 2^62 raise an error, since a score might not fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, prepared, small_side

SCALE = 256
#: Queries are told apart by need in at most so many steps.
LEVELS = 64
PACKED = "dim int, top double, ids binary, named binary, ints binary"


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, its integer components, their number and their length, without vectors that take no part."""
    v = F.col("embedding")
    rows = prepared(vectors, "vec_id", "embedding").where(v.isNotNull() & (F.size(v) > 0))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = rows.where(fine).select("vec_id", F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("bigint")).alias("v"), F.size(v).alias("dim"))
    return whole.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))


def rotation(ints: DataFrame) -> dict[int, np.ndarray]:
    """Per dimension the eigenvectors of the second moments, largest first."""
    def partial(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.asarray(batch.column(1).to_pylist())
            rows = batch.column(0).to_pylist()
            for d in set(dims.tolist()):
                x = np.array([r for r, k in zip(rows, dims, strict=True) if k == d], float)
                total[d] = total.get(d, 0) + x.T @ x
        out = [(d, i, row.tolist()) for d, m in total.items() for i, row in enumerate(m)]
        yield pa.RecordBatch.from_pydict({"dim": pa.array([o[0] for o in out], pa.int32()), "i": pa.array([o[1] for o in out], pa.int32()), "r": pa.array([o[2] for o in out], pa.list_(pa.float64()))})

    cells = ints.select("v", "dim").mapInArrow(partial, "dim int, i int, r array<double>").select("dim", "i", F.posexplode("r").alias("j", "x"))
    found: dict[int, np.ndarray] = {}
    for r in cells.groupBy("dim", "i", "j").agg(F.sum("x").alias("x")).collect():
        found.setdefault(r["dim"], np.zeros((r["dim"], r["dim"])))[r["i"], r["j"]] = r["x"]
    return {d: np.linalg.eigh(m)[1][:, ::-1] for d, m in found.items()}


class PairCounts(AccumulatorParam):
    """Adds pairs of numbers."""

    def zero(self, value):
        return (0, 0)

    def addInPlace(self, a, b):
        return (a[0] + b[0], a[1] + b[1])


def levels_of(dim: int, head: int) -> list[int]:
    """Numbers of rotated coordinates after which candidates are looked through again: ``head``, then twice as many each time."""
    return [head << i for i in range(dim.bit_length()) if 0 < head << i < dim]


def arrays(ids: bytes, named: bytes, ints: bytes, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(named, bool), np.frombuffer(ints, np.int64).reshape(-1, dim)


class Block:
    """Queries of one dimension with their k best so far; ``pairs`` and ``scored`` count candidates seen and scored exactly."""

    def __init__(self, ids: np.ndarray, ints: np.ndarray, basis: np.ndarray, k: int, head: int = 8, floor: np.ndarray | None = None):
        self.ids, self.ints, self.basis, self.k = ids, ints, basis, k
        self.cuts = levels_of(ints.shape[1], head)
        self.norms, self.turned, self.rests = self._turned(ints)
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.copy()
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))  # query, score, id, has id
        self.pairs = self.scored = 0

    def _turned(self, ints: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Lengths, rotated rows, and the lengths of what is left of them after each level."""
        rows = ints.astype(float)
        turned = rows @ self.basis
        return np.linalg.norm(rows, axis=1), turned, [np.linalg.norm(turned[:, c:], axis=1) for c in self.cuts]

    def add(self, ids: np.ndarray, named: np.ndarray, ints: np.ndarray) -> bool:
        """Take a chunk of candidates; False if neither it nor any of smaller lengths can matter."""
        self.pairs += len(self.ids) * len(ids)
        norms, turned, rests = self._turned(ints)
        top = float(norms.max())
        if top * float(self.norms.max()) > 2.0**62:
            raise ValueError("vectors are too long for exact scores")
        slack = 1e-9 * (1 + top * self.norms)
        live = np.flatnonzero(top * self.norms + slack >= self.floor)
        if not len(live):
            return False
        p, c = np.nonzero(~named[None, :] | (ids[None, :] != self.ids[live, None]))
        dense, begin = np.zeros((len(live), len(ids))), 0
        for cut, rest_q, rest_c in zip(self.cuts, self.rests, rests, strict=True):
            if np.all(self.floor[live] == -np.inf):
                break
            if dense is not None:
                dense += self.turned[live, begin:cut] @ turned[:, begin:cut].T
                sums = dense[p, c]
            else:
                sums = sums + np.einsum("ij,ij->i", self.turned[live[p], begin:cut], turned[c, begin:cut])
            q = live[p]
            stay = sums + rest_q[q] * rest_c[c] + slack[q] >= self.floor[q]
            p, c, sums, begin = p[stay], c[stay], sums[stay], cut
            if len(p) * 4 < len(live) * len(ids):
                dense = None
        q = live[p]
        self.scored += len(q)
        if len(q):
            self._keep(q, self._exact(q, c, ints, top), ids[c], named[c])
        return True

    def _exact(self, q: np.ndarray, c: np.ndarray, ints: np.ndarray, top: float) -> np.ndarray:
        kind = float if top * float(self.norms.max()) < 2.0**53 else np.int64  # below that, sums of doubles are exact
        a, b = self.ints.astype(kind, copy=False), ints.astype(kind, copy=False)
        if len(q) * 4 < len(self.ids) * len(ints):
            return np.einsum("ij,ij->i", a[q], b[c]).astype(np.int64)
        return (a @ b.T)[q, c].astype(np.int64)

    def _keep(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        good = score >= self.floor[q]
        q, score, ids, named = (np.concatenate([old, new[good]]) for old, new in zip(self.kept, (q, score, ids, named), strict=True))
        order = np.lexsort((ids, ~named, -score, q))
        place = np.arange(len(order)) - np.searchsorted(q[order], q[order])
        order = order[place < self.k]
        self.kept = (q[order], score[order], ids[order], named[order])
        last = np.flatnonzero(np.bincount(self.kept[0], minlength=len(self.ids)) == self.k)
        self.floor[last] = np.maximum(self.floor[last], self.kept[1][np.searchsorted(self.kept[0], last, "right") - 1])

    def need(self) -> np.ndarray:
        """The least length at which a candidate can reach each query's floor; below zero where any can."""
        with np.errstate(divide="ignore", invalid="ignore"):
            least = (self.floor * (1 - 1e-9) - 1e-9) / self.norms
        return np.where((self.floor > 0) & (self.norms > 0), least, -1.0)

    def found(self) -> pa.RecordBatch:
        q, score, ids, named = self.kept
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q], pa.int64()), pa.array(ids, pa.int64(), mask=~named), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])


def packed(rows: DataFrame, most: int) -> DataFrame:
    """Rows (vec_id, v, dim, norm, block) that lie in order as rows of PACKED, each of one block and at most ``most`` vectors."""
    def run(batches):
        def made():
            block, dim = held
            named = np.array([i is not None for i in ids], bool)
            row = [[block], [dim], [max(norms)], [np.array([i or 0 for i in ids], np.int64).tobytes()], [named.tobytes()], [np.array(vectors, np.int64).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "dim", "top", "ids", "named", "ints"])

        held, ids, vectors, norms = None, [], [], []
        for batch in batches:
            for i, v, dim, norm, block in zip(*(batch.column(n).to_pylist() for n in range(5)), strict=True):
                if ids and (held != (block, dim) or len(ids) >= most):
                    yield made()
                    ids, vectors, norms = [], [], []
                held = (block, dim)
                ids.append(i)
                vectors.append(v)
                norms.append(norm)
        if ids:
            yield made()

    return rows.select("vec_id", "v", "dim", "norm", "block").mapInArrow(run, "block int, " + PACKED)


def search(vectors: DataFrame, spark: SparkSession, every: int = 50, k: int = 5, block: int = 2048, head: int = 8, chunk: int = 256, counter=None, met_counter=None) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``, its k best partners; ``counter``, an accumulator with PairCounts, gets the pairs
    seen and scored, ``met_counter`` the number of chunks dealt to blocks."""
    scratch = Scratch(spark, "topk")
    ints = scratch.write(integers(vectors), "ints")
    bases = rotation(ints)
    order = ["dim", F.desc("norm"), F.xxhash64("vec_id", "v")]  # and the row's number, so that rows may be many that are equal
    chunks = packed(ints.withColumn("block", F.lit(0)).repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order), chunk).drop("block")
    chunks = scratch.write(chunks, "chunks")
    longest = {r["dim"]: arrays(*r["c"], r["dim"]) for r in chunks.groupBy("dim").agg(F.max_by(F.struct("ids", "named", "ints"), "top").alias("c")).collect()}

    def needing(batches):
        """With each query the least length of a partner that can reach its first floor; below zero where any can."""
        for batch in batches:
            ids, vectors, dims = (batch.column(n).to_pylist() for n in ("vec_id", "v", "dim"))
            need = np.full(len(ids), -1.0)
            for d in set(dims):
                at = [i for i, k in enumerate(dims) if k == d]
                own = Block(np.array([ids[i] for i in at], np.int64), np.array([vectors[i] for i in at], np.int64), bases[d], k, head)
                own.add(*longest[d])
                need[at] = own.need()
            yield batch.append_column("need", pa.array(need, pa.float64()))

    asked = ints.where(F.col("vec_id") % every == 0).select("vec_id", "v", "dim", "norm")
    asked = scratch.write(asked.mapInArrow(needing, "vec_id bigint, v array<bigint>, dim int, norm double, need double"), "asked")
    n_blocks = max(1, -(-2 * asked.count() // block))
    ends = sorted(set(asked.approxQuantile("need", [i / n for i in range(1, n)], 0.001))) if (n := min(LEVELS, n_blocks)) > 1 else []
    asked = asked.withColumn("level", sum((F.when(F.col("need") > e, 1).otherwise(0) for e in ends), F.lit(0)))
    sizes, base, dealt = asked.groupBy("dim", "level").count().orderBy("dim", "level").collect(), 0, []
    for r in sizes:
        dealt.append((r["dim"], r["level"], n := -(-2 * r["count"] // block), base))
        base += n
    dealt = spark.createDataFrame(dealt, "dim int, level int, n int, base int")
    asked = asked.join(small_side(dealt, len(sizes)), ["dim", "level"]).withColumn("block", (F.col("base") + F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("n"))).cast("int"))
    blocks = packed(asked.repartition("block").sortWithinPartitions("block"), block)

    def seeded(batches):
        for batch in batches:
            floors, needs = [], []
            for dim, *own in zip(*(batch.column(n).to_pylist() for n in ("dim", "ids", "named", "ints")), strict=True):
                ids, _, rows = arrays(*own, dim)
                one = Block(ids, rows, bases[dim], k, head)
                one.add(*longest[dim])
                floors.append(one.floor.tobytes())
                needs.append(float(one.need().min()))
            yield batch.append_column("floors", pa.array(floors, pa.binary())).append_column("need", pa.array(needs, pa.float64()))

    blocks = scratch.write(blocks.mapInArrow(seeded, "block int, " + PACKED + ", floors binary, need double"), "blocks")
    needs: dict[int, list] = {}
    for r in blocks.groupBy("dim", "block").agg(F.min("need").alias("need")).collect():
        needs.setdefault(r["dim"], []).append((r["need"], r["block"]))
    needs = {d: sorted(v) for d, v in needs.items()}
    shares = max(1, min(chunks.count() // 8, -(-2 * spark.sparkContext.defaultParallelism // n_blocks)))
    sent = spark.sparkContext.broadcast({d: (np.array([n for n, _ in v]), np.array([b for _, b in v], np.int32)) for d, v in needs.items()})

    def met(batches):
        """The chunks once for each block that needs them."""
        for batch in batches:
            for i, (d, top) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if d in sent.value:
                    least, names = sent.value[d]
                    for b in names[: np.searchsorted(least, top, "right")].tolist():
                        if met_counter is not None:
                            met_counter.add(1)
                        yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns), pa.array([b], pa.int32())], names=[*batch.schema.names, "block"])

    # each block with each share of the chunks; within a group the queries come first, then chunks by descending length
    left = blocks.drop("need").select("*", F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    right = chunks.mapInArrow(met, PACKED + ", block int").withColumn("share", F.pmod(F.xxhash64("ids", "top"), F.lit(shares)).cast("int")).withColumn("kind", F.lit(1))
    group = ["dim", "block", "share"]
    dealt = left.unionByName(right.withColumn("floors", F.lit(None).cast("binary"))).repartition(min(100_000, n_blocks * shares), *group).sortWithinPartitions(*group, "kind", F.desc("top")).select(*group, "kind", "ids", "named", "ints", "floors")

    def run(batches):
        at, own, live = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                dim, b, s, kind, *vectors, floors = (batch.column(j)[i].as_py() for j in range(8))
                if (dim, b, s) != at:
                    yield from closed(own)
                    at, own, live = (dim, b, s), [], None
                ids, named, rows = arrays(*vectors, dim)
                if kind == 0:
                    own.append(Block(ids, rows, bases[dim], k, head, np.frombuffer(floors)))
                else:
                    live = [x for x in (own if live is None else live) if x.add(ids, named, rows)]
        yield from closed(own)

    def closed(own):
        for x in own:
            if counter is not None:
                counter.add((x.pairs, x.scored))
            yield x.found()

    best = dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return best.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Exact nearest vectors by inner product through a pivot index.

Build: pivots are chosen from a bounded sample of each space (results don't depend on them); every vector goes to the cell of its nearest pivot and keeps its distance
to it, and the rows of a cell are stored by distance. Per cell the number of vectors, the range of distances and the largest length are kept: a row per pivot.

Search: with p a cell's pivot and [near, far] its distances, a vector x of the cell has q.x <= q.p + |q| far, and by the triangle inequality
|q - x| >= max(|q - p| - far, near - |q - p|), so q.x <= (|q|^2 + longest^2 - that^2) / 2. A query first meets some vectors of the cells nearest to it, whose k-th best score is
its floor; then it visits the cells whose bound reaches the floor, and no others. Within a cell rows come by distance, and runs of them that the bound excludes for all
queries of the task are passed over. Large cells and cells with many visitors are dealt to several tasks. What is shuffled is a query per visited cell,
and a cell's vectors once for ``QUERY_BLOCK`` visitors.

Scores are rounded to 6 digits, ties go to the smaller vec_id. Zero, null and empty vectors take no part; vectors of different length don't meet.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import TOP_K, Nearest, runs, vectors_of
from .tables import kept

#: Pivots per space at most, vectors per pivot aimed at, and sampled vectors per pivot.
PIVOTS, PER_PIVOT, SAMPLED = 256, 1024, 16
#: Visitors and vectors of a cell that meet in one task, vectors compared at a time, and vectors of a cell that set floors.
QUERY_BLOCK, SHARE, RUN, SEEDS = 4096, 65_536, 512, 1024
#: Visits that a task gives at a time.
VISITS = 8192
CELL = ["space", "dim", "cell"]
#: More than rounding moves a score.
SLACK = 2e-6


class Visits(AccumulatorParam):
    """Adds (cells visited, cells there)."""

    def zero(self, value):
        return (0, 0)

    def addInPlace(self, a, b):
        return (a[0] + b[0], a[1] + b[1])


def chosen(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` pivots: each the farthest from those before, then moved to the middle of what is nearest to them."""
    n = min(n, len(sample))
    at, picked = ((sample - sample.mean(axis=0)) ** 2).sum(axis=1), []
    for i in range(n):
        picked.append(int(at.argmax()))
        own = ((sample - sample[picked[-1]]) ** 2).sum(axis=1)
        at = own if i == 0 else np.minimum(at, own)
    pivots = sample[picked]
    for _ in range(3):
        near = nearest(sample, pivots)[0]
        sums, counts = np.zeros_like(pivots), np.bincount(near, minlength=n)
        np.add.at(sums, near, sample)
        pivots = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], pivots)
    return pivots


def nearest(rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row, and the distance to it."""
    squares = (pivots**2).sum(axis=1)[None, :] - 2 * rows @ pivots.T
    at = squares.argmin(axis=1)
    return at, np.linalg.norm(rows - pivots[at], axis=1)


class Cells:
    """Pivots of one space and length, and per pivot the number of vectors, the range of distances and the largest length."""

    def __init__(self, pivots: np.ndarray, rows: dict[int, tuple]):
        self.pivots = pivots
        own = np.array([rows.get(i, (0, np.inf, -np.inf, 0.0)) for i in range(len(pivots))], float)
        self.n, self.near, self.far, self.longest = own.T

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Per query and cell the largest score that a vector of the cell may have; -inf for empty cells."""
        length, to = np.linalg.norm(q, axis=1)[:, None], np.sqrt(np.maximum((q**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2 * q @ self.pivots.T, 0))
        with np.errstate(invalid="ignore"):
            away = np.maximum(0, np.maximum(to - self.far, self.near - to) - 1e-6 * (1 + to))
            out = np.minimum(q @ self.pivots.T + length * self.far, (length**2 + self.longest**2 - away**2) / 2)
        return np.where(self.n > 0, out + 1e-9 * (1 + length * self.longest), -np.inf)


def whole(rows: DataFrame, *columns: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return rows.select("space", *columns, v.alias("embedding"), F.size("embedding").alias("dim")).where(F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)))


class MetricIndex:
    """An index over vectors (space, vec_id, embedding); ``build`` stores it in the shared folder."""

    def __init__(self, table: DataFrame, cells: dict[tuple[str, int], Cells]):
        self.table, self.cells = table, cells

    @staticmethod
    def build(vectors: DataFrame, pivots: int = PIVOTS, per_pivot: int = PER_PIVOT) -> "MetricIndex":
        rows = kept(whole(vectors, "vec_id"))
        order = Window.partitionBy("space", "dim").orderBy(F.xxhash64("vec_id"), "vec_id")
        sample = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= pivots * SAMPLED)
        counts = {(r["space"], r["dim"]): r["count"] for r in rows.groupBy("space", "dim").count().collect()}  # a row per kind of vector
        drawn: dict[tuple, list] = {}
        for r in sample.select("space", "dim", "embedding").collect():
            drawn.setdefault((r["space"], r["dim"]), []).append(r["embedding"])
        found = {key: chosen(np.array(own), max(1, min(pivots, counts[key] // per_pivot))) for key, own in drawn.items()}
        kind = dict(rows.dtypes)["vec_id"]

        def assign(batches):
            for batch in batches:
                spaces, vectors = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                cell, dist, length = np.zeros(len(spaces), np.int32), np.zeros(len(spaces)), np.zeros(len(spaces))
                groups: dict[tuple, list[int]] = {}
                for i, (space, v) in enumerate(zip(spaces, vectors, strict=True)):
                    groups.setdefault((space, len(v)), []).append(i)
                for key, own in groups.items():
                    x = np.array([vectors[i] for i in own])
                    cell[own], dist[own] = nearest(x, found[key])
                    length[own] = np.linalg.norm(x, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(dist), pa.array(length)], names=["space", "vec_id", "embedding", "dim", "cell", "dist", "length"])

        made = rows.select("space", "vec_id", "embedding", "dim").mapInArrow(assign, f"space string, vec_id {kind}, embedding array<double>, dim int, cell int, dist double, length double")
        table = kept(made.repartitionByRange(*CELL, "dist", F.xxhash64("vec_id")).sortWithinPartitions(*CELL, "dist"))
        held: dict[tuple, dict[int, tuple]] = {}
        for r in table.groupBy(*CELL).agg(F.count("*"), F.min("dist"), F.max("dist"), F.max("length")).collect():  # a row per pivot
            held.setdefault((r[0], r[1]), {})[r[2]] = tuple(r)[3:]
        return MetricIndex(table, {key: Cells(p, held.get(key, {})) for key, p in found.items()})

    def _visitors(self, asked: DataFrame, home: int | None, counter=None) -> DataFrame:
        """A row per query and cell: its nearest cells that hold ``home`` vectors together, or those whose bound reaches its floor."""
        cells = self.cells

        def run(batches):
            for batch in batches:
                cols = [c.to_pylist() for c in batch.columns]
                row, cell = [], []
                for i, (space, v, floor) in enumerate(zip(cols[1], cols[2], cols[4], strict=True)):
                    own = cells.get((space, len(v)))
                    if own is None:
                        continue
                    bound = own.bounds(np.array([v]))[0]
                    if home is not None:
                        order = np.argsort(-bound, kind="stable")
                        enough = int(np.searchsorted(np.cumsum(np.minimum(own.n, SEEDS)[order]), home)) + 1
                        picked = [c for c in order[:enough] if own.n[c]]
                    else:
                        picked = np.flatnonzero((bound > -np.inf) & (bound >= (-np.inf if floor is None else floor) - SLACK))
                        if counter is not None:
                            counter.add((len(picked), int((own.n > 0).sum())))
                    row += [i] * len(picked)
                    cell += [int(c) for c in picked]
                    if len(row) >= VISITS:  # each visit holds the query's vector
                        yield batch.take(pa.array(row, pa.int64())).append_column("cell", pa.array(cell, pa.int32()))
                        row, cell = [], []
                yield batch.take(pa.array(row, pa.int64())).append_column("cell", pa.array(cell, pa.int32()))

        return asked.select("query_id", "space", "embedding", "dim", "floor").mapInArrow(run, "query_id bigint, space string, embedding array<double>, dim int, floor double, cell int")

    def _met(self, visitors: DataFrame, table: DataFrame, dealt: dict[tuple, tuple[int, int]], k: int) -> DataFrame:
        """The k best of each query in each share of the cells it visits. ``dealt``: blocks of visitors and shares of vectors per cell."""
        spark, kind, cells = table.sparkSession, dict(table.dtypes)["vec_id"], self.cells
        plan = spark.createDataFrame([(*key, *n) for key, n in dealt.items()], "space string, dim int, cell int, blocks int, shares int")  # a row per pivot
        group = [*CELL, "block", "share"]
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = visitors.join(F.broadcast(plan), CELL).select(*CELL, F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"), upto("shares").alias("share"), "query_id", F.lit(None).cast(kind).alias("vec_id"), "embedding", F.coalesce("floor", F.lit(-math.inf)).alias("x"))
        right = table.join(F.broadcast(plan), CELL).select(*CELL, upto("blocks").alias("block"), F.pmod(F.xxhash64("vec_id"), "shares").cast("int").alias("share"), F.lit(None).cast("bigint").alias("query_id"), "vec_id", "embedding", F.col("dist").alias("x"))
        parts = max(1, min(20_000, sum(a * b for a, b in dealt.values()), 4 * spark.sparkContext.defaultParallelism + sum(a * b for a, b in dealt.values()) // 8))
        both = left.unionByName(right).repartition(parts, *group).sortWithinPartitions(*group, F.col("query_id").asc_nulls_last(), "x")

        def best(batches):
            key, own, floors = None, None, []
            for batch in batches:
                query_ids, vec_ids, vectors, bounds = (batch.column(c) for c in (5, 6, 7, 8))
                for at, a, z in runs(batch, 5, query_ids):
                    if at != key:
                        if own:
                            yield from own.batches(key[0], vec_ids.type)
                        key, own, floors = at, Nearest(k), []
                    x, places = vectors_of(vectors.slice(a, z - a))
                    by = bounds.slice(a, z - a).to_numpy()[places]
                    if query_ids[a].is_valid:
                        own.ask(query_ids.slice(a, z - a).to_numpy()[places], x)
                        floors.append(by)
                    elif own.ids:
                        floors = [np.concatenate(floors)]
                        ids = vec_ids.slice(a, z - a).to_numpy(zero_copy_only=False)[places]
                        for b in range(0, len(ids), RUN):  # only queries that the bound of the run's distances doesn't exclude
                            part = x[b : b + RUN]
                            one = Cells(cells[key[:2]].pivots[key[2] : key[2] + 1], {0: (len(part), by[b], by[b + len(part) - 1], float(np.linalg.norm(part, axis=1).max()))})
                            which = np.flatnonzero(one.bounds(own.asked())[:, 0] >= np.maximum(floors[0], own.floors()) - SLACK)
                            if len(which):
                                own.add(ids[b : b + RUN], part, which)
            if own:
                yield from own.batches(key[0], vec_ids.type)

        out = both.select(*group, "query_id", "vec_id", "embedding", "x").mapInArrow(best, f"query_id bigint, space string, vec_id {kind}, sim double")
        order = Window.partitionBy("query_id", "space").orderBy(F.desc("sim"), "vec_id")
        return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def search(self, queries: DataFrame, k: int = TOP_K, counter=None) -> DataFrame:
        """(query_id, space, vec_id, rank, sim): the k most similar vectors of each space. ``counter``, an accumulator with Visits, gets the cells visited."""
        asked = whole(queries, "query_id").withColumn("floor", F.lit(None).cast("double"))
        order = Window.partitionBy(*CELL).orderBy("dist", "vec_id")
        seeds = self.table.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SEEDS).drop("_n")
        home = kept(self._visitors(asked, k))
        dealt = lambda counts, most: {tuple(r)[:3]: (-(-r["count"] // QUERY_BLOCK), max(1, -(-int(most(self.cells[r["space"], r["dim"]].n[r["cell"]])) // SHARE))) for r in counts.groupBy(*CELL).count().collect()}
        first = self._met(home, seeds, dealt(home, lambda n: min(n, SEEDS)), k)
        floors = first.groupBy("query_id", "space").agg(F.when(F.count("*") == k, F.min("sim")).alias("floor"))
        visits = kept(self._visitors(asked.drop("floor").join(floors, ["query_id", "space"], "left"), None, counter))
        return self._met(visits, self.table, dealt(visits, lambda n: n), k)

"""Top-k per space, rollup to entities, rank fusion, gate, blend and re-rank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

TOP_K, RRF_K, GAP = 50, 60, 0.05
#: About so many queries are compared at a time, by tasks that each get a share of the vectors.
QUERY_BLOCK = 8192
#: Queries and vectors whose scores are in memory at a time.
ASKED, MET = 1024, 512


def vectors_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a column as a matrix, without null, empty and zero ones, and their places."""
    at = np.flatnonzero(pc.greater(pc.fill_null(pc.list_value_length(column), 0), 0).to_numpy(zero_copy_only=False))
    if not len(at):
        return np.zeros((0, 0)), at
    x = (column if len(at) == len(column) else column.take(pa.array(at))).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(at), -1)
    some = (x != 0).any(axis=1)
    return (x, at) if some.all() else (x[some], at[some])


class Nearest:
    """The k best of one block of queries (of one space) so far: a row of k scores and ids per query, and nothing else of the vectors met."""

    def __init__(self, k: int):
        self.k, self.ids, self.rows, self.q = k, [], [], None
        self.sims = self.best = None

    def ask(self, query_ids: np.ndarray, rows: np.ndarray) -> None:
        if len(query_ids):
            self.ids.append(query_ids)
            self.rows.append(rows)

    def asked(self) -> np.ndarray:
        if self.q is None:
            self.q, self.rows = np.concatenate(self.rows), []
            self.sims = np.full((len(self.q), self.k), -np.inf)
        return self.q

    def floors(self) -> np.ndarray:
        """The k-th best score of each query, -inf if it has fewer."""
        self.asked()
        return self.sims[:, -1]

    def add(self, ids: np.ndarray, x: np.ndarray, which: np.ndarray | None = None) -> None:
        """Meet vectors; ``which``: places of the queries that do, all if None."""
        q = self.asked()
        if self.best is None:
            self.best = np.zeros(self.sims.shape, np.int64) if ids.dtype.kind == "i" else np.full(self.sims.shape, "", object)
        which = np.arange(len(q)) if which is None else which
        for a in range(0, len(which), ASKED):
            for b in range(0, len(x), MET):
                self._met(which[a : a + ASKED], ids[b : b + MET], x[b : b + MET])

    def _met(self, own: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        sims, k = np.round(self.q[own] @ x.T, 6), self.k
        floor = self.sims[own, -1]
        if len(ids) > k and (new := np.flatnonzero(floor == -np.inf)).size:
            floor[new] = np.partition(sims[new], -k, axis=1)[:, -k]
        at, col = np.nonzero(sims >= floor[:, None])  # all that tie with the last; ties go to the smaller id
        if not len(at):
            return
        rows = np.unique(at)
        row = np.concatenate([np.repeat(rows, k), at])
        sim = np.concatenate([self.sims[own[rows]].ravel(), sims[at, col]])
        name = np.concatenate([self.best[own[rows]].ravel(), ids[col]])
        order = np.lexsort((name if name.dtype != object else np.unique(name, return_inverse=True)[1], -sim, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        order, row, place = order[place < k], own[row[place < k]], place[place < k]
        self.sims[row, place], self.best[row, place] = sim[order], name[order]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, vector ids and scores."""
        if self.best is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at, col = np.nonzero(self.sims != -np.inf)
        return np.concatenate(self.ids)[at], self.best[at, col], self.sims[at, col]

    def batches(self, space: str, kind: pa.DataType, most: int = 65_536) -> Iterator[pa.RecordBatch]:
        """``found`` as query_id, space, vec_id, sim, some rows at a time."""
        found = self.found()
        for a in range(0, len(found[0]), most):
            q, v, s = (c[a : a + most] for c in found)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array([space] * len(q), pa.string()), pa.array(v, kind), pa.array(s, pa.float64())], names=["query_id", "space", "vec_id", "sim"])


def runs(batch: pa.RecordBatch, columns: int, asked: pa.Array) -> Iterator[tuple[tuple, int, int]]:
    """(key, from, to) of the runs of equal first ``columns`` columns; queries and vectors are runs of their own."""
    rows = list(zip(*(batch.column(c).to_pylist() for c in range(columns)), asked.is_null().to_pylist(), strict=True))
    starts = [i for i in range(len(rows)) if not i or rows[i] != rows[i - 1]]
    for a, z in zip(starts, [*starts[1:], len(rows)], strict=True):
        yield rows[a][:-1], a, z


def knn(queries: DataFrame, vectors: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query_id, space, vec_id, rank, sim): the k most similar vectors of each space by inner product, rounded to 6 digits, ties by vec_id.

    ``queries``: query_id, space, embedding; ``vectors``: space, vec_id, embedding. One plan deals each block of queries with a share of the
    vectors to a task, which keeps the k best per query: no more than k rows per query and share are shuffled, and nothing is
    collected. Zero, null and empty vectors take no part.
    """
    spark, parts = queries.sparkSession, 2 * queries.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-2 * queries.count() // QUERY_BLOCK))
    shares = max(1, -(-parts // blocks))
    kind = dict(vectors.dtypes)["vec_id"]
    numbers = {dict(df.dtypes)["embedding"] for df in (queries, vectors)}
    numbers = numbers.pop() if numbers == {"array<float>"} else "array<double>"
    none = lambda t: F.lit(None).cast(t)
    asked = queries.select(
        "space", F.pmod(F.xxhash64("query_id", "space"), F.lit(blocks)).cast("int").alias("block"), "query_id", none(kind).alias("vec_id"), F.col("embedding").cast(numbers).alias("embedding"),
    ).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    held = vectors.select("space", none("bigint").alias("query_id"), "vec_id", F.col("embedding").cast(numbers).alias("embedding"), F.pmod(F.xxhash64("vec_id"), F.lit(shares)).cast("int").alias("share"))
    held = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    group = ["space", "block", "share"]
    both = asked.unionByName(held).repartition(min(100_000, blocks * shares), *group).sortWithinPartitions(*group, F.col("query_id").asc_nulls_last())

    def best(batches):
        key, own = None, None
        for batch in batches:
            query_ids, vec_ids, vectors = (batch.column(c) for c in (3, 4, 5))
            for at, a, z in runs(batch, 3, query_ids):
                if at != key:
                    if own:
                        yield from own.batches(key[0], vec_ids.type)
                    key, own = at, Nearest(k)
                x, places = vectors_of(vectors.slice(a, z - a))
                if query_ids[a].is_valid:
                    own.ask(query_ids.slice(a, z - a).to_numpy()[places], x)
                elif own.ids and len(x):
                    own.add(vec_ids.slice(a, z - a).to_numpy(zero_copy_only=False)[places], x)
        if own:
            yield from own.batches(key[0], vec_ids.type)

    out = both.select(*group, "query_id", "vec_id", "embedding").mapInArrow(best, f"query_id bigint, space string, vec_id {kind}, sim double")
    order = Window.partitionBy("query_id", "space").orderBy(F.desc("sim"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rollup(ranked: DataFrame) -> DataFrame:
    """Best rank of an entity's vectors; ranks are not made dense again."""
    return ranked.groupBy("query_id", "source", "entity").agg(F.min("rank").alias("rank"))


def fuse(ranks: DataFrame, top_k: int = TOP_K, weights: dict | None = None, k: int = RRF_K, absentee: bool = True) -> DataFrame:
    """Reciprocal rank fusion of (query_id, source, entity, rank): an entity missing from a source of its query counts as ranked just below the list."""
    w = F.lit(1.0)
    for source, value in (weights or {}).items():
        w = F.when(F.col("source") == source, float(value)).otherwise(w)
    scored = ranks.withColumn("w", w)
    group = ["query_id", "entity"]
    if absentee:  # the weights of all sources of the query, found in the same pass
        sources = F.collect_set(F.struct("source", "w")).over(Window.partitionBy("query_id"))
        scored = scored.withColumn("every", F.aggregate(sources, F.lit(0.0), lambda a, x: a + x["w"]))
        group = [*group, "every"]
    present = scored.groupBy(*group).agg(F.sum(F.col("w") / (F.lit(float(k)) + F.col("rank"))).alias("s"), F.sum("w").alias("own"))
    if absentee:
        present = present.withColumn("s", F.col("s") + (F.col("every") - F.col("own")) / (k + top_k + 1))
    return present.select("query_id", "entity", F.round("s", 6).alias("score"))


def gap(scores: DataFrame, threshold: float = GAP) -> DataFrame:
    """Relative distance of the two best scores per query (score by rank), and if it asks for a re-rank."""
    top = scores.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b"))
    g = F.when(F.col("b").isNull() | (F.col("a") <= 0), 1.0).otherwise((F.col("a") - F.col("b")) / F.nullif(F.col("a"), F.lit(0.0)))
    return top.select("query_id", F.round(g, 6).alias("gap"), (F.col("b").isNotNull() & (g < threshold)).alias("rerank"))


def matched(ranks: DataFrame) -> DataFrame:
    """Sources of an entity in the order visual, text, clip."""
    spot = F.when(F.col("source") == "visual", 0).when(F.col("source") == "text", 1).otherwise(2)
    return ranks.groupBy("query_id", "entity").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(spot.alias("o"), "source"))), lambda x: x["source"]), ",").alias("matched"))


def clip_blend(pool: DataFrame, k: int = RRF_K, top_k: int = TOP_K) -> DataFrame:
    """New order of re-ranked rows (query_id, entity, position, clip_rank): position counts twice, clip rank once; the score stays."""
    blend = F.lit(2.0) / (k + F.col("position")) + F.lit(1.0) / (k + F.coalesce("clip_rank", F.lit(top_k + 1)))
    order = Window.partitionBy("query_id").orderBy(F.desc("blend"), "position")
    return pool.withColumn("blend", F.round(blend, 9)).withColumn("rank", F.row_number().over(order))


def lexical_rerank(pool: DataFrame) -> DataFrame:
    """Stand-in for a neural scorer: share of the query's distinct words found in the text; ties keep the fused order."""
    q = F.array_distinct(T.tokens(F.col("query")))
    score = F.round(F.size(F.array_intersect(q, T.tokens(F.col("text")))) / F.greatest(F.size(q), F.lit(1)), 6)
    order = Window.partitionBy("query_id").orderBy(F.desc("ce"), "position")
    return pool.withColumn("ce", score).withColumn("rank", F.row_number().over(order))


def neural_rerank(pool: DataFrame, scorer) -> DataFrame:
    """Re-rank with a model: ``scorer()`` is loaded once per Python worker and maps lists of (query, text) to scores."""
    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = scorer()
        for q, t in batches:
            yield pd.Series(model(list(zip(q, t, strict=True))), dtype=float)

    order = Window.partitionBy("query_id").orderBy(F.desc("ce"), "position")
    return pool.withColumn("ce", score("query", "text")).withColumn("rank", F.row_number().over(order))

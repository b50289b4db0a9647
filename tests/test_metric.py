"""The pivot index against brute force, and greedy leaders by component against the sequential rule."""

import hashlib
import random
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from archivelake.functions import hashing as H
from archivelake.operators import dedup
from archivelake.operators import retrieval as R
from archivelake.operators.metric import Cells, MetricIndex, Visits, chosen, nearest


def clustered(seed, n, dim=16, centres=20, spread=0.03):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(centres, dim))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    return middle[r.integers(0, centres, n)] + r.normal(size=(n, dim)) * spread


def table(spark, rows):
    return spark.createDataFrame(rows, "space string, vec_id bigint, embedding array<double>").repartition(3)


def brute(queries, rows, k):
    out = []
    for s, q, v in queries:
        own = [(-round(float(np.dot(v, x)), 6) + 0.0, i) for t, i, x in rows if t == s and x and len(x) == len(v) and all(e is not None and e == e for e in x) and any(x)] if v and any(v) else []
        out += [(q, s, i, n + 1, -d + 0.0) for n, (d, i) in enumerate(sorted(own)[:k])]
    return sorted(out)


def got(df):
    return sorted((r["query_id"], r["space"], r["vec_id"], r["rank"], r["sim"]) for r in df.collect())


def same(a, b):
    assert [x[:2] + x[3:4] for x in a] == [x[:2] + x[3:4] for x in b]
    assert [x[4] for x in a] == pytest.approx([x[4] for x in b], abs=2e-6)
    assert sum(x[2] != y[2] for x, y in zip(a, b, strict=True)) <= 0.005 * len(a)  # sums in another order may round differently


@pytest.mark.parametrize("pivots", [1, 24])
def test_equals_brute_force(spark, pivots):
    x = clustered(1, 900)
    rows = [("visual", i, v.tolist()) for i, v in enumerate(x)]
    rows += [("visual", 2000 + i, x[5].tolist()) for i in range(200)]  # one cell holds many equal vectors
    rows += [("text", i, (v[:4] * (1 + i % 5)).tolist()) for i, v in enumerate(x[:150])] + [("text", 500, [0.0] * 4), ("text", 501, None), ("text", 502, []), ("text", 503, [1.0, None, 0.0, 0.0]), ("text", 504, [1.0, 2.0])]
    queries = [("visual", i, x[i * 7].tolist()) for i in range(60)] + [("text", i, x[i][:4].tolist()) for i in range(20)] + [("text", 90, [0.0] * 4), ("text", 91, None), ("none", 92, [1.0, 0.0]), ("text", 93, [3.0, 1.0])]
    index = MetricIndex.build(table(spark, rows), pivots=pivots, per_pivot=32)
    asked = spark.createDataFrame(queries, "space string, query_id bigint, embedding array<double>")
    for k in (1, 10, 400):
        same(got(index.search(asked, k)), brute(queries, rows, k))


def test_few_cells_are_visited_where_vectors_cluster(spark):
    x = clustered(2, 4000)
    rows = [("visual", i, v.tolist()) for i, v in enumerate(x)]
    index = MetricIndex.build(table(spark, rows), pivots=40, per_pivot=50)
    queries = [("visual", i, x[i * 37].tolist()) for i in range(100)]
    visits = spark.sparkContext.accumulator((0, 0), Visits())
    found = got(index.search(spark.createDataFrame(queries, "space string, query_id bigint, embedding array<double>"), 10, visits))
    same(found, brute(queries, rows, 10))
    visited, there = visits.value
    assert there >= 100 * 20 and visited < 0.25 * there, (visited, there)


def test_bounds_hold():
    x = clustered(3, 800, 8) * np.linspace(0.2, 3, 800)[:, None]
    pivots = chosen(x[:200], 9)
    cell, dist = nearest(x, pivots)
    assert np.allclose(dist, np.linalg.norm(x[:, None] - pivots, axis=2).min(axis=1))
    rows = {c: (int((cell == c).sum()), float(dist[cell == c].min()), float(dist[cell == c].max()), float(np.linalg.norm(x[cell == c], axis=1).max())) for c in set(cell.tolist())}
    bounds = Cells(pivots, rows).bounds(x[::10])
    for c in range(9):
        if c in rows:
            assert (bounds[:, c] >= (x[::10] @ x[cell == c].T).max(axis=1)).all()


def test_empty(spark):
    none = table(spark, [("visual", 1, [1.0])]).limit(0)
    asked = spark.createDataFrame([("visual", 1, [1.0])], "space string, query_id bigint, embedding array<double>")
    assert MetricIndex.build(none).search(asked).count() == 0
    assert MetricIndex.build(table(spark, [("visual", 1, [1.0])])).search(asked.limit(0)).count() == 0


def sequential(ids, pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(b, []).append(a)
    lead, leader = {}, {}
    for i in sorted(ids):
        own = [a for a in sorted(near.get(i, [])) if lead[a]]
        lead[i], leader[i] = not own, own[0] if own else i
    return leader


@pytest.mark.parametrize("at_once", [10**6, 40])
def test_leaders_equal_the_sequential_rule(spark, at_once):
    r = random.Random(6)
    pairs = {(min(a, b), max(a, b)) for _ in range(260) for a, b in [r.sample(range(300), 2)] if abs(a - b) < 30}
    pairs |= {(1000 + i, 1001 + i) for i in range(120)} | {(2000, 2000 + i) for i in range(1, 90)} | {(2000 + i, 3000) for i in range(1, 30)}
    ids = sorted({x for p in pairs for x in p} | set(range(4000, 4010)))
    items, edges = spark.createDataFrame([(i,) for i in ids], "id bigint"), spark.createDataFrame(sorted(pairs), "a bigint, b bigint").repartition(4)
    assert {r["id"]: r["leader"] for r in dedup.leaders(items, edges, at_once).collect()} == sequential(ids, pairs)
    comp = {r["node"]: r["comp"] for r in dedup.components(edges, at_once).collect()}
    assert comp[1120] == 1000 and comp[2050] == 2000 == comp[3000] and set(comp) == {x for p in pairs for x in p}


def test_a_long_chain_takes_few_jobs(spark):
    n = 10_000
    items, edges = spark.range(n), spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    context = spark.sparkContext
    context.setJobGroup("chain", "chain")
    try:
        found = {r["id"]: r["leader"] for r in dedup.leaders(items, edges).collect()}
        jobs = len(context.statusTracker().getJobIdsForGroup("chain"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert found == {i: i - i % 2 for i in range(n)} and jobs < 20, jobs


def test_leaders_of_named_items(spark):
    names = ["/a", "/b", "/é", "/🙂", "/z", "/c#p1"]
    pairs = [("/a", "/b"), ("/b", "/z"), ("/z", "/é"), ("/é", "/🙂")]
    items, edges = spark.createDataFrame([(n,) for n in names], "id string"), spark.createDataFrame(pairs, "a string, b string")
    assert {r["id"]: r["leader"] for r in dedup.leaders(items, edges, 2).collect()} == {r["id"]: r["leader"] for r in dedup.leaders(items, edges).collect()} == sequential(names, pairs)


def test_no_pairs(spark):
    assert dedup.leaders(spark.range(3), spark.createDataFrame([], "a bigint, b bigint")).where("id = leader").count() == 3


def test_nearest_keeps_little(spark):
    """Scores in memory are a piece of the queries by a piece of the vectors, whatever many queries hold; the k best and their ties are as by brute force."""
    rng, k, held = np.random.default_rng(4), 20, 0
    q, x = rng.integers(-3, 4, (3000, 8)).astype(float), rng.integers(-3, 4, (6000, 8)).astype(float)
    ids = rng.permutation(len(x)) + 7
    own = R.Nearest(k)
    own.ask(np.arange(len(q)), q)
    tracemalloc.start()
    for a in range(0, len(x), 2500):
        own.add(ids[a : a + 2500], x[a : a + 2500])
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 100e6
    query_ids, got, sims = own.found()
    for i in range(0, len(q), 300):
        every = q[i] @ x.T
        assert [(v, s) for p, v, s in zip(query_ids, got, sims, strict=True) if p == i] == [(ids[j], every[j]) for j in np.lexsort((ids, -every))[:k]]
    named = R.Nearest(2)
    named.ask(np.array([5]), np.ones((1, 1)))
    named.add(np.array(["b", "d"], object), np.ones((2, 1)))
    named.add(np.array(["c", "a"], object), np.ones((2, 1)))
    assert list(named.found()[1]) == ["a", "b"]


def test_embedder_gets_whole_texts(spark):
    """Python gets one string a text, not a list of its words, and makes the same vectors."""
    texts = ["a B\u0085 a", "", " \t", None, "x" * 3000 + " y", *(f"w{i} w{i % 7} w{i % 3}" for i in range(600))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", "text", H.hash_embedding(F.col("text")).alias("e"))
    assert "array_join" in df._jdf.queryExecution().optimizedPlan().toString()
    for i, text, e in df.collect():
        want = np.bincount([H.bucket(w) for w in (text or "").lower().split()], minlength=64)
        assert np.allclose(e, want / (np.linalg.norm(want) or 1))


def test_embedder_remembers_little():
    """Buckets are remembered for so many short words, not for long ones: a worker's share of them doesn't grow with the texts."""
    words = [f"{i}{'é' * (i % 3 * 100)}" for i in range(150_000)]
    got, most = [], 0
    for a in range(0, len(words), 30_000):
        got += [H.bucket(w) for w in words[a : a + 30_000]]
        most = max(most, sum(map(sys.getsizeof, H._BUCKETS)))
    assert most < 8e6
    assert got[::5000] == [hashlib.sha256(w.encode()).digest()[-1] % 64 for w in words[::5000]] and [H.bucket(w) for w in words[::5000]] == got[::5000]


def test_pool_embedder_task_keeps_little():
    """A task of ``search_pool`` embeds by one text and a bounded number of words, not by all words of its texts or the texts of a batch."""
    texts = [" ".join(f"{i:04d}{j:020d}" for j in range(1500)) for i in range(256)]
    column = pa.array(texts)
    H._BUCKETS.clear()
    tracemalloc.start()
    got = H._embedded.func(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for i in range(0, len(texts), 64):
        want = np.bincount([hashlib.sha256(w.encode()).digest()[-1] % 64 for w in texts[i].split(" ")], minlength=64)
        assert np.allclose(got[i].as_py(), want / np.linalg.norm(want))
    assert peak < 25e6, peak


def task_of(spark, monkeypatch, plan):
    """What a task of ``plan`` does with its Arrow batches."""
    found = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema: found.append(f) or spark.createDataFrame([], schema))
    plan()
    monkeypatch.undo()
    return found[-1]


def shared_batches(key, columns, q, x, ids, by=None, size=10_000):
    """Batches of a task: the key, then queries and vectors as they are sorted, 10,000 rows at a time. ``by``: the last column, for queries and for vectors."""
    for a, z, ask in [(a, min(a + size, n), ask) for ask, n in ((True, len(q)), (False, len(x))) for a in range(0, n, size)]:
        none, rows = pa.nulls(z - a, pa.int64()), (q if ask else x)[a:z]
        own = [pa.array([k] * (z - a), pa.string() if isinstance(k, str) else pa.int32()) for k in key]
        own += [pa.array(np.arange(a, z)), none] if ask else [none, pa.array(ids[a:z])]
        own.append(pa.array(list(rows), pa.list_(pa.float64())))
        yield pa.RecordBatch.from_arrays(own + ([pa.array(by[0 if ask else 1][a:z], pa.float64())] if by else []), names=columns)


def held_by(task, batches, x, q, ids, k, most):
    """Runs a task within ``most`` bytes and checks its rows by brute force."""
    batches = list(batches)
    tracemalloc.start()
    out = [b.to_pandas() for b in task(iter(batches))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rows = {n: np.concatenate([b[n] for b in out]) for n in ("query_id", "vec_id", "sim")}
    for i in range(0, len(q), 400):
        every, own = np.round(q[i] @ x.T, 6), rows["query_id"] == i
        assert sorted(zip(-rows["sim"][own], rows["vec_id"][own], strict=True)) == [(-every[j], ids[j]) for j in np.lexsort((ids, -every))[:k]]
    assert peak < most, peak


def test_similar_task_keeps_little(spark, monkeypatch):
    """A task of ``similar_assets`` takes memory by its queries' k best, not by the vectors of a batch or those that some query holds."""
    rng = np.random.default_rng(5)
    q, x = rng.integers(-9, 10, (4000, 16)).astype(float), rng.integers(-9, 10, (25_000, 16)).astype(float)
    ids = rng.permutation(len(x)) + 3
    some = spark.createDataFrame([("clip", 1, [1.0])], "space string, vec_id bigint, embedding array<double>")
    task = task_of(spark, monkeypatch, lambda: R.knn(some.withColumnRenamed("vec_id", "query_id"), some, 13))
    held_by(task, shared_batches(("clip", 0, 0), ["space", "block", "share", "query_id", "vec_id", "embedding"], q, x, ids), x, q, ids, 13, 150e6)


def test_rollup_task_keeps_little(spark, monkeypatch):
    """A task of the pivot index, which ``entity_rollup`` goes through, doesn't take memory by the vectors of its cell that some query holds."""
    rng = np.random.default_rng(6)
    q, x = rng.integers(-9, 10, (3000, 16)).astype(float), rng.integers(-9, 10, (25_000, 16)).astype(float)
    pivot = x.mean(axis=0)
    dist = np.linalg.norm(x - pivot, axis=1)
    x, dist, ids = x[np.argsort(dist)], np.sort(dist), rng.permutation(len(x)) + 3
    table = spark.createDataFrame([], "space string, vec_id bigint, embedding array<double>, dim int, cell int, dist double, length double")
    visitors = spark.createDataFrame([], "query_id bigint, space string, embedding array<double>, dim int, floor double, cell int")
    index = MetricIndex(table, {("clip", 16): Cells(pivot[None], {0: (len(x), dist[0], dist[-1], float(np.linalg.norm(x, axis=1).max()))})})
    task = task_of(spark, monkeypatch, lambda: index._met(visitors, table, {("clip", 16, 0): (1, 1)}, 50))
    columns = ["space", "dim", "cell", "block", "share", "query_id", "vec_id", "embedding", "x"]
    held_by(task, shared_batches(("clip", 16, 0, 0, 0), columns, q, x, ids, (np.full(len(q), -np.inf), dist)), x, q, ids, 50, 150e6)

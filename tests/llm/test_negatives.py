"""Hard-negative mining against a brute-force version."""

import math
import random

import numpy as np
import pytest

pytest.importorskip("archivelake.llm")
from pyspark.sql import functions as F  # noqa: E402

from archivelake.llm import negatives  # noqa: E402
from archivelake.llm.queries import QUERIES  # noqa: E402
from archivelake.llm.topk import PairCounts  # noqa: E402

SCHEMA = "vec_id bigint, embedding array<float>, label int, score bigint, anchor string, dim int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "x", 2) for i, v, lab in rows], SCHEMA).repartition(3)


def brute(rows, every, positives=5, kept=3, low=50, high=95):
    own = []
    for i, v, lab in rows:
        if lab is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.append((i, tuple(math.floor(256 * float(np.float32(x))) for x in v), lab))
    anchors = {r for r in own if r[0] is not None and r[0] % every == 0}
    first = lambda found: sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
    out = []
    for a in anchors:
        scored = [(sum(x * y for x, y in zip(a[1], v, strict=True)), i, lab) for i, v, lab in own if i != a[0] and len(v) == len(a[1])]
        for p, positive, _ in first([s for s in scored if s[2] == a[2]])[:positives]:
            hard = first([s for s in scored if s[2] != a[2] and low * p <= 100 * s[0] <= high * p])[:kept]
            out += [(a[0], positive, r + 1, i, p, n) for r, (n, i, _) in enumerate(hard)]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def rows_of(seed, n=500, dim=6, labels=4):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.3) for _ in range(dim)] for _ in range(labels)]
    out = []
    for i in range(n):
        lab = r.randrange(labels)
        out.append((i, [c + r.gauss(0, 0.15) for c in centres[lab]], (lab + (r.random() < 0.3)) % labels))
    return out


def awkward():
    rows = rows_of(1)
    v = rows[10][1]
    rows += [(1000 + i, v, i % 3) for i in range(150)]  # equal vectors: ties
    rows += [(10, v, rows[10][2])] * 2 + [(20, rows[30][1], 1), (20, rows[31][1], 1), (None, v, rows[10][2]), (None, rows[40][1], 0), (None, v, (rows[10][2] + 1) % 4)]
    rows += [(30, None, 1), (31, [], 1), (40, [0.1, None, 0.2, 0.1, 0.3, 0.2], 1), (41, [float("nan")] * 6, 1), (50, [float("inf")] + [0.1] * 5, 1), (60, v, None)]
    rows += [(70, [0.5, 0.5], 1), (71, [0.5, 0.4], 1), (72, [0.4, 0.4], 2), (80, [0.0] * 6, 2), (90, [-x for x in v], 0)]
    rows += [(2000, [x * 1.5 for x in v], 7)] * 4 + [(2001, [x * 3 for x in v], 9), (2100, [0.3] * 6, 9)]
    return rows


@pytest.mark.parametrize("options", [{}, {"bits": 1, "block": 16, "chunk": 7}, {"bits": 8, "chunk": 64}, {"positives": 2, "negatives": 6, "low": 80, "high": 120}])
def test_against_brute_force(spark, options):
    rows = awkward()
    want = brute(rows, 10, options.get("positives", 5), options.get("negatives", 3), options.get("low", 50), options.get("high", 95))
    assert len(want) > 100
    assert got(negatives.mine(table(spark, rows), spark, F.col("vec_id") % 10 == 0, **options)) == want


def test_whole_table(spark, tiny):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").collect()]
    rows = [(i, v, (lab + 1) % 10 if lab is not None and i is not None and i % 7 == 0 else lab) for i, v, lab in rows]
    assert got(QUERIES["op11_hard_negatives"](spark, tiny)) == brute(rows, 50)


def test_bounds_hold_and_are_narrow():
    r = np.random.default_rng(4)
    ints = np.floor(256 * r.normal(0, 0.2, (300, 16)) * np.linspace(0.2, 2, 16)).astype(np.int64)
    f = ints.astype(float)
    for bits in (1, 4, 6, 8):
        cells = negatives.Cells(len(ints), f.sum(0), (f * f).sum(0), ints.min(0), ints.max(0), bits)
        codes = cells.codes(ints)
        middle, half = cells.ends(codes)
        assert (np.abs(ints - middle) <= half).all()
        chunk = negatives.Chunk(cells, 16, 0, np.arange(300).tobytes(), np.ones(300, bool).tobytes(), codes.tobytes(), ints.astype(cells.kind).tobytes())
        anchors = negatives.Anchors([(i, i, 0, ints[i].tolist(), []) for i in range(20)], 5, 50, 95)
        low, high = anchors.bounds(np.arange(20), chunk)
        exact = ints[:20] @ ints.T
        assert (low <= exact).all() and (exact <= high).all()
        width = float((high - low).mean())
        assert bits == 1 or width < before
        before = width


def test_few_pairs_are_scored_exactly(spark):
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 0.12) for _ in range(32)], r.randrange(10)) for i in range(3000)]
    counts = spark.sparkContext.accumulator((0, 0), PairCounts())
    assert got(negatives.mine(table(spark, rows), spark, F.col("vec_id") % 50 == 0, counter=counts)) == brute(rows, 50)
    pairs, scored = counts.value
    assert pairs >= 60 * 2900 and scored < 0.1 * pairs


def test_large_integers_and_too_long_vectors(spark):
    rows = [(i, [1000.0 * (1 + i % 7), 3000.0 - i], i % 2) for i in range(60)]
    assert got(negatives.mine(table(spark, rows), spark, F.col("vec_id") % 10 == 0)) == brute(rows, 10)
    with pytest.raises(ValueError, match="too long"):
        negatives.mine(table(spark, [(0, [1e12, 1e12], 1), (1, [1e12, 1e12], 1)]), spark, F.col("vec_id") == 0).collect()


def test_empty(spark):
    assert negatives.mine(table(spark, [(1, [0.1], 1)]).limit(0), spark, F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.mine(table(spark, [(1, [0.1], 1), (2, [0.1], 1)]), spark, F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.mine(table(spark, [(10, [0.1], 1), (2, [0.1], 2)]), spark, F.col("vec_id") % 10 == 0).count() == 0

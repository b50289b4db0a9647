"""Three-tier duplicates: equal bytes, equal pixels, near perceptual hashes; greedy groups by the sequential rule."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb, isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import kept

THRESHOLD = 10
#: What a pair that meets costs of a key that is shuffled, and hashes of a bucket and side that meet in one task.
PAIR, MEET = 0.004, 20_000
#: Pairs that one task settles or joins.
SETTLED = 1_000_000
BITS = 64
#: Classes that are settled in one round, slices of the earlier leaders that each item meets, and hashes compared at a time.
BLOCK, SLICES, ROWS, WIDE = 131_072, 4, 16, 8192
#: What a pair of a tile costs of a key that is shuffled, and hashes that are asked how often they meet.
TILED, SAMPLE = 0.0017, 2048
#: Tables of settled rounds that are read one by one.
ROUNDS = 16


def masks(bits: int, most: int) -> list[int]:
    """All values of ``bits`` bits with at most ``most`` set."""
    return [sum(1 << i for i in c) for n in range(most + 1) for c in combinations(range(bits), n)]


def cuts(bands: int) -> list[int]:
    return [BITS * i // bands for i in range(bands + 1)]


def scheme(n: int, threshold: int) -> tuple[int, int]:
    """(bands, bits that one side varies): of two hashes within the threshold some band differs by at most threshold / bands bits. Fewer, wider bands need more keys
    a hash and let fewer pairs meet; the cheaper by both counts is taken, a pair that meets being worth ``PAIR`` of a key that is shuffled."""
    def cost(bands: int) -> float:
        width, most = -(-BITS // bands), threshold // bands
        ball = sum(comb(width, i) for i in range(most + 1))
        return n * bands * (ball + 1) + PAIR * n * n * bands * ball / 2.0**width / 2

    bands = min((b for b in range(1, BITS + 1) if threshold // b <= 5), key=cost)
    return bands, threshold // bands


def band_keys(df: DataFrame, phash: str, bands: int, vary: int) -> DataFrame:
    """Rows per band of a hash, and per value of that band within ``vary`` bits."""
    at = cuts(bands)
    def keys(b: int, low: int, high: int):
        value = F.shiftrightunsigned(F.col(phash), low).bitwiseAND((1 << (high - low)) - 1) if high - low < BITS else F.col(phash)
        own = F.from_json(F.lit(str([m if m < 1 << 63 else m - (1 << 64) for m in masks(high - low, vary)])), "array<bigint>")
        return F.transform(own, lambda m: F.struct(F.lit(b).alias("band"), value.bitwiseXOR(m).alias("value")))

    each = [keys(b, low, high) for b, (low, high) in enumerate(zip(at, at[1:], strict=False))]
    return df.withColumn("_b", F.explode(F.concat(*each))).select("*", "_b.band", "_b.value").drop("_b")


def close_hashes(left: DataFrame, right: DataFrame, threshold: int, n: int | None = None, below: bool = False, chunk: int = MEET) -> DataFrame:
    """(p, q, distance) of all distinct hashes p of ``left`` and q of ``right`` within the threshold; ``below``: only p < q.

    Hashes meet in buckets, in which all distances are counted on arrays. A pair is given in the first band in which it meets, so none comes twice. Buckets of more than
    ``chunk`` hashes a side are dealt to several tasks as pairs of chunks.
    """
    bands, most = scheme(n if n is not None else left.count(), threshold)
    at = cuts(bands)
    kinds = [np.uint64(((1 << (z - a)) - 1) << a) for a, z in zip(at, at[1:], strict=False)]
    key, side = ["band", "value"], F.col("side")
    both = band_keys(left.select(F.col("p").alias("x"), F.lit(0).alias("side")), "x", bands, most).unionByName(band_keys(right.select(F.col("q").alias("x"), F.lit(1).alias("side")), "x", bands, 0))
    over = lambda s: F.ceil(F.count_if(side == s) / chunk).cast("int")
    large = both.groupBy(*key).agg(over(0).alias("lefts"), over(1).alias("rights")).where("lefts > 0 and rights > 0 and lefts + rights > 2")
    dealt = both.join(large, key, "left").withColumns({"lefts": F.coalesce("lefts", F.lit(1)), "rights": F.coalesce("rights", F.lit(1))})
    own = F.pmod(F.xxhash64("x"), F.when(side == 0, F.col("lefts")).otherwise(F.col("rights"))).cast("int")
    dealt = dealt.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), F.when(side == 0, F.col("rights")).otherwise(F.col("lefts")) - 1))})
    dealt = dealt.withColumns({"i": F.when(side == 0, F.col("own")).otherwise(F.col("other")), "j": F.when(side == 0, F.col("other")).otherwise(F.col("own"))})
    group = [*key, "i", "j"]
    dealt = dealt.select(*group, "side", "x").repartition(*group).sortWithinPartitions(*group, "side")

    def pairs(p: np.ndarray, q: np.ndarray, band: int):
        step = max(1, (1 << 20) // len(p))
        for a in range(0, len(q), step):
            x = p.view(np.uint64)[:, None] ^ q[a : a + step].view(np.uint64)[None, :]
            d = np.bitwise_count(x)
            near = d <= threshold
            if below:
                near &= p[:, None] < q[None, a : a + step]
            r, c = np.nonzero(near)
            x = x[r, c]
            first = np.bitwise_count(x & kinds[band]) <= most
            for mask in kinds[:band]:
                first &= np.bitwise_count(x & mask) > most
            r, c = r[first], c[first]
            yield p[r], q[a + c], d[r, c].astype(np.int32)

    def meet(batches):
        at, held = None, []
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            change = np.zeros(batch.num_rows, bool)
            for c in cols[:5]:
                change[1:] |= c[1:] != c[:-1]
            starts = np.concatenate([[0], np.flatnonzero(change)]) if batch.num_rows else []
            found = []
            for a, z in zip(starts, [*starts[1:], batch.num_rows], strict=False):
                if (own := tuple(c[a] for c in cols[:4])) != at:
                    at, held = own, []
                if cols[4][a] == 0:
                    held.append(cols[5][a:z])
                elif held:
                    held = [np.concatenate(held)] if len(held) > 1 else held
                    found += pairs(held[0], cols[5][a:z], int(own[0]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["p", "q", "distance"])

    return dealt.mapInArrow(meet, "p bigint, q bigint, distance int")


def hash_classes(df: DataFrame) -> DataFrame:
    """Classes of equal hashes of (id, phash): phash, id (the smallest) and n."""
    return df.where("phash is not null").groupBy("phash").agg(F.min("id").alias("id"), F.count("*").alias("n"))


def near_classes(df: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b, distance, n_a, n_b) of all pairs of different hashes within the threshold, each by the smallest id of its class, a < b, with
    the sizes of both classes. Copies aren't expanded: their members are those with the same hash."""
    return class_pairs(kept(hash_classes(df)), threshold)


def class_pairs(classes: DataFrame, threshold: int) -> DataFrame:
    """``near_classes`` of stored classes: by bands where few hashes meet in their buckets, else by tiles of all pairs."""
    n = classes.count()
    if not few_meet(classes, threshold, n):
        return tiled(classes, threshold, n)
    close = close_hashes(classes.select(F.col("phash").alias("p")), classes.select(F.col("phash").alias("q")), threshold, n, below=True)
    a = classes.select(F.col("phash").alias("p"), F.col("id").alias("x"), F.col("n").alias("n_x"))
    b = classes.select(F.col("phash").alias("q"), F.col("id").alias("y"), F.col("n").alias("n_y"))
    pairs = close.join(a, "p").join(b, "q")
    first = F.col("x") < F.col("y")
    return pairs.select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance", F.when(first, F.col("n_x")).otherwise(F.col("n_y")).alias("n_a"), F.when(first, F.col("n_y")).otherwise(F.col("n_x")).alias("n_b")
    )


def few_meet(classes: DataFrame, threshold: int, n: int) -> bool:
    """If bands cost less than all pairs: hashes whose bits aren't even or independent meet far more often than ``scheme`` assumes, so a sample of at most ``SAMPLE`` of them is asked."""
    if n <= BLOCK // 8:
        return False
    x = np.array([r[0] for r in classes.select("phash").orderBy(F.xxhash64("phash")).limit(SAMPLE).collect()], np.int64).view(np.uint64)
    bands, most = scheme(n, threshold)
    at = cuts(bands)
    keys = sum(len(masks(z - a, most)) + 1 for a, z in zip(at, at[1:], strict=False))
    meet = sum(float((np.bitwise_count((x[:, None] ^ x) & np.uint64(((1 << (z - a)) - 1) << a)) <= most).mean()) for a, z in zip(at, at[1:], strict=False))
    return n * keys + PAIR * meet * n * n < TILED * n * n / 2


def near(p: np.ndarray, q: np.ndarray, threshold: int, most: int = 1 << 18):
    """(places in p, places in q, distances) of all pairs within the threshold, about ``most`` at a time."""
    size, found, n = len(q), [], 0
    q = np.append(q, np.zeros(-size % 8, np.uint64))  # whole words of flags
    for z in range(0, len(q), WIDE):
        part = q[z : z + WIDE]
        x, d, flag = (np.empty((ROWS, len(part)), kind) for kind in (np.uint64, np.uint8, bool))
        for a in range(0, len(p), ROWS):
            k = min(ROWS, len(p) - a)
            np.bitwise_xor(p[a : a + k, None], part, out=x[:k])
            np.less_equal(np.bitwise_count(x[:k], out=d[:k]), threshold, out=flag[:k])
            words = np.flatnonzero(flag[:k].reshape(-1).view(np.uint64))
            if len(words):
                at = np.flatnonzero(flag.reshape(-1, 8)[words])
                at = words[at >> 3] * 8 + (at & 7)
                found.append((a + at // len(part), z + at % len(part), d.reshape(-1)[at]))
                n += len(at)
                if n >= most:
                    yield whole_pairs(found, size)
                    found, n = [], 0
    if found:
        yield whole_pairs(found, size)


def whole_pairs(found: list, size: int) -> tuple[np.ndarray, ...]:
    r, c, d = (np.concatenate(x) for x in zip(*found, strict=True))
    real = c < size
    return r[real], c[real], d[real]


def tiled(classes: DataFrame, threshold: int, n: int) -> DataFrame:
    """``class_pairs`` by tiles: each block of hashes is sent once per block, and meets one other there. Pairs come out with ids and sizes, so none is shuffled."""
    kind = dict(classes.dtypes)["id"]
    m = max(-(-n // BLOCK), min(-(-n // 2048), isqrt(4 * classes.sparkSession.sparkContext.defaultParallelism) + 1), 1)
    own, other = F.pmod(F.xxhash64("phash"), F.lit(m)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    rows = classes.select(own.alias("own"), other.alias("other"), "phash", "id", "n")
    rows = rows.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "phash", "id", "n")
    dealt = rows.repartition(m * (m + 1), "i", "j").sortWithinPartitions("i", "j", "side")

    def pairs(a, b, from_: int | None = None):
        """``from_``: where b begins in a; only pairs with earlier rows."""
        for r, c, d in near(a[0], b[0], threshold):
            if from_ is not None:
                once = r < from_ + c
                r, c, d = r[once], c[once], d[once]
            r, c = pa.array(r), pa.array(c)
            x, y, n_x, n_y = a[1].take(r), b[1].take(c), a[2].take(r), b[2].take(c)
            first = pc.less(x, y)
            columns = [pc.if_else(first, x, y), pc.if_else(first, y, x), pa.array(d.astype(np.int32)), pc.if_else(first, n_x, n_y), pc.if_else(first, n_y, n_x)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "distance", "n_a", "n_b"])

    def joined(parts):
        return parts[0] if len(parts) == 1 else (np.concatenate([p[0] for p in parts]), *(pa.concat_arrays([p[c] for p in parts]) for c in (1, 2)))

    def meet(batches):
        at, held = None, []

        def inner():
            if held and at[0] == at[1]:
                whole = joined(held)
                for a in range(0, len(whole[0]), WIDE):
                    z = a + WIDE
                    yield from pairs(tuple(c[:z] for c in whole), tuple(c[a:z] for c in whole), a)

        for batch in batches:
            i, j, side, phash = (c.to_numpy() for c in batch.columns[:4])
            change = np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(side) != 0)) + 1 if len(i) else []
            for a, z in zip([0, *change], [*change, len(i)], strict=True):
                if a == z:
                    continue
                if (i[a], j[a]) != at:
                    yield from inner()
                    at, held = (i[a], j[a]), []
                rows = (phash[a:z].view(np.uint64), batch.column(4).slice(a, z - a), batch.column(5).slice(a, z - a))
                if side[a] == 0:
                    held.append(rows)
                elif held:
                    held = [joined(held)]
                    yield from pairs(held[0], rows)
        yield from inner()

    return dealt.mapInArrow(meet, f"a {kind}, b {kind}, distance int, n_a bigint, n_b bigint")


def near_pairs(df: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b, distance) of all pairs of different ids (id, phash) within the threshold, a < b, copies expanded: for small inputs; the
    other operators use classes."""
    rows = df.where("phash is not null").select("id", "phash")
    nodes = rows.select("phash").distinct()
    close = close_hashes(nodes.withColumnRenamed("phash", "p"), nodes.withColumnRenamed("phash", "q"), threshold).where("p <= q")
    a, b = rows.select(F.col("id").alias("x"), F.col("phash").alias("p")), rows.select(F.col("id").alias("y"), F.col("phash").alias("q"))
    pairs = close.join(a, "p").join(b, "q").where("x <> y and (p <> q or x < y)")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def lookup(candidates: DataFrame, index: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """First duplicate tier of each candidate (id, sha256, pixel_hash, phash) in the index (asset_id, same columns): equal bytes, pixels, then near hash; the smallest asset_id of the tier."""
    candidates, index = kept(candidates.select("id", "sha256", "pixel_hash", "phash")), kept(index.select("asset_id", "sha256", "pixel_hash", "phash"))
    best = lambda key: index.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.min("asset_id").alias(f"by_{key}"))
    out = candidates.join(best("sha256"), "sha256", "left").join(best("pixel_hash"), "pixel_hash", "left")
    asked = candidates.where("phash is not null").select("phash").distinct()
    held = index.where("phash is not null").groupBy("phash").agg(F.min("asset_id").alias("id"))
    close = first_near(asked, held, threshold, asked.count()).withColumnRenamed("first", "by_phash")
    out = out.join(close, "phash", "left")
    tier = F.when(F.col("by_sha256").isNotNull(), "sha256").when(F.col("by_pixel_hash").isNotNull(), "pixel_hash").when(F.col("by_phash").isNotNull(), "phash")
    return out.select("id", F.coalesce("by_sha256", "by_pixel_hash", "by_phash").alias("duplicate_of"), tier.alias("tier"))


def components(edges: DataFrame, at_once: int = SETTLED) -> DataFrame:
    """(node, comp) of all nodes of the edges (a, b), comp being the smallest node that is reached. Each round cuts the edges in ranges of a; a task joins what its range
    connects to one root, and what is left are edges between roots of the same node. Once ``at_once`` edges are left, one task finishes."""
    kind = dict(edges.dtypes)["a"]

    def joined(batches):
        root, of = {}, None

        def top(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for batch in batches:
            of = batch.schema.field(0).type
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = top(root.setdefault(a, a)), top(root.setdefault(b, b))
                root[max(x, y)] = min(x, y)
        nodes = list(root)
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, of), pa.array([top(n) for n in nodes], of)], names=["node", "root"])

    mapping, left = None, edges.count()
    while left:
        parts = -(-left // at_once)
        spread = edges.select("a", "b").coalesce(1) if parts == 1 else edges.select("a", "b").repartitionByRange(parts, "a", "b")
        roots = kept(spread.mapInArrow(joined, f"node {kind}, root {kind}"))
        own = roots.groupBy("node").agg(F.min("root").alias("comp")) if parts > 1 else roots.withColumnRenamed("root", "comp")
        mapping = own if mapping is None else mapping.join(own.select(F.col("node").alias("comp"), F.col("comp").alias("_up")), "comp", "left").select("node", F.coalesce("_up", "comp").alias("comp"))
        if parts == 1:
            break
        mapping = kept(mapping)
        edges = kept(roots.join(own, "node").where("root <> comp").select(F.least("root", "comp").alias("a"), F.greatest("root", "comp").alias("b")).distinct())
        left = edges.count()
    return mapping if mapping is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def settled(edges: DataFrame) -> DataFrame:
    """(id, first): of edges (comp, a, b), whole components in each task, the smallest leading neighbour of each b; null where b leads."""
    kind = dict(edges.dtypes)["a"]

    def run(batches):
        comp, leads, of = None, {}, None
        b, first = None, None

        def closed(out):
            if b is not None:
                leads[b] = first is None
                out.append((b, first))

        for batch in batches:
            out: list[tuple] = []
            of = batch.schema.field(1).type
            for c, x, y in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if (c, y) != (comp, b):
                    closed(out)
                    if c != comp:
                        comp, leads = c, {}
                    b, first = y, None
                if first is None and leads.get(x, True):  # an item without earlier neighbours leads
                    first = x
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], of) for i in range(2)], names=["id", "first"])
        if b is not None:
            out = []
            closed(out)
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], of) for i in range(2)], names=["id", "first"])

    return edges.select("comp", "a", "b").repartition("comp").sortWithinPartitions("comp", "b", "a").mapInArrow(run, f"id {kind}, first {kind}")


def by_rounds(edges: DataFrame) -> DataFrame:
    """``settled`` for components of any size: each round settles every item whose earlier neighbours are settled, the first open one among them, so rounds end."""
    state = kept(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("leads", F.lit(None).cast("boolean")))
    while not state.where("leads is null").isEmpty():
        earlier = edges.join(state.select(F.col("id").alias("a"), "leads"), "a")
        seen = earlier.groupBy("b").agg(F.max(F.coalesce("leads", F.lit(False))).alias("near"), F.min(F.col("leads").isNotNull()).alias("settled"))
        leads = F.coalesce("leads", F.when(F.col("near"), F.lit(False)).when(F.coalesce("settled", F.lit(True)), F.lit(True)))
        state = kept(state.join(seen.withColumnRenamed("b", "id"), "id", "left").select("id", leads.alias("leads")))
    return edges.join(state.where("leads").select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("first"))


def leaders(items: DataFrame, pairs: DataFrame, at_once: int = SETTLED) -> DataFrame:
    """Greedy leaders of (id) in id order: an item leads unless it is near an earlier leader. Returns (id, leader): itself or its earliest near leader.

    What an item becomes depends on its connected component only. Components of up to ``at_once`` pairs are settled in one task each, by the rule as it stands; larger ones in rounds
    over stored tables.
    """
    edges = kept(pairs.select("a", "b").distinct())
    placed = edges.join(components(edges, at_once).withColumnsRenamed({"node": "a"}), "a")
    sizes = kept(placed.groupBy("comp").agg(F.count("*").alias("n")))
    large = sizes.where(F.col("n") > at_once).select("comp")
    if large.isEmpty():
        found = settled(placed)
    else:
        placed = kept(placed)
        rest = kept(placed.join(large, "comp", "left_semi").select("a", "b"))
        found = settled(placed.join(large, "comp", "left_anti")).unionByName(by_rounds(rest))
    return items.select("id").join(found, "id", "left").select("id", F.coalesce("first", "id").alias("leader"))


def earliest(p: np.ndarray, q: np.ndarray, threshold: int) -> np.ndarray:
    """The place of the first hash in ``q`` within the threshold of each of ``p``, or -1; what is found isn't compared any further."""
    out, left = np.full(len(p), -1, np.int64), np.arange(len(p))
    for z in range(0, len(q), WIDE):
        part, still = q[z : z + WIDE], []
        x, d, near = (np.empty((ROWS, len(part)), kind) for kind in (np.uint64, np.uint8, bool))
        for a in range(0, len(left), ROWS):
            own = left[a : a + ROWS]
            k = len(own)
            np.bitwise_xor(p[own, None], part, out=x[:k])
            np.less_equal(np.bitwise_count(x[:k], out=d[:k]), threshold, out=near[:k])
            at = near[:k].argmax(axis=1)
            found = near[np.arange(k), at]
            out[own[found]] = z + at[found]
            still.append(own[~found])
        left = np.concatenate(still) if still else left
    return out


def in_order(p: np.ndarray, threshold: int, step: int = 1024) -> np.ndarray:
    """The sequential rule on hashes in id order: the place of the earliest near leader of each, its own where it leads."""
    first, leads, n = np.arange(len(p)), np.empty(len(p), np.int64), 0
    for a in range(0, len(p), step):
        own = np.arange(a, min(len(p), a + step))
        at = earliest(p[own], p[leads[:n]], threshold)
        first[own[at >= 0]] = leads[at[at >= 0]]
        own = own[at < 0]
        near, free = np.bitwise_count(p[own, None] ^ p[None, own]) <= threshold, np.ones(len(own), bool)
        for i in range(len(own)):
            if free[i]:
                taken = near[i] & free
                first[own[taken]] = own[i]
                free &= ~taken
                leads[n] = own[i]
                n += 1
    return first


def first_near(items: DataFrame, held: DataFrame, threshold: int, n: int) -> DataFrame:
    """(phash, first): the smallest id of ``held`` (id, phash) within the threshold of each of the ``n`` hashes of ``items`` (phash), null if there is none.

    Slices of the items meet slices of what is held, which come in id order and are passed on as arrays: no pair is written, and an item is compared up to its first near one only."""
    kind, none = dict(held.dtypes)["id"], F.lit(None)
    own = max(-(-2 * held.sparkSession.sparkContext.defaultParallelism // SLICES), -(-n // BLOCK))
    spread = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asked = items.select(spread("phash", own).alias("i"), every(SLICES).alias("j"), F.lit(0).alias("side"), none.cast(kind).alias("id"), "phash")
    there = held.select(every(own).alias("i"), spread("phash", SLICES).alias("j"), F.lit(1).alias("side"), "id", "phash")
    dealt = asked.unionByName(there).repartition(2 * own * SLICES, "i", "j").sortWithinPartitions("i", "j", "side", "id", "phash")

    def meet(batches):
        at, of = None, None
        hashes, firsts, left = [], [], None

        def closed():
            p = np.concatenate(hashes)
            return pa.RecordBatch.from_arrays([pa.array(p), pa.array(firsts if left is not None else [None] * len(p), of)], names=["phash", "first"])

        for batch in batches:
            i, j, side, phash = (batch.column(c).to_numpy() for c in (0, 1, 2, 4))
            ids, of = batch.column(3), batch.schema.field(3).type
            change = np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(side) != 0)) + 1 if len(i) else []
            for a, z in zip([0, *change], [*change, len(i)], strict=True):
                if a == z:
                    continue
                if (i[a], j[a]) != at:
                    if hashes:
                        yield closed()
                    at, hashes, firsts, left = (i[a], j[a]), [], [], None
                if side[a] == 0:
                    hashes.append(phash[a:z])
                elif hashes:
                    if left is None:
                        hashes = [np.concatenate(hashes)]
                        firsts, left = [None] * len(hashes[0]), np.arange(len(hashes[0]))
                    place = earliest(hashes[0][left].view(np.uint64), phash[a:z].view(np.uint64), threshold)
                    near = place >= 0
                    for row, x in zip(left[near].tolist(), ids.slice(a, z - a).take(pa.array(place[near])).to_pylist(), strict=True):
                        firsts[row] = x
                    left = left[~near]
        if hashes:
            yield closed()

    return dealt.mapInArrow(meet, f"phash bigint, first {kind}").groupBy("phash").agg(F.min("first").alias("first"))


def led(classes: DataFrame, threshold: int, block: int = BLOCK) -> DataFrame:
    """(phash, leader) of classes (id, phash): greedy leaders by near hashes in id order, without a list of pairs.

    Classes are settled in blocks in id order. A block first meets the leaders of earlier blocks, in slices dealt to all tasks; what isn't near any of them is settled by the sequential rule in
    one task, which never has more than a block. What is shuffled is each class a few times and, per block, the leaders before it."""
    kind, n = dict(classes.dtypes)["id"], classes.count()
    blocks = max(1, -(-n // block))
    placed = kept(classes.select("id", "phash").repartitionByRange(blocks, "id", "phash").withColumn("block", F.spark_partition_id()))

    def settle(batches):
        whole = pa.Table.from_batches(list(batches))
        if whole.num_rows:
            ids, phash, first = (whole.column(c).combine_chunks() for c in range(3))
            open_ = np.flatnonzero(first.is_null().to_numpy(zero_copy_only=False))
            own = open_[in_order(phash.to_numpy()[open_].view(np.uint64), threshold)]
            place = np.full(len(ids), -1)
            place[open_] = own
            mine = ids.take(pa.array(place, mask=place < 0))
            yield pa.RecordBatch.from_arrays([ids, phash, pc.coalesce(first, mine), pa.array(place == np.arange(len(ids)))], names=["id", "phash", "leader", "leads"])

    done: list[DataFrame] = []
    for b in range(blocks):
        own = placed.where(F.col("block") == b).select("id", "phash")
        if done:
            found = first_near(own.select("phash"), reduce(DataFrame.unionByName, done).where("leads").select("id", "phash"), threshold, block)
            own = own.join(found, "phash", "left").select("id", "phash", "first")
        else:
            own = own.withColumn("first", F.lit(None).cast(kind))
        done.append(kept(own.repartition(1).sortWithinPartitions("id", "phash").mapInArrow(settle, f"id {kind}, phash bigint, leader {kind}, leads boolean")))
        if len(done) > ROUNDS:
            done = [kept(reduce(DataFrame.unionByName, done))]
    return reduce(DataFrame.unionByName, done).select("phash", "leader")


def greedy(files: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Greedy leaders of (id, phash) by near hashes: (id, leader). Equal hashes are settled as one class: the members of a class have the leader of its
    smallest id, since all are near the same items. Rows without a hash lead themselves."""
    files = kept(files.select("id", "phash"))
    found = led(kept(hash_classes(files)), threshold, block)
    return files.join(found, "phash", "left").select("id", F.coalesce("leader", "id").alias("leader"))


def exact_groups(files: DataFrame) -> DataFrame:
    """Groups of more than one file by pixels, or bytes where there are none: (group_key, first, n)."""
    key = F.coalesce(F.nullif("pixel_hash", F.lit("")), F.col("sha256"))
    return files.groupBy(key.alias("group_key")).agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")


def near_groups(files: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(leader, id) of groups around the first file not yet in a group; members of exact groups never join."""
    key = F.coalesce(F.nullif("pixel_hash", F.lit("")), F.col("sha256"))
    keyed = kept(files.select("id", key.alias("group_key"), "phash"))
    several = keyed.groupBy("group_key").count().where("count > 1").select("group_key")
    found = kept(greedy(keyed.join(several, "group_key", "left_anti"), threshold))
    large = found.groupBy("leader").count().where("count > 1").select("leader")
    return found.join(large, "leader", "left_semi").select("leader", "id")


def batch_plan(candidates: DataFrame, index: DataFrame, force: bool = False, threshold: int = THRESHOLD) -> DataFrame:
    """Action per candidate (id in batch order, path, sha256, pixel_hash, phash): unchanged, update, duplicate or insert.

    Known paths are unchanged or updates and never make others duplicates; the rest is looked up in the index, then against earlier
    inserts of the batch: first by bytes and pixels, then by near hashes of greedy leaders. ``force`` inserts or updates everything.
    """
    known = index.select(F.col("path").alias("known_path"), F.col("sha256").alias("known_sha"))
    rows = kept(candidates.select("id", "path", "sha256", "pixel_hash", "phash").join(known, candidates["path"] == known["known_path"], "left"))
    if force:
        return rows.select("id", F.when(F.col("known_path").isNotNull(), "update").otherwise("insert").alias("action"))
    old = rows.where("known_path is not null").select("id", F.when(F.col("known_sha") == F.col("sha256"), "unchanged").otherwise("update").alias("action"))
    new = rows.where("known_path is null").drop("known_path", "known_sha")
    hits = kept(lookup(new, index, threshold))
    in_index = hits.where("tier is not null").select("id", F.lit("duplicate").alias("action"))
    open_ = new.join(hits.where("tier is null").select("id"), "id", "left_semi")
    first_of = lambda key: open_.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.min("id").alias(f"first_{key}"))
    marked = open_.join(first_of("sha256"), "sha256", "left").join(first_of("pixel_hash"), "pixel_hash", "left")
    later = F.coalesce(F.col("first_sha256") < F.col("id"), F.lit(False)) | F.coalesce(F.col("first_pixel_hash") < F.col("id"), F.lit(False))
    copies = marked.where(later).select("id", F.lit("duplicate").alias("action"))
    led = greedy(marked.where(~later), threshold)
    rest = led.select("id", F.when(F.col("id") == F.col("leader"), "insert").otherwise("duplicate").alias("action"))
    return old.unionByName(in_index).unionByName(copies).unionByName(rest)


def ingest_decision(candidates: DataFrame, index: DataFrame, force: bool = False, threshold: int = THRESHOLD) -> DataFrame:
    """Status per single file, each against the index only: skipped, unchanged, updated, duplicate (with ``tier->asset``) or indexed."""
    known = index.select(F.col("path").alias("known_path"), F.col("sha256").alias("known_sha"))
    rows = candidates.join(known, candidates["path"] == known["known_path"], "left").join(lookup(candidates, index, threshold), "id", "left")
    status = F.when(F.col("skip"), "skipped")
    if not force:
        status = status.when(F.col("known_sha") == F.col("sha256"), "unchanged")
    status = status.when(F.col("known_path").isNotNull(), "updated")
    if not force:
        status = status.when(F.col("tier").isNotNull(), "duplicate")
    status = status.otherwise("indexed")
    detail = F.when(status == "duplicate", F.concat("tier", F.lit("->"), F.col("duplicate_of").cast("string"))).otherwise("")
    return rows.select("id", status.alias("status"), detail.alias("detail"))

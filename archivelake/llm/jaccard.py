"""N-gram Jaccard join with signature trees, and its connected components.

Sets are 64-bit hashes of a text's distinct shingles. Steps, all exact:

1. Rows with equal sets are one node (grouped by a 128-bit digest of the set).
2. Leaders: nodes that share one of their smallest hashes are compared with one leader each, so a group of
   thousands of near copies costs a few comparisons per member, not all its pairs. The leader is the node whose
   shingles are commonest on average, by counts in a table of fixed size over all shingles: within a group of edited
   copies that is one near their common original, which links with most of them. Verified links give first components.
3. Prefix filter: two sets of Jaccard similarity t or more share an element among their first
   n - ceil(t n) + 1 in any common order. The order puts rare elements first, by the same counts. Elements whose
   nodes are already in one component are settled.
4. The rest meets per element in signature trees: leaves hold a node's bitmap and size, inner nodes the OR and AND
   of their bitmaps and the size range. A dual traversal drops pairs of subtrees whose largest possible overlap is too
   small; a frequent element is dealt to many tasks as pairs of bounded chunks. A linked pair is always given at its
   first common element; it is left out where the elements before show that this one isn't the first, or where
   too few elements follow for the overlap it would need.
5. Surviving pairs of different components are verified on whole sets, and components are
   joined by contraction in rounds of stored tables.

Defined cases: null and empty texts have no shingle, link with nothing and are their own component; fewer words than a
shingle needs count as one shingle; repeated rows and rows sharing a doc_id with equal sets are one node; rows without doc_id
get the smallest doc_id linked to them, or null; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, grouped, hashed_words, inside, joined, map_batches, mapped, mix, prepared, signed, window_hashes

#: Count table: so many buckets of the hash space, in so many slices.
BUCKET_BITS, SLICES = 18, 16
BITS = 512
CHUNK = 512
LEAF = 16
#: Pairs of one text that are verified together.
MEMBERS = 256
NO_ID = 2**63 - 1


def shingle_sets(texts: list, width: int):
    """The sorted distinct shingle hashes of each text, with words in A-Z lower case."""
    for a, b in grouped(texts):
        h, counts = hashed_words(texts[a:b], lower=True)
        windows, (ok, owner) = window_hashes(h, width), inside(counts, width)
        ends = np.searchsorted(owner, np.arange(b - a + 1))
        values = windows[ok] if len(ok) else windows
        at = 0
        for i, n in enumerate(counts.tolist()):
            if n >= width:
                yield np.unique(values[ends[i] : ends[i + 1]])
            elif n:
                yield joined(window_hashes(h[at : at + n], n), np.array([n], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            at += n


def linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def least_overlap(a, b, percent: int):
    """The smallest intersection of linked sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


class Tree:
    """A balanced tree over rows sorted by size: OR and AND of bitmaps and the size range per node."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        self.sizes, self.bits = sizes[self.order], bits[self.order]
        self.levels = []
        low = np.arange(0, len(sizes), LEAF)
        high = np.minimum(low + LEAF, len(sizes))
        both = [np.array([f.reduce(self.bits[a:z], axis=0) for a, z in zip(low, high, strict=True)]) for f in (np.bitwise_or, np.bitwise_and)]
        level = (both[0], both[1], self.sizes[low], self.sizes[high - 1])
        self.levels.append(level)
        while len(level[2]) > 1:
            at = np.arange(0, len(level[2]), 2)
            last = np.minimum(at + 1, len(level[2]) - 1)
            level = (level[0][at] | level[0][last], level[1][at] & level[1][last], level[2][at], level[3][last])
            self.levels.append(level)

    def leaf(self, i: int) -> slice:
        return slice(i * LEAF, min((i + 1) * LEAF, len(self.sizes)))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def may_link(or_a, and_a, low_a, high_a, or_b, and_b, low_b, high_b, percent: int):
    """False if no row under a can link with one under b: too different in size, or too many bits of one that the other lacks."""
    fits = (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)
    # a row of size n lacks at least as many shingles in the other as bits; it may lack n - least_overlap, largest at its own
    # largest and the partner's smallest size
    missing_a, missing_b = popcount(and_a & ~or_b), popcount(and_b & ~or_a)
    fits &= missing_a <= high_a - least_overlap(high_a, np.maximum(low_b, -(-percent * high_a // 100)), percent) + (high_a - low_a)
    fits &= missing_b <= high_b - least_overlap(high_b, np.maximum(low_a, -(-percent * high_b // 100)), percent) + (high_b - low_b)
    return fits


def dual_traversal(x: Tree, y: Tree, percent: int, same: bool) -> list[tuple[int, int]]:
    """Row pairs (in the given order of rows) that no bound excludes."""
    found = []
    stack = [(len(x.levels) - 1, 0, len(y.levels) - 1, 0)]
    while stack:
        lx, i, ly, j = stack.pop()
        if same and lx == ly and i > j:
            continue
        a, b = x.levels[lx], y.levels[ly]
        if not may_link(a[0][i], a[1][i], a[2][i], a[3][i], b[0][j], b[1][j], b[2][j], b[3][j], percent):
            continue
        if lx == ly == 0:
            p, q = x.leaf(i), y.leaf(j)
            ok = may_link(x.bits[p, None], x.bits[p, None], x.sizes[p, None], x.sizes[p, None], y.bits[None, q], y.bits[None, q], y.sizes[None, q], y.sizes[None, q], percent)
            if same and i == j:
                ok &= np.triu(np.ones(ok.shape, bool), 1)
            found += [(int(x.order[p.start + r]), int(y.order[q.start + s])) for r, s in zip(*np.nonzero(ok), strict=True)]
        elif lx >= ly:
            stack += [(lx - 1, c, ly, j) if not same or lx > ly else (lx - 1, c, ly - 1, d) for c in (2 * i, 2 * i + 1) if c < len(x.levels[lx - 1][2]) for d in ((0,) if not same or lx > ly else (2 * j, 2 * j + 1)) if not same or lx > ly or d < len(y.levels[ly - 1][2])]
        else:
            stack += [(lx, i, ly - 1, d) for d in (2 * j, 2 * j + 1) if d < len(y.levels[ly - 1][2])]
    return found


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame | None:
    """(node, comp) for every node of the edges (a, b): contraction to smaller neighbours, in rounds of stored tables."""
    edges = scratch.write(edges.select("a", "b"), f"{name}-edges-0")
    mapping, k = None, 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = scratch.write(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("p")), f"{name}-parent-{k}")
        for step in range(2):
            up = parent.select(F.col("node").alias("p"), F.col("p").alias("q"))
            parent = scratch.write(parent.join(up, "p", "left").select("node", F.coalesce("q", "p").alias("p")), f"{name}-jump-{k}-{step}")
        up = parent.select(F.col("node").alias("comp"), "p")
        mapping = parent.select("node", F.col("p").alias("comp")) if mapping is None else mapping.join(up, "comp", "left").select("node", F.coalesce("p", "comp").alias("comp"))
        mapping = scratch.write(mapping, f"{name}-map-{k}")
        at = parent.select(F.col("node").alias("a"), F.col("p").alias("pa"))
        bt = parent.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(at, "a").join(bt, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        k += 1
        edges = scratch.write(moved, f"{name}-edges-{k}")
    return mapping


def members(docs: DataFrame, spark: SparkSession, width: int = 4, percent: int = 85, leaders: int = 8) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id, t (hash of its text), rid and comp, the component's node, which tells
    components without doc_ids apart (null without shingles)."""
    scratch = Scratch(spark, "jaccard", clean=True)
    rows = prepared(docs, "doc_id", "text").select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    fields = [("doc_id", pa.int64()), ("doc", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bottom", pa.list_(pa.int64())), ("slice", pa.int32()), ("counts", pa.list_(pa.int64()))]

    def sketch(batches):
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(4)]
            out = [[], [], [], []]
            for s in shingle_sets(cols[2], width):
                np.add.at(counts, (s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
                m = mix(s + np.uint64(0x5851F42D4C957F2D))
                values = (len(s), m.sum(), np.bitwise_xor.reduce(mix(m + np.uint64(1))) if len(s) else np.uint64(0), np.sort(np.partition(m, leaders - 1)[:leaders] if len(m) > leaders else m))
                out[0].append(int(values[0]))
                out[1].append(int(np.uint64(values[1]).view(np.int64)))
                out[2].append(int(np.uint64(values[2]).view(np.int64)))
                out[3].append(signed(values[3]).tolist())
            n = len(cols[0])
            yield pa.RecordBatch.from_arrays([pa.array(v, f[1]) for v, f in zip([cols[0], cols[1], cols[3], *out, [None] * n, [None] * n], fields, strict=True)], names=[f[0] for f in fields])
        if counts.any():
            part = counts.reshape(SLICES, -1)
            yield pa.RecordBatch.from_arrays([pa.array(v, f[1]) for v, f in zip([[None] * SLICES] * 7 + [list(range(SLICES)), part.tolist()], fields, strict=True)], names=[f[0] for f in fields])

    schema = "doc_id bigint, doc bigint, t bigint, n bigint, f1 bigint, f2 bigint, bottom array<bigint>, slice int, counts array<bigint>"
    made = scratch.write(mapped(rows, sketch, schema).withColumn("rid", F.monotonically_increasing_id()), "sketch")
    base = made.where("slice is null").drop("slice", "counts")
    groups = scratch.write(base.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("rid").alias("node"), F.min("doc").alias("first")), "groups")
    belongs = base.select("rid", "doc_id", "doc", "t", "n", "f1", "f2").join(groups, ["n", "f1", "f2"], "left").drop("f1", "f2")
    belongs = scratch.write(belongs, "belongs")
    nodes = scratch.write(base.select("rid", "bottom").join(belongs.where("rid = node"), "rid").select("node", "doc", "t", "n", "first", "bottom"), "nodes")

    table = order_table(made, spark)
    places = scratch.write(map_batches(rows.select("doc", "t", "text"), prefixes(table, width, percent), "doc bigint, t bigint, common double, prefix array<bigint>, bits binary"), "prefix")
    table.unpersist()
    scratch.drop("sketch", "groups")

    near = nodes.join(places.select("doc", "t", "common"), ["doc", "t"]).select("node", "n", "common", F.explode("bottom").alias("h"))
    lead = near.groupBy("h").agg(F.min(F.struct(-F.col("common"), "node", "n")).alias("lead"), F.count("*").alias("c")).where("c > 1").select("h", F.col("lead.node").alias("a"), F.col("lead.n").alias("ln"))
    lead = scratch.write(lead, "lead")
    pairs = near.join(lead, "h").where(f"node <> a and 100 * least(n, ln) >= {percent} * greatest(n, ln)").select("a", F.col("node").alias("b")).distinct()
    links = scratch.write(verified(pairs, nodes, rows, scratch, "lead", width, percent), "links-1")
    scratch.drop("lead", "lead-pairs", "lead-led")
    comp = components(links, scratch, "first")
    known = nodes.select("node", "n").join(comp, "node", "left").select("node", "n", F.coalesce("comp", "node").alias("comp")) if comp is not None else nodes.select("node", "n", F.col("node").alias("comp"))
    known = scratch.write(known, "known")

    own = nodes.select("node", "doc", "t").join(places, ["doc", "t"]).join(known, "node").select("node", "comp", "n", "prefix", "bits")
    own = scratch.write(own, "own")
    scratch.drop("prefix")
    each = own.select("node", "comp", F.explode("prefix").alias("h"))
    open_ = each.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("h", "c")
    open_ = scratch.write(open_, "open")
    # the open elements of each node, found on narrow rows; what else a traversal needs is joined by node: bits and size, the element's place in the
    # order and the two elements before it
    alive = each.select("node", "h").join(open_, "h").groupBy("node").agg(F.collect_list(F.struct("h", "c")).alias("hs"))
    alive = scratch.write(alive, "alive")
    scratch.drop("open")
    meet = alive.join(own, "node").select("node", "comp", "n", "bits", "prefix", F.inline("hs"))
    meet = meet.withColumn("at", (F.array_position("prefix", F.col("h")) - 1).cast("int"))
    meet = meet.select("h", "c", "node", "comp", "n", "bits", "at", F.get("prefix", F.col("at") - 1).alias("p1"), F.get("prefix", F.col("at") - 2).alias("p2"))
    meet = meet.withColumn("chunks", F.ceil(F.col("c") / CHUNK).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    meet = meet.select("h", "node", "comp", "n", "bits", "at", "p1", "p2", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    meet = meet.select("h", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "comp", "n", "bits", "at", "p1", "p2")
    meet = meet.repartition("h", "lo", "hi").sortWithinPartitions("h", "lo", "hi")
    pairs = mapped(meet, traversed(percent), "a bigint, b bigint").distinct()
    links2 = scratch.write(verified(pairs, nodes, rows, scratch, "tree", width, percent), "links-2")
    scratch.drop("own", "alive", "tree-pairs", "tree-led")
    # only contracted links are left to join: those of the second search between first components
    ca, cb = known.select(F.col("node").alias("a"), F.col("comp").alias("ca")), known.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    upper = components(links2.join(ca, "a").join(cb, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), scratch, "second")
    final = known.select("node", "comp")
    if upper is not None:
        final = final.join(upper.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    final = final.join(nodes.select("node", "first"), "node")
    smallest = final.groupBy("comp").agg(F.min("first").alias("component"), F.count("*").alias("c")).where("c > 1")
    smallest = scratch.write(smallest.select("comp", "component"), "smallest")
    final = scratch.write(final.join(smallest, "comp", "left").select("node", "comp", F.coalesce("component", "first").alias("component")), "final")
    scratch.keep_only("belongs", "final")
    out = belongs.join(final, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.nullif(F.coalesce("component", "doc"), F.lit(NO_ID)).alias("component_id"), "t", "rid", "comp")


def order_table(made: DataFrame, spark: SparkSession):
    """Counts of all shingles per bucket of the hash space: a table of fixed size, sent to all tasks."""
    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[s] = total.get(s, 0) + np.array(c, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], names=["slice", "counts"])

    sums = made.where("slice is not null").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(add, "slice int, counts array<bigint>")
    table = np.zeros((SLICES, (1 << BUCKET_BITS) // SLICES), np.int64)
    for r in sums.collect():
        table[r["slice"]] += np.array(r["counts"], np.int64)
    return spark.sparkContext.broadcast(table.ravel())


def prefixes(table, width: int, percent: int):
    def run(cols):
        out = {"doc": cols["doc"], "t": cols["t"], "common": [], "prefix": [], "bits": []}
        counts = table.value
        for s in shingle_sets(cols["text"], width):
            k = prefix_length(len(s), percent)
            rank = counts[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
            order = np.lexsort((s, rank))[:k]
            out["common"].append(float(np.log2(1 + rank).mean()) if len(s) else 0.0)
            out["prefix"].append(signed(s[order]).tolist())
            flags = np.zeros(BITS, bool)
            flags[(s & np.uint64(BITS - 1)).astype(np.int64)] = True
            out["bits"].append(np.packbits(flags).tobytes())
        return out

    return run


def traversed(percent: int):
    """Rows sorted by (h, lo, hi) to candidate pairs of different components."""
    def first_common(a, b) -> bool:
        """False if h can't be the first common element of a linked pair."""
        n, at, *before = a[3], *a[5:]
        m, bt, *other = b[3], *b[5:]
        if any(p is not None and p in other for p in before):
            return False
        return min(n - at, m - bt) >= least_overlap(n, m, percent)

    def pairs_of(rows: list[tuple], lo: int, hi: int) -> set[tuple[int, int]]:
        if lo == hi:
            rows = list({r[1]: r for r in rows}.values())
        parts = [rows, rows] if lo == hi else [[r for r in rows if r[0] == lo], [r for r in rows if r[0] == hi]]
        if not parts[0] or not parts[1] or len({r[2] for r in rows}) < 2:
            return set()
        trees = []
        for part in parts[:1] if lo == hi else parts:
            bits = np.frombuffer(b"".join(r[4] for r in part), np.uint64).reshape(len(part), -1)
            trees.append(Tree(np.array([r[3] for r in part], np.int64), bits))
        out = set()
        for i, j in dual_traversal(trees[0], trees[-1], percent, lo == hi):
            a, b = parts[0][i], parts[1][j]
            if a[2] != b[2] and first_common(a, b):
                out.add((min(a[1], b[1]), max(a[1], b[1])))
        return out

    def run(batches):
        key, rows = None, []
        for batch in batches:
            found: set[tuple[int, int]] = set()
            cols = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
            for h, lo, hi, *row in zip(*(cols[c] for c in ("h", "lo", "hi", "own", "node", "comp", "n", "bits", "at", "p1", "p2")), strict=True):
                if (h, lo, hi) != key:
                    if len(rows) > 1:
                        found |= pairs_of(rows, *key[1:])
                    key, rows = (h, lo, hi), []
                rows.append(row)
            yield batch_of(found)
        if len(rows) > 1:
            yield batch_of(pairs_of(rows, *key[1:]))

    def batch_of(pairs):
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in range(2)], names=["a", "b"])

    return run


def verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, scratch: Scratch, name: str, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link. Each text is fetched once and goes to the pairs it is in as b, or to those it leads as a: pairs
    are dealt by a, at most about MEMBERS of them together with one copy of the text of a."""
    pairs = scratch.write(pairs, f"{name}-pairs")
    led = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts"))
    led = scratch.write(led, f"{name}-led")
    members = pairs.join(led, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.lit(1).alias("kind"), "b")
    heads = led.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("a").alias("b"))
    needs = members.unionByName(heads).join(nodes.select("node", "doc", "t"), "node").select("doc", "t", "a", "salt", "kind", "b")
    texts = rows.select("doc", "t", "text").join(needs.select("doc", "t").distinct(), ["doc", "t"], "left_semi").dropDuplicates(["doc", "t"])
    dealt = texts.join(needs, ["doc", "t"]).select("a", "salt", "kind", "b", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")

    def check(batches):
        key, head = None, None
        for batch in batches:
            out: list[tuple[int, int]] = []
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for a, salt, kind, b, own in zip(*cols[:4], shingle_sets(cols[4], width), strict=True):
                if kind == 0:
                    key, head = (a, salt), own
                elif (a, salt) == key and linked(len(np.intersect1d(head, own, assume_unique=True)), len(head), len(own), percent):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in range(2)], names=["a", "b"])

    return mapped(dealt, check, "a bigint, b bigint")


def near_copies(docs: DataFrame, spark: SparkSession, width: int = 4, percent: int = 85) -> DataFrame:
    return members(docs, spark, width, percent).select("doc_id", "n_shingles", "component_id")


def first_of_group(docs: DataFrame, spark: SparkSession, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents with all their columns, one of each component: the row of the smallest doc_id (null last); texts
    that aren't linked each stay, under one doc_id or none; texts without shingles stay, rows repeated exactly become one."""
    scratch = Scratch(spark, "one-of-group", clean=True)
    found = scratch.write(members(docs, spark, width, percent), "members")
    keep = found.where("n_shingles > 0").groupBy("comp").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "t", "rid")).alias("k")).select("k.doc", "k.t")
    empty = found.where("n_shingles = 0").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "t")
    keep = scratch.write(keep.unionByName(empty).distinct(), "keep").select(F.col("doc").alias("_doc"), F.col("t").alias("_t"))
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce("doc_id", F.lit(NO_ID)).alias("_doc2"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t2"))
    out = rows.join(keep, (F.col("_doc2") == F.col("_doc")) & (F.col("_t2") == F.col("_t")), "left_semi")
    return out.dropDuplicates(["_doc2", "_t2"]).select("_row.*")

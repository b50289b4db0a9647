"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets: sources in code point order (null last) weigh ``weights`` in turn and share ``budget`` times all
words; a target stops at ``repeats`` times its source's size and the excess is shared again by weight. The words
to take are counted in equal blocks. Blocks go to sources by highest quotient (target / (2 k + 1)),
and those of a source to its shards in the same way by shard size. In a shard the documents stand in a seeded
order and their words form one stream of blocks; the quota is dealt as whole passes over all blocks
plus one more pass over a seeded choice of them. A document takes what its words' blocks are dealt.

One row per source and one per shard reach the driver. A shard holds at least ``shard_words`` words and there are at most
``most_shards`` plus one per source: shards grow before their number does, and a hot source is many shards. Equal rows lie in one
shard until they fill it; then they are numbered and dealt to shards in parts. Rows without words are in no shard.

Defined cases: a null text has size 0 and takes 0; repeated rows are separate rows with cuts of their own; an empty table gives an
empty result; a source without words has target 0; only doc_id, text and source are read by ``plan``.
"""

from __future__ import annotations

import heapq
from math import gcd

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Scratch, mapped, prepared, small_side


def targets(sizes: dict, weights: tuple = (5, 2, 1), budget: float = 1.5, repeats: float = 2.0) -> dict:
    """Words to take of each source: shares by weight, filled up to each source's cap."""
    order = sorted(sizes, key=key_order)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_, left = {}, list(order), budget * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > repeats * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = float(repeats * sizes[s])
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def key_order(key) -> tuple:
    """Strings by code point and numbers by value, null last."""
    return (key is None, key.encode("utf-8", "surrogatepass") if isinstance(key, str) else key or 0)


def apportion(votes: dict, seats: int, caps: dict) -> dict:
    """Sainte-Lague: each seat goes to the highest votes / (2 k + 1), ties to the smaller key; none beyond its cap.

    A divisor found by bisection gives nearly all seats at once. The rest are dealt one by one, and a last pass moves any seat whose quotient is
    below one that got none, so rounding in the divisor can't show.
    """
    keys = sorted(votes, key=key_order)
    v = np.array([votes[k] for k in keys], float)
    cap = np.where(v > 0, np.array([caps[k] for k in keys], np.int64), 0) if keys else np.zeros(0, np.int64)
    seats = min(seats, int(cap.sum()))

    def by(q: float) -> np.ndarray:
        return np.minimum(cap, np.floor((v / q + 1) / 2)).astype(np.int64)

    got = np.zeros(len(keys), np.int64)
    if seats:
        low, high = float(v[cap > 0].min()) / (2 * int(cap.max()) + 1), 2 * float(v.max())  # all seats and none
        for _ in range(100):
            q = (low * high) ** 0.5
            low, high = (low, q) if by(q).sum() <= seats else (q, high)
        got = by(high)
    given = lambda: np.where(got > 0, v / np.maximum(2 * got - 1, 1), np.inf)
    wanted = lambda: np.where(got < cap, v / (2 * got + 1), -1.0)
    heap = [(-x, i) for i, x in enumerate(wanted().tolist()) if x > 0]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < cap[i]:
            heapq.heappush(heap, (-float(v[i]) / (2 * int(got[i]) + 1), i))
    while seats:
        least, most = given(), wanted()
        i, j = len(keys) - 1 - int(np.argmin(least[::-1])), int(np.argmax(most))
        if i == j or (-most[j], j) > (-least[i], i):
            break
        got[i] -= 1
        got[j] += 1
    return dict(zip(keys, got.tolist(), strict=True))


def stride(n: int, seed: int) -> int:
    """A step that visits all of 0..n-1."""
    a = max(1, int(n * 0.6180339887) + seed % 7)
    while gcd(a, n) != 1:
        a += 1
    return a


def spread(rows: DataFrame, large: int, seed: int) -> DataFrame:
    """Rows (rid, source, doc_id, size, place, n_shards, shard) with equal ones that hold more than ``large`` words dealt anew in parts of about a quarter of that.

    Their numbers are made per stored partition, which the upper bits of ``rid`` name, and by how many lie in the partitions before it, so no task holds a group.
    At most one group per ``large`` words is that large, which bounds what is sent to all tasks.
    """
    rows = rows.withColumn("g", F.xxhash64("source", "place")).withColumn("part", F.shiftright("rid", 33))
    groups = rows.groupBy("g").agg(F.sum("size").alias("n")).where(F.col("n") > large).select("g")
    hot = rows.join(F.broadcast(groups), "g", "left_semi")
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = hot.groupBy("g", "part").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    hot = hot.withColumn("copy", F.row_number().over(Window.partitionBy("g", "part").orderBy("rid")) - 1).join(bases, ["g", "part"])
    dealt = F.expr(f"(base + copy) div greatest(1L, {large} div (4 * size))")
    hot = hot.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "place", dealt), F.col("n_shards"))).drop("copy", "base")
    return rows.join(F.broadcast(groups), "g", "left_anti").unionByName(hot).drop("g", "part")


def shard_sizes(rows: DataFrame) -> dict:
    """Words of each shard, by source."""
    found: dict = {}
    for r in rows.groupBy("source", "shard").agg(F.sum("size").alias("n")).collect():
        found.setdefault(r["source"], {})[r["shard"]] = r["n"]
    return found


def plan(docs: DataFrame, spark: SparkSession, weights: tuple = (5, 2, 1), budget: float = 1.5, seed: int = 17, block_words: int = 32, shard_words: int = 262_144, most_shards: int = 65_536) -> DataFrame:
    """Per document row: doc_id, size, source_size, target and taken."""
    scratch = Scratch(spark, "mixing")
    rows = prepared(docs, "doc_id", "source", "text").withColumn("rid", F.monotonically_increasing_id())
    return planned(rows, spark, scratch, weights, budget, seed, block_words, shard_words, most_shards).drop("rid", "start", "n_blocks", "passes", "extra", "step", "shift")


def planned(rows: DataFrame, spark: SparkSession, scratch: Scratch, weights: tuple, budget: float, seed: int, block_words: int, shard_words: int, most_shards: int) -> DataFrame:
    """The plan of rows (rid, doc_id, source, text), with rid and what a row's cuts are made from."""
    rows = rows.select(
        "rid", "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("place"),
    )
    rows = scratch.write(rows, "sizes")
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    if not sizes:
        return rows.select("rid", "doc_id", "size", F.col("size").alias("source_size"), F.lit(0.0).alias("target"), F.col("size").alias("taken"), F.lit(0).cast("bigint").alias("start"), *[F.lit(0).cast("bigint").alias(c) for c in ("n_blocks", "passes", "extra", "step", "shift")])
    goal = targets(sizes, weights, budget)
    large = max(shard_words, -(-sum(sizes.values()) // most_shards))
    shards_of = {s: max(1, -(-n // large)) for s, n in sizes.items()}
    sources = spark.createDataFrame([(s, sizes[s], goal[s], shards_of[s]) for s in sizes], "source string, source_size bigint, target double, n_shards bigint")
    rows = rows.join(small_side(sources, len(sizes)), rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "place"), F.col("n_shards")))
    empty, rows = rows.where("size = 0"), rows.where("size > 0")
    found = shard_sizes(rows)
    if any(n > 4 * large for v in found.values() for n in v.values()):
        rows = scratch.write(spread(rows, large, seed), "spread")
        found = shard_sizes(rows)
    blocks = {s: {k: -(-n // block_words) for k, n in v.items()} for s, v in found.items()}
    quota = apportion(goal, round(sum(goal.values()) / block_words), {s: 2 * sum(blocks.get(s, {}).values()) for s in goal})
    dealt = []
    for s, v in found.items():
        own = apportion(v, quota[s], {k: 2 * b for k, b in blocks[s].items()})
        for k, q in own.items():
            n = max(1, blocks[s][k])
            dealt.append((s, k, n, q // n, q % n, stride(n, seed + k), (seed * 7919 + k * 104729) % n))
    n_dealt = len(dealt)
    dealt = spark.createDataFrame(dealt, "source string, shard bigint, n_blocks bigint, passes bigint, extra bigint, step bigint, shift bigint")
    order = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(order), F.lit(0)))
    rows = rows.join(small_side(dealt, n_dealt), rows["source"].eqNullSafe(dealt["source"]) & (rows["shard"] == dealt["shard"])).drop(dealt["source"]).drop(dealt["shard"])
    each = (
        f"aggregate(sequence(start div {block_words}, (start + size - 1) div {block_words}), 0L, (acc, b) -> acc + "
        f"(least(start + size, (b + 1) * {block_words}) - greatest(start, b * {block_words})) * (passes + if((b * step + shift) % n_blocks < extra, 1L, 0L)))"
    )
    cuts = ["start", "n_blocks", "passes", "extra", "step", "shift"]
    none = empty.withColumns({c: F.lit(0).cast("bigint") for c in ["taken", *cuts]})
    columns = ["rid", "doc_id", "size", "source_size", "target", "taken", *cuts]
    return rows.withColumn("taken", F.expr(each)).select(columns).unionByName(none.select(columns))


def mixed(
    docs: DataFrame, spark: SparkSession, weights: tuple = (5, 2, 1), budget: float = 1.5, seed: int = 17, block_words: int = 32, shard_words: int = 262_144, most_shards: int = 65_536
) -> DataFrame:
    """The documents that the mix takes, with all their columns: one row for each pass, cut to the blocks of that pass.

    The rows are stored once with a number each, so that equal rows, and rows of one text under several ids or sources, get cuts of their own.
    """
    import re

    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_schema

    word = re.compile(WORD)
    scratch = Scratch(spark, "mixed")
    stored = scratch.write(docs.select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("_rid")), "rows")
    rows = stored.select(F.col("_rid").alias("rid"), "_row.doc_id", "_row.source", "_row.text")
    chosen = planned(rows, spark, scratch, weights, budget, seed, block_words, shard_words, most_shards).where("taken > 0")
    chosen = chosen.select(F.col("rid").alias("_rid"), F.struct("size", "taken", "start", "n_blocks", "passes", "extra", "step", "shift").alias("_mix"))
    rows = stored.join(chosen, "_rid").select("_row", "_mix")
    schema = docs.schema
    arrow = to_arrow_schema(schema)

    def cut(text: str, m: dict, least: int) -> str | None:
        at = [w.span() for w in word.finditer(text)]
        parts, first, last = [], m["start"] // block_words, (m["start"] + m["size"] - 1) // block_words
        for b in range(first, last + 1):
            if m["passes"] + ((b * m["step"] + m["shift"]) % m["n_blocks"] < m["extra"]) >= least:
                a, z = max(m["start"], b * block_words) - m["start"], min(m["start"] + m["size"], (b + 1) * block_words) - m["start"]
                if parts and parts[-1][1] == a:
                    parts[-1][1] = z
                else:
                    parts.append([a, z])
        if parts == [[0, m["size"]]]:
            return text
        return " ".join(text[at[a][0] : at[z - 1][1]] for a, z in parts) if parts else None

    def run(batches):
        for batch in batches:
            own, mixes = pa.RecordBatch.from_struct_array(batch.column(0)), batch.column(1).to_pylist()
            texts = own.column(own.schema.names.index("text")).to_pylist()
            take, out = [], []
            for i, (text, m) in enumerate(zip(texts, mixes, strict=True)):
                for least in range(1, m["passes"] + 2):
                    if (part := cut(text, m, least)) is not None and (least <= m["passes"] or m["extra"]):
                        take.append(i)
                        out.append(part)
            kept = own.take(pa.array(take, pa.int64()))
            columns = [kept.column(i) for i in range(len(schema.names))]
            columns[schema.names.index("text")] = pa.array(out, pa.string())
            if "n_chars" in schema.names:
                columns[schema.names.index("n_chars")] = pa.array([len(t) for t in out], pa.int64())
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return mapped(rows, run, schema)

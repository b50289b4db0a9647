"""Sharding by fixed virtual slots, with a stored, versioned map from slots to shards. Built-in functions only.

Records are hashed into ``slots`` virtual slots whose number never changes, the bytes and rows of each slot are added up, and a map of
a few thousand rows says which shard holds which slot. A record's shard is looked up in the map, so rebalancing edits
the map (a new version) and moves only the records of the slots it names.

1. A record is (doc_id, size, text_crc32, hash of the text); rows repeated exactly are one record with a number of copies. Texts
   are read once and never shuffled.
2. A slot of more than 1 / ``SHARE`` of a shard's even share of bytes or rows is cut in parts, by a hash of its records, so a hot text
   or id lies in many parts; copies of one record are cut in runs of that size before. Slots and parts together are at most
   ``slots + 2 * shards * SHARE`` pieces, however large the table is.
3. Law ``bytes``: slots by the text's hash, so equal texts lie together unless their slot is cut. The map is made by edits:
   pieces stay where the previous version has them while their shard has room, the others go, largest first, to the shard with the fewest bytes.
   Law ``key``: slots by the hash of doc_id; shard k of n takes each slot with a chance of 1/k from the shards before it, by a
   hash of slot and k, so doc_id and the number of shards decide, and one more shard takes rows only into itself.
4. A row's place in its shard is the number of rows of the pieces before (from the map) plus its place in its piece, by doc_id.

Defined cases: a null text has no bytes and lies in a slot of its own hash; a null doc_id is a key like others and comes first
in its piece; repeated rows are all kept and take places in a row; a single record larger than a shard's share makes its shard
larger; an empty table gives an empty result and a map without rows; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, prepared

SLOTS, SHARDS, SHARE = 8192, 16, 32
#: A shard keeps its pieces up to so much above its even share when the map is edited.
SLACK = 0.02
MAP = "slot int, part int, parts int, shard int, rows bigint, bytes bigint"
PIECE = ["slot", "part", "parts"]


class SlotMap:
    """Versions of a map (slot, part, parts, shard, rows, bytes) as Parquet folders at a path; a version is never changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs.exists(self._at):
            return []
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and self._fs.exists(done(f"{self.path}/{n}/_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame:
        """A version, the newest if none is named."""
        found = self.versions()
        at = (found[-1] if found else 0) if version is None else version
        if at not in found:
            raise ValueError(f"no version {at} of the map at {self.path}")
        return self.spark.read.schema(MAP).parquet(f"{self.path}/v{at:08d}")

    def write(self, rows: DataFrame) -> int:
        """Store a new version; fails if another writer has stored that number meanwhile."""
        at = (self.versions() or [0])[-1] + 1
        rows.write.mode("errorifexists").parquet(f"{self.path}/v{at:08d}")
        return at


def records(docs: DataFrame, law: str, slots: int) -> DataFrame:
    """(slot, doc_id, size, text_crc32, h, n): rows repeated exactly are one, n times."""
    rows = prepared(docs, "doc_id", "text").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("h"),
    )
    slot = F.pmod(F.col("h") if law == "bytes" else F.xxhash64("doc_id"), F.lit(slots)).cast("int").alias("slot")
    return rows.groupBy(slot, "doc_id", "size", "text_crc32", "h").agg(F.count("*").alias("n"))


def even_share(recs: DataFrame, shards: int) -> tuple[int, int]:
    """The most bytes and rows of a piece."""
    total = recs.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("size")).alias("bytes")).first()
    return max(1, (total["bytes"] or 0) // (shards * SHARE)), max(1, (total["rows"] or 0) // (shards * SHARE))


def runs(recs: DataFrame, most: tuple[int, int], old: DataFrame | None) -> DataFrame:
    """The records cut in runs of copies, each with the piece (slot, part, parts) that it lies in. A slot keeps its stored number of parts while half of what
    it needs is enough."""
    over = lambda x, y: F.ceil(F.col(x) / F.lit(y)).cast("int")
    slots = recs.groupBy("slot").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("size")).alias("bytes"))
    needed = F.greatest(over("bytes", most[0]), over("rows", most[1]), F.lit(1))
    slots = slots.select("slot", needed.alias("needed"))
    if old is not None:
        slots = slots.join(old.groupBy("slot").agg(F.max("parts").alias("parts")), "slot", "left")
        slots = slots.select("slot", F.when(F.col("parts") * 2 >= F.col("needed"), F.col("parts")).otherwise(F.col("needed")).alias("parts"))
    else:
        slots = slots.withColumnRenamed("needed", "parts")
    copies = F.greatest(F.lit(1), F.least(F.floor(F.lit(most[0]) / F.col("size")), F.lit(most[1]))).cast("bigint")
    each = recs.join(F.broadcast(slots), "slot").withColumn("most", copies)  # at most a row for each slot
    each = each.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / F.col("most")))))
    part = F.pmod(F.xxhash64("doc_id", "h", "run"), F.col("parts")).cast("int")
    return each.select("slot", part.alias("part"), "parts", "doc_id", "size", "text_crc32", "h", "run", F.least("most", F.col("n") - F.col("run") * F.col("most")).alias("copies"))


def placed(pieces: DataFrame, shards: int, slack: float = SLACK) -> DataFrame:
    """Pieces (slot, part, parts, rows, bytes, shard; null where new) as a map: what fits its shard stays, the rest goes, largest first, to the shard with the fewest bytes."""
    total = Window.partitionBy()  # over pieces, whose number has a fixed bound
    held = Window.partitionBy("shard").orderBy(F.desc("bytes"), *PIECE)
    own = pieces.withColumn("room", F.sum("bytes").over(total) * (1 + slack) / shards)
    stays = F.col("shard").isNotNull() & (F.col("shard") < shards) & (F.sum("bytes").over(held) <= F.col("room"))
    own = own.select(*PIECE, "rows", "bytes", F.when(stays, F.col("shard")).alias("shard"))
    entry = F.struct((-F.col("bytes")).alias("order"), *PIECE, "rows", "bytes", "shard")
    packed = own.agg(F.sort_array(F.collect_list(F.when(F.col("shard").isNull(), entry))).alias("open"), F.collect_list(F.when(F.col("shard").isNotNull(), entry)).alias("kept"))
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.aggregate("kept", F.lit(0).cast("bigint"), lambda a, e: a + F.when(e["shard"] == k, e["bytes"]).otherwise(F.lit(0))))

    def deal(state: Column, e: Column) -> Column:
        to = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        grown = F.transform(state["loads"], lambda x, k: F.when(k == to, x + e["bytes"]).otherwise(x))
        return F.struct(grown.alias("loads"), F.concat(state["to"], F.array(to)).alias("to"))

    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("to"))
    dealt = packed.withColumn("to", F.aggregate("open", start, deal, lambda s: s["to"]))
    moved = F.zip_with("open", "to", lambda e, k: e.withField("shard", k))
    return dealt.select(F.inline(F.concat("kept", moved))).select("slot", "part", "parts", "shard", "rows", "bytes")


def by_key(slot: Column, shards: int) -> Column:
    """The shard of a slot: shard k takes the slots whose hash with k is divisible by k + 1, from those before it."""
    taken = F.sequence(F.lit(1), F.lit(shards)) if shards > 1 else F.array(F.lit(1))
    return F.aggregate(taken, F.lit(0), lambda at, k: F.when(F.pmod(F.xxhash64(slot, k), k) == 0, k - 1).otherwise(at))


def sharded(docs: DataFrame, spark: SparkSession, shards: int = SHARDS, law: str = "bytes", slots: int = SLOTS, store: SlotMap | None = None) -> DataFrame:
    """A row per document with its shard and its place there. ``store`` keeps the map; if it holds one already, that one is edited."""
    if law not in ("bytes", "key") or shards < 1 or slots < shards:
        raise ValueError(f"law {law!r} with {shards} shards and {slots} slots")
    scratch = Scratch(spark, "shards")
    recs = scratch.write(records(docs, law, slots), "records")
    most = even_share(recs, shards)
    store = store or SlotMap(spark, f"{scratch.path}/map")
    old = store.read() if store.versions() else None
    each = runs(recs, most, old)
    pieces = each.groupBy(*PIECE).agg(F.sum("copies").alias("rows"), F.sum(F.col("copies") * F.col("size")).alias("bytes"))
    if law == "key":
        made = pieces.select(*PIECE, by_key(F.col("slot"), shards).alias("shard"), "rows", "bytes")
    elif old is None:
        made = placed(pieces.withColumn("shard", F.lit(None).cast("int")), shards)
    else:
        made = placed(pieces.join(old.select(*PIECE, "shard"), PIECE, "left"), shards)
    version = store.write(made.coalesce(1))

    table = store.read(version)
    before = Window.partitionBy("shard").orderBy("slot", "part")
    table = table.withColumn("offset", F.sum("rows").over(before) - F.col("rows")).select(*PIECE, "shard", "offset")
    ordered = Window.partitionBy(*PIECE).orderBy("doc_id", "size", "text_crc32", "h", "run")
    own = each.withColumn("first", F.sum("copies").over(ordered) - F.col("copies")).join(F.broadcast(table), PIECE)  # a row for each piece
    begin = F.col("offset") + F.col("first")
    grown = by_key(F.col("slot"), shards + 1) if law == "key" else F.lit(None)
    # a step of its own: beside the new column "slot" the name inside the lambda would mean that one
    own = own.withColumns({"place": F.explode(F.sequence(begin, begin + F.col("copies") - 1)), "grown_shard": grown.cast("int")})
    return own.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", F.col("place").alias("slot"), "grown_shard", F.col("slot").alias("virtual_slot"), F.col("part").alias("slot_part"))

"""Sharding by fixed virtual slots.

Every document hashes (by doc_id) into one of thousands of slots; bytes per slot are aggregated;
a versioned map sends slots to shards and is edited, slot by slot, until no move brings the
shards' bytes closer. Only the map moves when shards fill up or are added: documents never
change their slot. The law kept is `bytes`.

A slot that holds far more than its share (one doc_id repeated over and over) is dealt out again
into parts of its own by row. A document's place in its shard is its place in its slot plus the
rows of the slots before it, so no task ever orders a whole shard.

Size is the UTF-8 bytes of the text plus 8; a null text counts 8 and has no CRC. Null doc_ids
hash like any value, equal rows each get a place, an empty table gives no rows. Other columns
are kept by `sharded` and ignored by the query. Only DataFrame functions run on the executors;
the driver sees one row per slot.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import packed, settle, table, unpacked

SLOTS = 8192
PARTS = 64


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of bounded size from the driver, as one literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


class SlotMap:
    """A version of the map from slots to shards."""

    def __init__(self, shards: int, shard_of: list[int], version: int = 0):
        self.shards, self.shard_of, self.version = shards, shard_of, version

    @classmethod
    def even(cls, shards: int, slots: int) -> SlotMap:
        return cls(shards, [i % shards for i in range(slots)])

    def rebalanced(self, size: list[int], shards: int | None = None) -> SlotMap:
        """The next version: slots move from the fullest to the emptiest shard, each time the one that best evens the two out."""
        shards = shards or self.shards
        of = list(self.shard_of)
        own: list[list[int]] = [[] for _ in range(shards)]
        for slot, shard in enumerate(of):
            if shard >= shards:  # a shard that is gone
                shard = slot % shards
            own[shard].append(slot)
        load = [sum(size[s] for s in x) for x in own]
        for _ in range(8 * len(of)):
            high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
            gap = load[high] - load[low]
            best = min((s for s in own[high] if 0 < size[s] < gap), key=lambda s: (abs(gap - 2 * size[s]), s), default=None)
            if best is None or abs(gap - 2 * size[best]) >= gap:
                break
            own[high].remove(best)
            own[low].append(best)
            load[high] -= size[best]
            load[low] += size[best]
        for shard, slots in enumerate(own):
            for s in slots:
                of[s] = shard
        return SlotMap(shards, of, self.version + 1)

    def rows(self) -> list[dict]:
        return [{"version": self.version, "slot": s, "shard": x} for s, x in enumerate(self.shard_of)]

    def stored(self, spark: SparkSession, path: str | None = None) -> DataFrame:
        """Written as a table, of its own version: at path, or in the shared folder."""
        df = small_table(spark, self.rows(), "version int, slot int, shard int")
        if path is None:
            return settle(df, f"slot-map-v{self.version}")
        df.write.mode("overwrite").parquet(f"{path}/version={self.version}")
        return spark.read.parquet(f"{path}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{path}/version={version}").select("slot", "shard").orderBy("slot").collect()
        return cls(max(r.shard for r in rows) + 1, [r.shard for r in rows], version)


def slot_of(slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.lit("slot"), F.col("doc_id")), F.lit(slots)).cast("int")


def size_of() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8


def split(df: DataFrame, counts: list, slots: int) -> tuple[DataFrame, int]:
    """Slots with over 8 times the mean rows and over 4096 are dealt by row into PARTS slots each, appended after the others."""
    total = sum(r.n for r in counts)
    hot = sorted(r.s for r in counts if r.n > max(4096, 8 * total / slots))
    if not hot:
        return df, slots
    first = F.lit(slots) + F.lit(PARTS) * (F.array_position(F.array(*map(F.lit, hot)), F.col("_slot")) - 1)
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(PARTS))
    return df.withColumn("_slot", F.when(F.col("_slot").isin(hot), first + part).otherwise(F.col("_slot")).cast("int")), slots + PARTS * len(hot)


def sharded(rows: DataFrame, shards: int = 24, slots: int = SLOTS, was: SlotMap | None = None) -> tuple[DataFrame, SlotMap]:
    """Rows (with doc_id and _size) with `_slot` (virtual slot) and `shard`, and the map used: `was`, or an even one, edited for these rows."""
    spark = rows.sparkSession
    df = rows.withColumn("_slot", slot_of(slots))
    measure = lambda x: x.groupBy(F.col("_slot").alias("s")).agg(F.sum("_size").alias("b"), F.count("*").alias("n")).collect()
    counts = measure(df)
    df, wide = split(df, counts, slots)
    if wide > slots:
        df = settle(df, "slots")
        counts = measure(df)
    size = [0] * wide
    for r in counts:
        size[r.s] = r.b
    start = was or SlotMap.even(shards, wide)
    start.shard_of = start.shard_of + [i % shards for i in range(len(start.shard_of), wide)]
    edited = start.rebalanced(size, shards)
    where = edited.stored(spark).select(F.col("slot").alias("_slot"), "shard")
    return df.join(F.broadcast(where), "_slot"), edited


def placed(df: DataFrame, *order: str) -> DataFrame:
    """`slot`: the place in the shard, gapless from 0: rows of the virtual slots before, plus the place in its own."""
    counts = df.groupBy("shard", "_slot").agg(F.count("*").alias("_n"))  # a row per slot
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_slot", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_slot").orderBy(*order)) - 1
    return df.withColumn("_own", own).join(F.broadcast(offsets), "_slot").withColumn("slot", (F.col("_before") + F.col("_own")).cast("long")).drop("_own", "_before")


def placed_documents(documents: DataFrame, shards: int = 24) -> DataFrame:
    """documents with size, shard and slot; columns of these names are replaced."""
    df, _ = sharded(packed(documents, "doc_id", size_of().alias("_size")), shards)
    return placed(df, "doc_id").select(*unpacked(documents.columns, "size", "shard", "slot"), F.col("_size").alias("size"), "shard", "slot")


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rows = settle(documents.select("doc_id", size_of().alias("_size"), F.crc32("text").alias("text_crc32")), "sizes")
    df, _ = sharded(rows, 24)
    return placed(df, "doc_id", "text_crc32").select("doc_id", F.col("_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

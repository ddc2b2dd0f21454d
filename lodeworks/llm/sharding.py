"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into ``slots`` virtual slots once and for all; what changes is the map
from slots to shards. Rebalancing edits the map by moving or exchanging single slots between
the fullest and the emptiest shard, each edit is a new version, and all versions stay.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.llm.common import new_path, stored

#: Rows of a slot numbered in one task, on average.
BUCKET_ROWS = 500_000


@dataclass(frozen=True)
class SlotMap:
    """``shard_of[slot]`` for every virtual slot."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @classmethod
    def first(cls, slots: int, shards: int) -> "SlotMap":
        return cls(0, shards, tuple(s % shards for s in range(slots)))

    def rebalanced(self, sizes: np.ndarray, tolerance: float = 1e-4) -> "SlotMap":
        """The next version, edited until fullest and emptiest shard differ by ``tolerance`` of
        the mean, or no single move or exchange brings them nearer."""
        at = np.array(self.shard_of)
        load = np.bincount(at, sizes, self.shards)
        while True:
            full, bare = int(load.argmax()), int(load.argmin())
            gap = load[full] - load[bare]
            if gap <= tolerance * load.mean():
                break
            give = np.flatnonzero((at == full) & (sizes > 0))
            take = np.flatnonzero(at == bare)
            back = np.concatenate(([0], sizes[take]))  # 0: nothing comes back
            order = np.argsort(back, kind="stable")
            # for each slot given, what should come back for the gap to close
            near = np.searchsorted(back[order], sizes[give] - gap / 2)
            near = np.clip(np.stack((near - 1, near)), 0, len(back) - 1)
            moved = sizes[give] - back[order][near]
            left = np.abs(gap - 2 * moved)
            side, best = np.unravel_index(left.argmin(), left.shape)
            if not 0 < moved[side, best] < gap:
                break
            other = order[near[side, best]]
            at[give[best]] = bare
            if other:
                at[take[other - 1]] = full
            load[full] -= moved[side, best]
            load[bare] += moved[side, best]
        return SlotMap(self.version + 1, self.shards, tuple(at.tolist()))

    def grown(self, sizes: np.ndarray) -> "SlotMap":
        """The next version with one more shard, which takes slots from the fullest ones; no other slot moves."""
        at = np.array(self.shard_of)
        load = np.bincount(at, sizes, self.shards)
        fair, taken = load.sum() / (self.shards + 1), 0.0
        for slot in np.argsort(-sizes, kind="stable"):
            if taken + sizes[slot] <= fair and load[at[slot]] - sizes[slot] >= 0.98 * fair:
                load[at[slot]] -= sizes[slot]
                taken += sizes[slot]
                at[slot] = self.shards
        return SlotMap(self.version + 1, self.shards + 1, tuple(at.tolist()))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(s, k) for s, k in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "virtual_slot int, shard int").coalesce(1)


class SlotMapStore:
    """All versions of a map, one folder each, in shared storage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, slot_map: SlotMap) -> SlotMap:
        """Add a version; an existing one is never overwritten."""
        slot_map.table(self.spark).withColumn("shards", F.lit(slot_map.shards)).write.parquet(f"{self.path}/version={slot_map.version}")
        return slot_map

    def load(self, version: int | None = None) -> SlotMap:
        """A version, the latest if none is named."""
        rows = self.spark.read.parquet(self.path)
        if version is None:
            version = rows.agg(F.max("version")).first()[0]
        found = rows.where(F.col("version") == version).orderBy("virtual_slot").collect()  # as many as slots
        return SlotMap(version, found[0].shards, tuple(r.shard for r in found))


@dataclass(frozen=True)
class Sharded:
    """Rows (doc_id, size, text_crc32, virtual_slot, shard, slot) and the map they follow."""

    rows: DataFrame
    slot_map: SlotMap
    sizes: np.ndarray
    store: SlotMapStore


def shard(docs: DataFrame, shards: int = 16, slots: int = 4096, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> Sharded:
    """Shards of near equal bytes.

    ``size``: UTF-8 bytes of the text (null: none) plus 1; ``slot``: the row's number in its shard,
    from 0 without gaps, by virtual slot, id and text. A record's virtual slot follows from its
    id and text, so copies under different ids spread over all shards. Repeated rows
    share a slot, but if together they hold more than a slot's mean, they spread over as many slots as that takes.
    Empty tables give no rows and an unedited map; further columns aren't read.
    """
    text = F.col(text_col).cast("string")
    doc_id = F.col(id_col).cast("long")
    crc = F.coalesce(F.crc32(text.cast("binary")), F.lit(0))
    own = docs.select(doc_id.alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1).cast("long")).alias("size"), crc.alias("text_crc32"))
    own = stored(own.withColumn("row", F.monotonically_increasing_id()), "records")  # the row numbers are fixed from here on
    mean = (own.agg(F.sum("size")).first()[0] or 0) / slots
    record = ["doc_id", "text_crc32", "size"]
    heavy = own.groupBy(*record).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("n") * F.col("size") > mean))
    heavy = F.broadcast(heavy.select(*(F.col(c).alias(f"_{c}") for c in record), F.ceil(F.col("n") * F.col("size") / max(mean, 1)).alias("pieces")))  # no more than slots
    own = own.join(heavy, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_crc32") == F.col("_text_crc32")) & (F.col("size") == F.col("_size")), "left")
    piece = F.pmod(F.xxhash64("row"), F.coalesce("pieces", F.lit(1)))
    own = own.select("doc_id", "size", "text_crc32", "row", F.pmod(F.xxhash64("doc_id", "text_crc32", piece), F.lit(slots)).cast("int").alias("virtual_slot"))
    own = stored(own, "slotted")
    found = own.groupBy("virtual_slot").agg(F.sum("size"), F.count(F.lit(1))).collect()  # one row for each slot at most
    sizes = np.zeros(slots)
    for s, size, _ in found:
        sizes[s] = size
    store = SlotMapStore(docs.sparkSession, path or new_path(docs.sparkSession, "slot_map"))
    slot_map = store.save(SlotMap.first(slots, shards))
    if found:
        slot_map = store.save(slot_map.rebalanced(sizes))
    buckets = 1 + int(max((n for *_, n in found), default=0)) // BUCKET_ROWS
    placed = own.withColumn("bucket", F.pmod(F.hash("row"), F.lit(buckets))).join(F.broadcast(slot_map.table(docs.sparkSession)), "virtual_slot")
    inner = Window.partitionBy("virtual_slot", "bucket").orderBy("doc_id", "text_crc32", "row")
    before = placed.groupBy("shard", "virtual_slot", "bucket").agg(F.count(F.lit(1)).alias("n"))
    in_shard = Window.partitionBy("shard").orderBy("virtual_slot", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("virtual_slot", "bucket", F.coalesce(F.sum("n").over(in_shard), F.lit(0)).alias("base"))
    numbered = placed.withColumn("at", F.row_number().over(inner)).join(before, ["virtual_slot", "bucket"])
    rows = numbered.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("base") + F.col("at") - 1).alias("slot"))
    return Sharded(rows, slot_map, sizes, store)

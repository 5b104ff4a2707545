"""Shards by fixed virtual slots.

Records hash into a fixed number of slots, far more than there are shards.  Bytes and rows
are summed for each slot, and a small versioned map says which shard holds a slot.  A
rebalance or another shard never rehashes records: it edits the map, as few slots as it
can, and appends the edited map as the next version.

Defined results: a null text has no bytes and the checksum of an empty text; a null id
hashes like any other value; equal rows get places of their own; an empty table gives an
empty result with a valid map; further columns stay out of the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Workspace

SLOTS = 4096
ROW_BYTES = 8


def initial_map(slots: int, shards: int) -> np.ndarray:
    """Version 1: slots dealt to the shards in turn."""
    return np.arange(slots) % shards


def rebalance(held: np.ndarray, sizes: np.ndarray, shards: int) -> np.ndarray:
    """Edit the map ``held`` until the shards' bytes are near equal.

    Shards above the mean give up their smallest slots that bring them down to it; those
    slots go, largest first, to the shard with the least.  Then pairs of slots are swapped
    between the fullest and the emptiest shard while that narrows the difference.
    """
    held = held.copy()
    load = np.bincount(held, sizes, shards).astype(np.int64)
    mean = sizes.sum() / shards
    loose: list[int] = []
    for shard in range(shards):
        own = np.flatnonzero(held == shard)
        for slot in own[np.argsort(sizes[own], kind="stable")]:
            if load[shard] <= mean:
                break
            loose.append(int(slot))
            load[shard] -= sizes[slot]
    for slot in sorted(loose, key=lambda s: (-sizes[s], s)):
        shard = int(np.argmin(load))
        held[slot] = shard
        load[shard] += sizes[slot]
    for _ in range(50 * shards):
        high, low = int(np.argmax(load)), int(np.argmin(load))
        gap = int(load[high] - load[low])
        a = np.flatnonzero(held == high)
        b = np.append(np.flatnonzero(held == low), -1)  # -1: a move without a return
        moved = sizes[a][:, None] - np.where(b < 0, 0, sizes[b])[None, :]
        moved = np.where((moved > 0) & (moved < gap), np.abs(2 * moved - gap), gap)
        i, j = np.unravel_index(np.argmin(moved), moved.shape)
        if moved[i, j] >= gap:
            break
        shift = int(sizes[a[i]] - (sizes[b[j]] if b[j] >= 0 else 0))
        held[a[i]] = low
        if b[j] >= 0:
            held[b[j]] = high
        load[high] -= shift
        load[low] += shift
    return held


def grow(held: np.ndarray, sizes: np.ndarray, shards: int) -> np.ndarray:
    """The map for one more shard: slots move into the new one only, from the fullest shards."""
    held = held.copy()
    load = np.append(np.bincount(held, sizes, shards), 0).astype(np.int64)
    goal = sizes.sum() / (shards + 1)
    for slot in np.argsort(-sizes, kind="stable"):
        shard = held[slot]
        if load[shards] + sizes[slot] <= goal and load[shard] - sizes[slot] >= goal * 0.98:
            held[slot] = shards
            load[shard] -= sizes[slot]
            load[shards] += sizes[slot]
    return held


class SlotMap:
    """A slot-to-shard map below a path, of which every version is a small table of a row a slot.

    Versions are appended and never overwritten; one at a time edits a map.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        whole = [n for n in found if n.startswith("version=") and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n.removeprefix("version=")) for n in whole)

    def table(self, version: int | None = None) -> DataFrame:
        """(slot, shard, shards, bytes, n_rows, version) of one version, by default the latest."""
        version = version or self.versions()[-1]
        return self.spark.read.parquet(f"{self.path}/version={version}").withColumn("version", F.lit(version))

    def load(self) -> tuple[int, np.ndarray]:
        """Number of shards, and each slot's shard, of the latest version."""
        rows = self.table().select("slot", "shard", "shards").toArrow().sort_by("slot")
        return rows.column("shards")[0].as_py(), rows.column("shard").to_numpy()

    def append(self, shards: int, held: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> int:
        version = (self.versions() or [0])[-1] + 1
        slots = np.arange(len(held), dtype=np.int32)
        columns = {"slot": slots, "shard": held.astype(np.int32), "shards": np.full_like(slots, shards), "bytes": sizes, "n_rows": rows}
        self.spark.createDataFrame(pa.table(columns)).coalesce(1).write.parquet(f"{self.path}/version={version}")
        return version

    def edit(self, shards: int, sizes: np.ndarray, rows: np.ndarray) -> int:
        """The version for these sizes: the latest as it is, or grown to ``shards`` and rebalanced as the next one."""
        if not self.versions():
            self.append(shards, initial_map(len(sizes), shards), sizes, rows)
        before, held = self.load()
        if before > shards or len(held) != len(sizes):
            raise ValueError(f"the map has {before} shards and {len(held)} slots, not {shards} and {len(sizes)}")
        edited = held
        for k in range(before, shards):
            edited = grow(edited, sizes, k)
        edited = rebalance(edited, sizes, shards)
        changed = before != shards or (edited != held).any()
        return self.append(shards, edited, sizes, rows) if changed else self.versions()[-1]


def keyed(docs: DataFrame, slots: int) -> DataFrame:
    """Id, size, checksum and virtual slot of each record; the text itself goes no further."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("vslot", F.pmod(F.xxhash64(F.coalesce("doc_id", F.col("text_crc32"))), F.lit(slots)).cast("int"))


def shard(docs: DataFrame, shards: int, slots: int = SLOTS, path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Records with their virtual slot, shard and place in the shard, and the versioned map.

    The map is the one below ``path``, whose latest version is loaded and edited for these
    records; without a path it is a new one of this run.

    The sums a slot and the map have ``slots`` rows at any input size; the map is joined by
    broadcast, and a place is the slot's first place plus the rank within the slot, so that
    numbering needs no task larger than a slot.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "sharding")
    records = work.table(keyed(docs, slots), "records")
    sums = records.groupBy("vslot").agg(F.sum("size"), F.count("*")).collect()
    sizes, rows = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for slot, size, n in sums:
        sizes[slot], rows[slot] = size, n
    slot_map = SlotMap(spark, path or f"{work.root}/map")
    stored = slot_map.table(slot_map.edit(shards, sizes, rows))
    first = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    counted = records.groupBy(F.col("vslot").alias("slot")).agg(F.count("*").alias("rows_now"))
    places = stored.join(F.broadcast(counted), "slot", "left").select(
        F.col("slot").alias("vslot"), "shard", F.coalesce(F.sum("rows_now").over(first), F.lit(0)).alias("first")
    )
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    placed = (
        records.withColumn("rank", rank)
        .join(F.broadcast(places), "vslot")
        .select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("first") + F.col("rank") - 1).alias("slot"))
    )
    return placed, slot_map

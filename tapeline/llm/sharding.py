"""Sharding by best-fit-decreasing bin packing: groups of equal texts stay together.

Groups enter by falling size; each goes to the bin of the least remaining capacity that holds it, found in a balanced
tree. Of fixed capacities the least is searched that needs no more than the given shards, so that their sizes are
nearly equal. A group that is larger than an equal share has a shard by itself, and the rest share the others.

Only sizes are packed, on the driver, and their number is bounded whatever the data hold: groups under one part in GRAIN
of a shard are first bundled, within the tasks that hold them, to items of that size, so that there are at most 2 * GRAIN
items for each shard and one for each partition. Rows of the larger groups, of which there are no more than
GRAIN for each shard, find their shard by a broadcast of that bound; rows of the others by a shuffled join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.llm.shared import written

#: An item of the packing is at least this part of a shard, unless it is the last of its partition.
GRAIN = 500
#: The capacity is searched to one part in so many of an equal share.
CLOSE = 10_000


class Balanced:
    """A set of keys in an AVL tree; nodes are lists of key, left, right, height."""

    def __init__(self) -> None:
        self.root: list | None = None

    @staticmethod
    def _height(node: list | None) -> int:
        return node[3] if node else 0

    def _level(self, node: list) -> list:
        """The node with its height set, turned where its sides differ by two."""
        tilt = self._height(node[1]) - self._height(node[2])
        if abs(tilt) > 1:
            side, other = (1, 2) if tilt > 1 else (2, 1)
            child = node[side]
            if self._height(child[other]) > self._height(child[side]):
                node[side] = child = self._turned(child, other, side)
            return self._turned(node, side, other)
        node[3] = 1 + max(self._height(node[1]), self._height(node[2]))
        return node

    def _turned(self, node: list, side: int, other: int) -> list:
        up = node[side]
        node[side], up[other] = up[other], node
        for x in (node, up):
            x[3] = 1 + max(self._height(x[1]), self._height(x[2]))
        return up

    def add(self, key: tuple) -> None:
        def put(node: list | None) -> list:
            if node is None:
                return [key, None, None, 1]
            side = 1 if key < node[0] else 2
            node[side] = put(node[side])
            return self._level(node)

        self.root = put(self.root)

    def remove(self, key: tuple) -> None:
        def cut(node: list, key: tuple) -> list | None:
            if key == node[0]:
                if node[1] is None or node[2] is None:
                    return node[1] or node[2]
                least = node[2]
                while least[1]:
                    least = least[1]
                node[0] = least[0]
                node[2] = cut(node[2], least[0])
            else:
                side = 1 if key < node[0] else 2
                node[side] = cut(node[side], key)
            return self._level(node)

        self.root = cut(self.root, key)

    def at_least(self, key: tuple) -> tuple | None:
        """The smallest key that is not below this one."""
        node, found = self.root, None
        while node:
            if node[0] < key:
                node = node[2]
            else:
                node, found = node[1], node[0]
        return found


def best_fit(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each size, sizes falling and none above the capacity; None as soon as more than `most` bins are
    needed. Of bins with the same room the first takes it."""
    tree, bins, out = Balanced(), 0, []
    for size in sizes:
        found = tree.at_least((size, -1))
        if found is None:
            if bins == most:
                return None
            found = (capacity, bins)
            bins += 1
        else:
            tree.remove(found)
        out.append(found[1])
        tree.add((found[0] - size, found[1]))
    return out


def packed(sizes: list[int], shards: int) -> list[int]:
    """The shard of each size, sizes falling: best fit by the least capacity that needs no more than `shards` bins.

    While the next size is not below an equal share of what is left, it has a shard by itself."""
    alone, rest = 0, sum(sizes)
    while alone < len(sizes) and shards - alone > 1 and sizes[alone] * (shards - alone) >= rest:
        rest -= sizes[alone]
        alone += 1
    others, bins = sizes[alone:], shards - alone
    if not others:
        return list(range(alone))
    low, high = max(others[0], -(-rest // bins)), 2 * rest // bins + others[0]
    while high - low > rest // bins // CLOSE:
        middle = (low + high) // 2
        if best_fit(others, middle, bins) is None:
            low = middle + 1
        else:
            high = middle
    # with 2 / bins of the rest and one size more, `bins` open ones would hold more than there is: it always fits
    return [*range(alone), *(alone + b for b in best_fit(others, high))]


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, size (bytes of the text and 8), text_crc32 and key, 128 bits of the text; a null text is an empty one."""
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text)).alias("key"))


def items(groups: DataFrame, least: int) -> DataFrame:
    """key, bytes, item: groups of `least` bytes or more are items of their own, others share one until it has that
    much. Partitions are sorted by key and number their own items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, used, filled, bundle = TaskContext.get().partitionId() << 32, 0, 0, None
        for batch in batches:
            out = []
            for size in batch.column("bytes").to_numpy().tolist():
                if size >= least:
                    out.append(part + used)
                    used += 1
                    continue
                if bundle is None:
                    bundle, filled, used = part + used, 0, used + 1
                out.append(bundle)
                filled += size
                if filled >= least:
                    bundle = None
            yield pa.record_batch([batch.column("key"), batch.column("bytes"), pa.array(out, pa.int64())], ["key", "bytes", "item"])

    return groups.sortWithinPartitions("key").mapInArrow(run, "key binary, bytes long, item long")


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with `slot`, without gaps from 0 within each shard: each task counts its own rows, sorted by shard,
    doc_id and key, and those of earlier partitions come from prefix sums over a row for each partition and shard."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, before = TaskContext.get().partitionId(), None, 0
        for batch in filter(len, batches):
            shard = batch.column("shard").to_numpy()
            start = np.flatnonzero(np.diff(shard, prepend=-1 if last is None else last))
            place = np.arange(len(shard)) + before
            for a in start:
                place[a:] = np.arange(len(shard) - a)
            last, before = int(shard[-1]), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(shard), part, np.int32)), pa.array(place)], [*batch.schema.names, "part", "place"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = written(rows.sortWithinPartitions("shard", "doc_id", "key").mapInArrow(run, f"{schema}, part int, place long"), "shards")
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("many"))
    base = counts.select("shard", "part", F.coalesce(F.sum("many").over(earlier), F.lit(0)).alias("base"))
    return placed.join(F.broadcast(base), ["shard", "part"]).select(*names, (F.col("base") + F.col("place")).alias("slot"))


def sharded(documents: DataFrame, shards: int = 24, grain: int = GRAIN) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of documents: sizes of shards are nearly equal and equal texts
    stay together. Rows without doc_id are rows like others; no documents give no rows."""
    spark = documents.sparkSession
    rows = written(sized(documents), "shard-rows")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    least = (groups.agg(F.sum("bytes")).first()[0] or 0) // (shards * grain) + 1
    group_items = written(items(groups, least), "shard-items")
    sizes = group_items.groupBy("item").agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "item").toPandas()
    placed = sizes.assign(shard=np.array(packed(sizes["bytes"].tolist(), shards), np.int32))[["item", "shard"]]
    shard_of = F.broadcast(spark.createDataFrame(placed, "item long, shard int"))
    found = group_items.join(shard_of, "item").select("key", "bytes", "shard")
    large = found.where(F.col("bytes") >= least).select("key", "shard")
    marked = rows.join(F.broadcast(large), "key", "left")
    small = marked.where("shard IS NULL").drop("shard").join(found.where(F.col("bytes") < least).select("key", "shard"), "key")
    both = marked.where("shard IS NOT NULL").select(*rows.columns, "shard").union(small.select(*rows.columns, "shard"))
    return numbered(both).drop("key")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes. Null and empty texts are one group of 8 bytes a row; repeated
    rows stand one after the other in their shard; a group above a 24th of all bytes has a shard by itself."""
    found = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

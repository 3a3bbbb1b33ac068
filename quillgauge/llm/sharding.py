"""Shards of near equal bytes by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts are a group and share a shard. Groups are packed in order of falling size,
each into the open bin with the least room that still holds it, found in a balanced tree of the
bins' rooms; only if none holds it a new bin opens. For a given number of shards the smallest
capacity that needs no more bins is searched.

The packing itself sees a bounded number of items: a group of at least 1/(shards * ``fine``) of all
bytes is an item of its own, so there are at most shards * ``fine`` of those; smaller groups are
first put together, by a hash of their text, into shards * ``fine`` bundles. Group sizes are
aggregated before the shuffle, and rows find their shard by their own hash and the (bounded) list
of items, so neither groups nor rows pass through the driver or one task. Slots are numbered inside
buckets of a shard, from the bucket counts.

Edge cases: a null text has 8 bytes, checksum 0, and is a group apart from the empty text; a group
larger than a fair share has a shard that is larger than the others; rows that repeat stay together
in one shard, in slots of their own; null ids take part like any other and are spread by their places; very
long texts are only measured and hashed; of equal sizes the smaller text hash is packed first; of the
input only the id is taken over, so names cannot clash; an empty table stays empty.
"""

from __future__ import annotations

import random
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgauge.session import stored


class Rooms:
    """A treap of (room, bin): insert, and take the least room of at least a size."""

    def __init__(self, seed: int = 0):
        self._root, self._random = None, random.Random(seed)

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return (node[0], node[1], node[2], low), high
        low, high = self._split(node[2], key)
        return low, (node[0], node[1], high, node[3])

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return (a[0], a[1], a[2], self._merge(a[3], b))
        return (b[0], b[1], self._merge(a, b[2]), b[3])

    def insert(self, room: int, name: int) -> None:
        low, high = self._split(self._root, (room, name))
        self._root = self._merge(self._merge(low, ((room, name), self._random.random(), None, None)), high)

    def take(self, size: int) -> tuple[int, int] | None:
        low, high = self._split(self._root, (size, -1))
        if high is None:
            return None
        node = high
        while node[2] is not None:
            node = node[2]
        room, name = node[0]
        _, rest = self._split(high, (room, name + 1))
        self._root = self._merge(low, rest)
        return room, name


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of every item; ``sizes`` must fall, and no item may exceed the capacity."""
    rooms, bins, out = Rooms(), 0, []
    for size in sizes:
        found = rooms.take(size)
        if found is None:
            found, bins = (capacity, bins), bins + 1
        rooms.insert(found[0] - size, found[1])
        out.append(found[1])
    return out


def pack(items: Iterable[tuple[str, int]], shards: int) -> dict[str, int]:
    """The shard of every named item, at most ``shards`` of the smallest capacity that does."""
    order = sorted(items, key=lambda x: (-x[1], x[0]))
    sizes = [size for _, size in order]
    if not sizes:
        return {}
    low = max(sizes[0], -(-sum(sizes) // shards))
    high = low + sizes[0]
    best = best_fit(sizes, high)
    while max(best) >= shards:
        high *= 2
        best = best_fit(sizes, high)
    while low < high:
        middle = (low + high) // 2
        bins = best_fit(sizes, middle)
        if max(bins) < shards:
            best, high = bins, middle
        else:
            low = middle + 1
    return {name: shard for (name, _), shard in zip(order, best, strict=True)}


def shard(
    df: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", fine: int = 256, bucket_rows: int = 8192
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    t = F.col("t")
    sizes = F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 8
    narrow = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).select(
        "doc_id",
        sizes.alias("size"),
        F.coalesce(F.crc32(t), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.md5(t), F.lit("-" * 32)).alias("group"),
    )
    rows = stored(narrow, "rows").withColumn("place", F.monotonically_increasing_id())
    spark = df.sparkSession
    groups = stored(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "groups")
    total, number = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    items = shards * fine
    least = max(1, -(-total // items))
    # A group is named by its 32 digits, a bundle by its number.
    bundle = F.pmod(F.xxhash64("group"), F.lit(items)).cast("string")
    item = F.when(F.col("bytes") >= least, F.col("group")).otherwise(bundle)
    packed = pack(groups.groupBy(item.alias("item")).agg(F.sum("bytes")).collect(), shards)
    bins = spark.createDataFrame(list(packed.items()), "item string, shard int")
    large = bins.filter(F.length("item") == 32).select(F.col("item").alias("group"), F.col("shard").alias("own"))
    small = bins.select(F.col("item").alias("bundle"), F.col("shard").alias("shared"))
    # Both lists have at most 2 * shards * fine rows.
    placed = (
        rows.withColumn("bundle", bundle)
        .join(F.broadcast(large), "group", "left")
        .join(F.broadcast(small), "bundle", "left")
        .select("doc_id", "size", "text_crc32", "place", F.coalesce("own", "shared").alias("shard"))
    )
    buckets = max(1, -(-number // (shards * bucket_rows)))
    # Rows without an id are dealt out by their places in the stored table.
    place = F.when(F.col("doc_id").isNull(), F.col("place"))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", place), F.lit(buckets))).drop("place")
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "starts")
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    slots = placed.withColumn("r", F.row_number().over(inside)).join(starts, ["shard", "bucket"])
    return slots.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("r") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

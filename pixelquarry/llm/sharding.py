"""Sharding by best-fit-decreasing bin packing.

Groups (rows of equal text) are packed so that a group stays in one shard where it fits. Packing is done twice. First, in parallel: groups are dealt into
cells by hash, and each cell streams its groups, largest first, into parcels of a small capacity; the open parcels stand in a balanced tree by remaining
capacity, and a group enters the tightest that takes it. Then the parcels, whose number is bounded by ``shards * PARCELS`` and the cells and doesn't grow
with the rows, are packed into the shards the same way, with the smallest capacity for which best-fit-decreasing needs no more than the given number.

The law is ``bytes``: shard sizes near equal. Only a group larger than a shard's share is split, by a hash of its ids into pieces of about a parcel: whole
it would break the law.

Cases: a null text has no bytes and is grouped with empty ones; a document above a shard's share stands alone in its parcel and the law holds for the
others; repeated rows are numbered each; ties in size go by the texts' digest; an empty table gives an empty result; other columns are not read; a null id
stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelquarry.operators.scaling import join_hot_keys, number_rows
from pixelquarry.session import materialise

#: Parcels to a shard: how fine the second packing can balance.
PARCELS = 64
CELLS = 256
OVERHEAD = 16
HOT_ROWS = 200_000


class BinTree:
    """Open bins by remaining capacity: an AVL tree of (remaining, bin)."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, left, right, height]

    @staticmethod
    def _height(node: list | None) -> int:
        return node[3] if node else 0

    def _turn(self, node: list, side: int) -> list:
        up = node[3 - side]
        node[3 - side], up[side] = up[side], node
        for x in (node, up):
            x[3] = 1 + max(self._height(x[1]), self._height(x[2]))
        return up

    def _balance(self, node: list) -> list:
        node[3] = 1 + max(self._height(node[1]), self._height(node[2]))
        tilt = self._height(node[1]) - self._height(node[2])
        if tilt > 1:
            if self._height(node[1][1]) < self._height(node[1][2]):
                node[1] = self._turn(node[1], 1)
            return self._turn(node, 2)
        if tilt < -1:
            if self._height(node[2][2]) < self._height(node[2][1]):
                node[2] = self._turn(node[2], 2)
            return self._turn(node, 1)
        return node

    def add(self, key: tuple[int, int]) -> None:
        def put(node: list | None) -> list:
            if node is None:
                return [key, None, None, 1]
            side = 1 if key < node[0] else 2
            node[side] = put(node[side])
            return self._balance(node)

        self.root = put(self.root)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return the smallest (remaining, bin) with ``least`` or more remaining."""
        found, node = None, self.root
        while node:
            if node[0][0] >= least:
                found, node = node[0], node[1]
            else:
                node = node[2]
        if found is None:
            return None

        def cut(node: list, key: tuple[int, int]) -> list | None:
            if key == node[0]:
                if not node[1] or not node[2]:
                    return node[1] or node[2]
                low = node[2]
                while low[1]:
                    low = low[1]
                node[0], node[2] = low[0], cut(node[2], low[0])
            else:
                side = 1 if key < node[0] else 2
                node[side] = cut(node[side], key)
            return self._balance(node)

        self.root = cut(self.root, found)
        return found


class BestFit:
    """Streams sizes, largest first, into bins of one capacity; a larger size gets a bin of its own."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.tree, self.bins = capacity, BinTree(), 0

    def place(self, size: int) -> int:
        free, into = self.tree.take(size) or (max(self.capacity, size), self.bins)
        self.bins = max(self.bins, into + 1)
        self.tree.add((free - size, into))
        return into


def pack(sizes: list[int], shards: int) -> list[int]:
    """Bins of sizes (in any order) for the smallest capacity, to one part in 10000, with which best-fit-decreasing needs at most ``shards``."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    total = sum(sizes)

    def attempt(capacity: int) -> list[int] | None:
        fit, out = BestFit(capacity), [0] * len(sizes)
        for i in order:
            out[i] = fit.place(sizes[i])
            if fit.bins > shards:
                return None
        return out

    low = max(1, -(-total // shards))
    high = max(low, max(sizes, default=0)) + low // 4
    best = attempt(high)
    while best is None:
        high *= 2
        best = attempt(high)
    while high - low > max(1, low // 10_000):
        middle = (low + high) // 2
        found = attempt(middle)
        if found is None:
            low = middle + 1
        else:
            high, best = middle, found
    return best


def shard_documents(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", parcels: int = PARCELS, cells: int = CELLS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law), for each row."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + OVERHEAD).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.md5(body.cast("binary")).alias("digest"))
    rows = materialise(rows)
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    capacity = max(1, -(-total // (shards * parcels)))
    share = max(1, -(-total // shards))
    large = groups.filter((F.col("bytes") > share) & (F.col("n") > 1)).select("digest", F.ceil(F.col("bytes") / capacity).cast("int").alias("pieces"))
    large = F.broadcast(large)  # fewer rows than shards: each has more than a shard's share of the bytes
    rows = rows.join(large, "digest", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("pieces")).cast("int"), F.lit(0))).drop("pieces")
    units = rows.groupBy("digest", "piece").agg(F.sum("size").alias("bytes")).withColumn("cell", F.pmod(F.xxhash64("digest", "piece"), F.lit(cells)).cast("int"))
    units = units.repartition("cell").sortWithinPartitions("cell", F.desc("bytes"), "digest", "piece").select("cell", "bytes", "digest", "piece")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fit = None, None
        for batch in batches:
            own, places = batch.column(0).to_pylist(), []
            for c, size in zip(own, batch.column(1).to_pylist(), strict=True):
                if c != cell:
                    cell, fit = c, BestFit(capacity)
                places.append(fit.place(size))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.int32()), *[batch.column(i) for i in (1, 2, 3)]], ["cell", "parcel", "bytes", "digest", "piece"])

    placed = materialise(units.mapInArrow(fill, "cell int, parcel int, bytes bigint, digest string, piece int"))
    # a bounded table: parcels are full but for a few in each cell
    found = placed.groupBy("cell", "parcel").agg(F.sum("bytes").alias("bytes")).orderBy("cell", "parcel").collect()
    shard = pack([r["bytes"] for r in found], shards)
    chosen = spark.createDataFrame([(r["cell"], r["parcel"], s) for r, s in zip(found, shard, strict=True)], "cell int, parcel int, shard int")
    placed = placed.join(F.broadcast(chosen), ["cell", "parcel"]).select("digest", "piece", "shard")
    located = join_hot_keys(rows, placed, ["digest", "piece"], "inner", HOT_ROWS).select("doc_id", "size", "text_crc32", "shard")
    numbered = number_rows(located, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("pos") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

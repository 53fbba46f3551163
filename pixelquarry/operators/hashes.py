"""64-bit content keys of images and of compressed streams.

A key is the running CRC-32 state (without the final inversion) in the upper
half plus a byte sum in the lower half, as a signed 64-bit number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelquarry.operators.pixels import sample_grid


def open_crc(content: Column) -> Column:
    """CRC-32 state after ``content``: the standard checksum with its final inversion undone."""
    return F.crc32(content).bitwiseXOR(F.lit(0xFFFFFFFF).cast("bigint"))


def combine(crc: Column, total: Column) -> Column:
    """Upper half from the checksum, lower half from the sum, wrapping as 64-bit integers do."""
    return F.shiftleft(crc.cast("bigint"), 32) + total


def pixel_hash(pixels: DataFrame, num_values: int = 120_000) -> DataFrame:
    """Content key of each image from its fixed sub-sample.

    The checksum runs over the interleaved little-endian histogram bytes of
    blue, green and red and then over the blue line at a quarter of the height.
    Both are small per image (256 bins, one line), gathered after counting.
    An all-black image has key 0.
    """
    grid = sample_grid(pixels, num_values)
    bins = grid.selectExpr("image_id", "stack(3, 0, b, 1, g, 2, r) AS (c, v)").groupBy("image_id", "v").agg(
        *[F.expr(f"sum(IF(c = {i}, 1L, 0L))").alias(n) for i, n in enumerate("bgr")]
    )
    byte = "substr(hex((shiftright({c}, {s}) & 255) + 256), 2)"
    text = "concat(" + ", ".join(byte.format(c=c, s=8 * k) for k in range(4) for c in "bgr") + ")"
    hists = bins.groupBy("image_id").agg(
        F.map_from_entries(F.collect_list(F.struct("v", F.expr(text).alias("t")))).alias("_bins"),
        F.sum(F.expr("v * (b + g + r)")).alias("_total"),
    )
    lines = (
        grid.filter("y = h div 4").groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("x", "b"))).alias("_line"))
        .select("image_id", F.array_join(F.transform("_line", lambda p: F.concat(F.substring(F.hex(p["b"] + 256), 2, 2), F.lit("00"))), "").alias("_line"))
    )
    empty = F.lit("0" * 24)
    joined = hists.join(lines, "image_id")
    body = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.try_element_at("_bins", i), empty)), ""), F.col("_line"))
    total = F.col("_total").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    return joined.select("image_id", F.when(total == 0, F.lit(0).cast("bigint")).otherwise(combine(open_crc(F.unhex(body)), total)).alias("hash"))


def find_segment(data: bytes, wanted: int) -> int | None:
    """Offset of a JPEG segment's marker byte pair; 0 asks for the start of the pixel data."""
    size = len(data)
    if size < 3 or data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at < size and data[at] == 0xFF:
        while at < size and data[at] == 0xFF:
            at += 1
        if at >= size or data[at] in (0, wanted):
            break
        at = at + 1 + (int.from_bytes(data[at + 1:at + 3], "big") if at + 2 < size else size)
    if wanted == 0:
        return min(at, size) - 1
    return at - 1 if at < size and data[at] == wanted and data[at - 1] == 0xFF else None


def stream_key(data: bytes, lookups: int = 10_000) -> int:
    """Key of the compressed pixel bytes: every k-th byte after the header segments, so edits of metadata keep it."""
    start = find_segment(data, 0)
    if start is None:
        return 0
    start += 1
    if len(data) - start < 4:
        start = 0
    picked = data[start::max(1, (len(data) - start) // lookups)]
    key = ((zlib.crc32(picked) ^ 0xFFFFFFFF) << 32) + (sum(picked) & 0xFFFFFFFF)
    return key - (1 << 64) if key >= 1 << 63 else key


def stream_hash(files: DataFrame, key: str, lookups: int = 10_000) -> DataFrame:
    """``key, hash`` for files with a ``content`` column; 0 for content that is no JPEG."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "hash": [stream_key(bytes(c), lookups) for c in batch["content"]]}).astype({"hash": "int64"})

    kind = dict(files.dtypes)[key]
    return files.select(key, "content").mapInPandas(run, f"`{key}` {kind}, hash bigint")

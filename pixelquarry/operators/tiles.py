"""Images as tile rows: bounded pixel arrays instead of a row per pixel.

A tile row is ``image_id, w, h, ty, tx`` and one binary column per channel: the pixels of rows ``ty * SIZE ..`` and columns ``tx * SIZE ..`` line by line,
cut at the image's edge. Filters send each target tile the strips of source tiles that its taps reach (a range join on tile numbers), so what moves is
every pixel once and the halo, never a row per pixel and tap. Images of one tile are filtered in place, without any shuffle. A giant image is many
rows and spreads over all tasks. Pixels that are missing in the source count as zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelquarry.operators.scaling import broadcast_if_small
from pixelquarry.session import materialise

SIZE = 128
COLOURS = ("b", "g", "r")
KINDS = {"b": "u1", "g": "u1", "r": "u1", "gray14": "<i2"}
BLOCK_ROWS = 50_000
#: Rows of pixels given back at once.
PIXEL_ROWS = 1 << 18


def _int(column: pa.Array) -> np.ndarray:
    return np.asarray(column, np.int64)


def to_tiles(pixels: DataFrame, channels: Sequence[str] = COLOURS, keep: Sequence[str] = (), size: int = 0) -> DataFrame:
    """Pixel rows to tile rows. ``keep``: further columns that are the same for all pixels of an image."""
    size = size or SIZE
    key = ["image_id", "w", "h", *keep]
    at = F.expr(f"(y % {size}) * {size} + x % {size}").cast("int")
    struct = F.struct(at.alias("at"), *[F.col(c).cast("smallint").alias(c) for c in channels])
    tile = [F.expr(f"cast({v} div {size} AS int)").alias(n) for n, v in (("ty", "y"), ("tx", "x"))]
    grouped = pixels.select(*key, *tile, struct.alias("p")).groupBy(*key, "ty", "tx").agg(F.collect_list("p").alias("p"))

    def pack(p: pa.Array, w: pa.Array, h: pa.Array, ty: pa.Array, tx: pa.Array) -> pa.Array:
        flat, ends = p.flatten(), np.cumsum(_int(p.value_lengths()))
        wide = np.minimum(size, _int(w) - _int(tx) * size)
        tall = np.minimum(size, _int(h) - _int(ty) * size)
        count = wide * tall
        row = np.repeat(np.arange(len(p)), np.diff(np.append(0, ends)))
        place = _int(flat.field("at"))
        place = (np.cumsum(count) - count)[row] + place // size * wide[row] + place % size
        offsets = pa.py_buffer(np.append(0, np.cumsum(count)).astype(np.int64))
        out = []
        for c in channels:
            values = np.zeros(int(count.sum()), KINDS[c])
            values[place] = _int(flat.field(c))
            bytes_at = offsets if values.itemsize == 1 else pa.py_buffer(np.append(0, np.cumsum(count) * values.itemsize).astype(np.int64))
            out.append(pa.Array.from_buffers(pa.large_binary(), len(p), [None, bytes_at, pa.py_buffer(values.tobytes())]).cast(pa.binary()))
        return pa.StructArray.from_arrays(out, list(channels))

    kind = "struct<" + ", ".join(f"{c}: binary" for c in channels) + ">"
    return grouped.withColumn("d", F.arrow_udf(pack, kind)("p", "w", "h", "ty", "tx")).select(*key, "ty", "tx", "d.*")


def from_tiles(tiles: DataFrame, channels: Sequence[str] = COLOURS, size: int = 0) -> DataFrame:
    """Tile rows back to pixel rows ``image_id, w, h, x, y`` and the channels."""
    size = size or SIZE
    kinds = [KINDS[c] for c in channels]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            image, data = batch.column(0), [batch.column(5 + i).to_pylist() for i in range(len(channels))]
            w, h, ty, tx = (_int(batch.column(i)) for i in range(1, 5))
            wide = np.minimum(size, w - tx * size)
            count = wide * np.minimum(size, h - ty * size)
            lo = 0
            while lo < len(count):
                hi = max(lo + 1, int(np.searchsorted(np.cumsum(count[lo:]), PIXEL_ROWS, "right")) + lo)
                own = count[lo:hi]
                row = np.repeat(np.arange(lo, hi), own)
                at = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)
                places = [w[row], h[row], at % wide[row] + tx[row] * size, at // wide[row] + ty[row] * size]
                values = [np.frombuffer(b"".join(d[lo:hi]), k) for d, k in zip(data, kinds, strict=True)]
                columns = [image.take(pa.array(row)), *(pa.array(v.astype(np.int32)) for v in (*places, *values))]
                yield pa.RecordBatch.from_arrays(columns, ["image_id", "w", "h", "x", "y", *channels])
                lo = hi

    kind = tiles.schema["image_id"].dataType.simpleString()
    return tiles.select("image_id", "w", "h", "ty", "tx", *channels).mapInArrow(unpack, f"image_id {kind}, w int, h int, x int, y int, " + ", ".join(f"{c} int" for c in channels))


# --- separable filters --------------------------------------------------------------------------

def tap_blocks(kernels: DataFrame, size: int = 0) -> DataFrame:
    """Taps by target tile: src_size, dst_size, tile, the source range [lo, hi) they read, and the taps with places inside the two ranges."""
    size = size or SIZE
    tile = F.expr(f"cast(dst div {size} AS int)")
    lo = F.min("src")
    taps = F.collect_list(F.struct((F.col("dst") % size).cast("int").alias("dst"), F.col("src").cast("int").alias("src"), F.col("weight").cast("int").alias("weight")))
    return kernels.groupBy("src_size", "dst_size", tile.alias("tile")).agg(lo.alias("lo"), (F.max("src") + 1).alias("hi"), taps.alias("taps"))


def _matrix(taps: pa.ListScalar, lo: int, reads: int, makes: int) -> np.ndarray:
    """Weights as a matrix (source place, target place); doubles hold all sums exactly."""
    flat = taps.values
    out = np.zeros((reads, makes))
    np.add.at(out, (_int(flat.field("src")) - lo, _int(flat.field("dst"))), _int(flat.field("weight")))
    return out


def _rounded(sums: np.ndarray, kind: str, half: int) -> np.ndarray:
    out = (sums.astype(np.int64) + half) >> 14
    return np.clip(out, 0, 255).astype(kind) if kind == "u1" else out.astype(kind)


def _structs(rows: list[list[bytes]], channels: Sequence[str]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in range(len(channels))], list(channels))


def _whole(channels: Sequence[str], half: int, *columns: pa.Array) -> pa.Array:
    """Both passes over images of one tile; those of one size together."""
    w, h, nw, nh = (_int(c) for c in columns[:4])
    taps_x, taps_y, data = columns[4], columns[5], [c.to_pylist() for c in columns[6:]]
    out: list = [None] * len(w)
    sizes = np.stack([w, h, nw, nh], axis=1)
    for own in np.unique(sizes, axis=0) if len(w) else ():
        at = np.flatnonzero((sizes == own).all(axis=1))
        ow, oh, ox, oy = own.tolist()
        kx, ky = _matrix(taps_x[int(at[0])], 0, ow, ox), _matrix(taps_y[int(at[0])], 0, oh, oy)
        made = []
        for c, values in zip(channels, data, strict=True):
            a = np.frombuffer(b"".join(values[i] for i in at), KINDS[c]).reshape(-1, oh, ow)
            a = _rounded(a.astype(float) @ kx, KINDS[c], half)
            made.append(_rounded(np.swapaxes(np.swapaxes(a, 1, 2).astype(float) @ ky, 1, 2), KINDS[c], half))
        for n, i in enumerate(at.tolist()):
            out[i] = [m[n].tobytes() for m in made]
    return _structs(out, channels)


def _strip(channels: Sequence[str], axis: int, size: int, *columns: pa.Array) -> pa.Array:
    """The part of a tile between two places along an axis."""
    begin, end, w, tx = (_int(c) for c in columns[:4])
    out = []
    for i, row in enumerate(zip(*(c.to_pylist() for c in columns[4:]), strict=True)):
        wide = min(size, int(w[i]) - int(tx[i]) * size)
        lo, hi = int(begin[i]), int(end[i])
        made = []
        for c, raw in zip(channels, row, strict=True):
            a = np.frombuffer(raw, KINDS[c]).reshape(-1, wide)
            made.append((a[lo:hi] if axis else a[:, lo:hi]).tobytes())
        out.append(made)
    return _structs(out, channels)


def _filtered(channels: Sequence[str], axis: int, half: int, *columns: pa.Array) -> pa.Array:
    """Strips of a row (or column) of tiles put together and weighed."""
    lo, hi, makes, cross = (_int(c) for c in columns[:4])
    block, taps, strips = np.stack([_int(c) for c in columns[4:7]], axis=1), columns[7], columns[8]
    out, own, matrix = [], None, None
    for i in range(len(lo)):
        begin, reads, lines = int(lo[i]), int(hi[i] - lo[i]), int(cross[i])
        if own is None or (block[i] != own).any():
            own, matrix = block[i], _matrix(taps[i], begin, reads, int(makes[i]))
        parts, made = strips[i].as_py(), []
        for c in channels:
            source = np.zeros((lines, reads))  # a strip that no tile sent is missing pixels
            for s in parts:
                a = np.frombuffer(s[c], KINDS[c])
                a = a.reshape(-1, lines).T if axis else a.reshape(lines, -1)
                source[:, s["at"] - begin : s["at"] - begin + a.shape[1]] = a
            done = _rounded(source @ matrix, KINDS[c], half)
            made.append((done.T if axis else done).tobytes())
        out.append(made)
    return _structs(out, channels)


def _pass(tiles: DataFrame, blocks: DataFrame, axis: int, channels: Sequence[str], half: int, size: int) -> DataFrame:
    """One direction (0: along x, 1: along y) for images of any size."""
    side, new, tile, other = (("h", "nh", "ty", "tx") if axis else ("w", "nw", "tx", "ty"))
    cross_side = "w" if axis else "h"
    kind = "struct<" + ", ".join(f"{c}: binary" for c in channels) + ">"
    begin = F.col(tile) * size
    stop = F.least(begin + size, F.col(side))
    ranges = blocks.select(F.col("src_size").alias(side), F.col("dst_size").alias(new), F.col("tile").alias("_to"), "lo", "hi")
    met = tiles.join(ranges, [side, new]).filter((F.col("lo") < stop) & (F.col("hi") > begin))
    first, last = F.greatest(F.col("lo"), begin), F.least(F.col("hi"), stop)
    cut = F.arrow_udf(lambda *c: _strip(channels, axis, size, *c), kind)(first - begin, last - begin, F.col("w"), F.col("tx"), *channels)
    sent = met.withColumn("_c", cut).select("image_id", "w", "h", "nw", "nh", other, "_to", F.struct(first.alias("at"), *[F.col(f"_c.{c}") for c in channels]).alias("s"))
    strips = sent.groupBy("image_id", "w", "h", "nw", "nh", other, "_to").agg(F.collect_list("s").alias("s"))
    weighed = strips.join(blocks.select(F.col("src_size").alias(side), F.col("dst_size").alias(new), F.col("tile").alias("_to"), "lo", "hi", "taps"), [side, new, "_to"])
    makes = F.least(F.lit(size), F.col(new) - F.col("_to") * size)
    cross = F.least(F.lit(size), F.col(cross_side) - F.col(other) * size)
    done = weighed.withColumn("d", F.arrow_udf(lambda *c: _filtered(channels, axis, half, *c), kind)("lo", "hi", makes, cross, side, new, "_to", "taps", "s"))
    return done.select("image_id", *[F.col(new).alias(side) if c == side else F.col(c) for c in ("w", "h")], "nw", "nh", F.col(other), F.col("_to").alias(tile), "d.*")


def filter_tiles(tiles: DataFrame, kernels: Callable[[DataFrame], DataFrame], pairs: DataFrame, channels: Sequence[str] = COLOURS, half: int = 255, size: int = 0) -> DataFrame:
    """Separable filter of tiles with columns ``nw, nh``: along x, round, along y, round.

    ``pairs`` has all (src_size, dst_size); ``kernels`` makes taps (src_size, dst_size, dst, src, weight) from them.
    """
    size = size or SIZE
    pairs = pairs.distinct()
    large, small = pairs.agg(F.coalesce(F.max(F.greatest("src_size", "dst_size")), F.lit(0)), F.coalesce(F.min(F.greatest("src_size", "dst_size")), F.lit(0))).first()
    blocks = broadcast_if_small(materialise(tap_blocks(kernels(pairs), size)), BLOCK_ROWS)
    kind = "struct<" + ", ".join(f"{c}: binary" for c in channels) + ">"
    one_tile = F.greatest("w", "h", "nw", "nh") <= size
    if large > size and small <= size:
        tiles = materialise(tiles)  # read by both branches

    def in_place(own: DataFrame) -> DataFrame:
        bx = blocks.select(F.col("src_size").alias("w"), F.col("dst_size").alias("nw"), F.col("taps").alias("_kx"), F.col("tile").alias("_tx")).filter("_tx = 0")
        by = blocks.select(F.col("src_size").alias("h"), F.col("dst_size").alias("nh"), F.col("taps").alias("_ky"), F.col("tile").alias("_ty")).filter("_ty = 0")
        met = own.join(bx, ["w", "nw"]).join(by, ["h", "nh"])
        done = met.withColumn("d", F.arrow_udf(lambda *c: _whole(channels, half, *c), kind)("w", "h", "nw", "nh", "_kx", "_ky", *channels))
        return done.select("image_id", F.col("nw").alias("w"), F.col("nh").alias("h"), "ty", "tx", "d.*")

    def by_strips(own: DataFrame) -> DataFrame:
        for axis in (0, 1):
            own = _pass(own, blocks, axis, channels, half, size)
        return own.select("image_id", "w", "h", "ty", "tx", *channels)

    if large <= size:
        return in_place(tiles)
    if small > size:
        return by_strips(tiles)
    return in_place(tiles.filter(one_tile)).unionByName(by_strips(tiles.filter(~one_tile)))


# --- gathering ----------------------------------------------------------------------------------

#: Stands for a place that can't be computed: far outside any image.
NOWHERE = -(1 << 45)


def gather(
    tiles: DataFrame, images: DataFrame, terms: dict[str, str], reach: int, read: Callable, background: tuple[int, int, int], flags: dict[str, str] | None = None, size: int = 0,
) -> DataFrame:
    """Target tiles whose pixels are read from anywhere in the source image.

    ``images``: image_id, w, h (source), _tw, _th (target). ``terms``: SQL over its columns and the target line ``y`` for ax, bx, ay, by; pixel x of the line
    reads about ((ax + x * bx) >> 16, (ay + x * by) >> 16) in the source, ``reach`` pixels around it, and gets what
    ``read(window, left, top, w, h, x, line, background)`` makes of it; ``flags`` are further values of a line. The bounding box of a target tile names the
    source tiles that are sent to it.
    """
    size = size or SIZE
    flags = flags or {}
    names = ["ax", "bx", "ay", "by"]
    fields = ["y", *names, *flags]
    value = ", ".join(["'y', y", *[f"'{n}', coalesce(cast({terms[n]} AS bigint), {NOWHERE if n[0] == 'a' else 0}L)" for n in names], *[f"'{n}', {v}" for n, v in flags.items()]])
    line = f"transform(sequence(ty * {size}, least(_th, (ty + 1) * {size}) - 1), y -> named_struct({value}))"
    made = images.withColumn("ty", F.explode(F.expr(f"sequence(0, cast((_th - 1) div {size} AS int))"))).withColumn("lines", F.expr(line))
    made = made.select("image_id", "w", "h", "_tw", "_th", "ty", "lines", F.explode(F.expr(f"sequence(0, cast((_tw - 1) div {size} AS int))")).alias("tx"))
    first, last = f"tx * {size}", f"least(_tw, (tx + 1) * {size}) - 1"

    def bound(pick: str, a: str, b: str) -> Column:
        both = [f"{pick}(transform(lines, l -> shiftright(l.{a} + ({x}) * l.{b}, 16)))" for x in (first, last)]
        return F.expr(f"{'least' if pick == 'array_min' else 'greatest'}({both[0]}, {both[1]})")

    box = {"_l": F.greatest(bound("array_min", "ax", "bx") - reach, F.lit(0)), "_r": F.least(bound("array_max", "ax", "bx") + reach, F.col("w") - 1)}
    box |= {"_t": F.greatest(bound("array_min", "ay", "by") - reach, F.lit(0)), "_b": F.least(bound("array_max", "ay", "by") + reach, F.col("h") - 1)}
    made = materialise(made.withColumns(box))
    wanted = made.filter("_l <= _r AND _t <= _b").select("image_id", F.col("ty").alias("_ty"), F.col("tx").alias("_tx"), "_l", "_r", "_t", "_b")
    wanted = wanted.withColumn("ty", F.explode(F.expr(f"sequence(cast(_t div {size} AS int), cast(_b div {size} AS int))")))
    wanted = wanted.withColumn("tx", F.explode(F.expr(f"sequence(cast(_l div {size} AS int), cast(_r div {size} AS int))")))
    source = F.struct("ty", "tx", F.least(F.lit(size), F.col("w") - F.col("tx") * size).alias("wide"), *COLOURS)
    sent = wanted.join(tiles, ["image_id", "ty", "tx"]).select("image_id", F.col("_ty").alias("ty"), F.col("_tx").alias("tx"), source.alias("s"))
    boxes = sent.groupBy("image_id", "ty", "tx").agg(F.collect_list("s").alias("s"))
    whole = made.join(boxes, ["image_id", "ty", "tx"], "left")

    def fill(*columns: pa.Array) -> pa.Array:
        w, h, tw, tx = (_int(c) for c in columns[:4])
        out = []
        for i in range(len(w)):
            parts = columns[5][i].as_py() or []
            flat = columns[4][i].values
            line = {f: _int(flat.field(f).cast(pa.int64()))[:, None] for f in fields}
            x = np.arange(int(tx[i]) * size, min(int(tw[i]), (int(tx[i]) + 1) * size))[None, :]
            top = min((p["ty"] for p in parts), default=0) * size
            left = min((p["tx"] for p in parts), default=0) * size
            bottom = max((p["ty"] * size + len(p["b"]) // p["wide"] for p in parts), default=0)
            right = max((p["tx"] * size + p["wide"] for p in parts), default=0)
            window = np.zeros((max(0, bottom - top), max(0, right - left), 3), np.int64)
            for p in parts:
                a = np.stack([np.frombuffer(p[c], "u1").reshape(-1, p["wide"]) for c in COLOURS], axis=-1)
                y0, x0 = p["ty"] * size - top, p["tx"] * size - left
                window[y0 : y0 + a.shape[0], x0 : x0 + a.shape[1]] = a
            done = read(window, left, top, int(w[i]), int(h[i]), x, line, np.array(background)).astype("u1")
            out.append([np.ascontiguousarray(done[..., c]).tobytes() for c in range(3)])
        return _structs(out, COLOURS)

    done = whole.withColumn("d", F.arrow_udf(fill, "struct<b: binary, g: binary, r: binary>")("w", "h", "_tw", "tx", "lines", "s"))
    return done.select("image_id", F.col("_tw").cast("int").alias("w"), F.col("_th").cast("int").alias("h"), "ty", "tx", "d.*")


def window_at(window: np.ndarray, left: int, top: int, w: int, h: int, sx: np.ndarray, sy: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Source pixels by place; the background outside the image."""
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.broadcast_to(background, (*inside.shape, 3)).copy()
    if inside.any():
        out[inside] = window[(sy - top)[inside], (sx - left)[inside]]
    return out

"""Pixel sets as coordinate projections.

A pixel row is ``image_id, w, h, x, y, b, g, r``. Size travels with every row
(the decoder knows it), so none of these operators needs a join, a shuffle or
the rest of its image: they are plain projections, filters and generators.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelquarry.operators import tiles
from pixelquarry.operators.scaling import attach_per_image

COLOURS = ("b", "g", "r")


def _moved(pixels: DataFrame, **new: str) -> DataFrame:
    return pixels.selectExpr(*[f"{new[c]} AS {c}" if c in new else f"`{c}`" for c in pixels.columns])


def rotate90(pixels: DataFrame, angle: int) -> DataFrame:
    """Clockwise quarter turns; other angles are refused."""
    if angle == 90:
        return _moved(pixels, x="h - 1 - y", y="x", w="h", h="w")
    if angle == 180:
        return _moved(pixels, x="w - 1 - x", y="h - 1 - y")
    if angle == 270:
        return _moved(pixels, x="y", y="w - 1 - x", w="h", h="w")
    raise ValueError("angle must be 90, 180 or 270")


def mirror(pixels: DataFrame, horizontal: bool = True) -> DataFrame:
    return _moved(pixels, x="w - 1 - x") if horizontal else _moved(pixels, y="h - 1 - y")


def crop(pixels: DataFrame, left: int, top: int, right: int, bottom: int) -> DataFrame:
    """Half-open rectangle; images that do not hold it fully give no rows, an empty rectangle is refused."""
    if right <= left or bottom <= top or left < 0 or top < 0:
        raise ValueError("empty or negative rectangle")
    inside = pixels.filter(f"w >= {right} AND h >= {bottom} AND x >= {left} AND x < {right} AND y >= {top} AND y < {bottom}")
    return _moved(inside, x=f"x - {left}", y=f"y - {top}", w=str(right - left), h=str(bottom - top))


def paste(target: DataFrame, source: DataFrame, pairs: DataFrame, from_xy: tuple[int, int], to_xy: tuple[int, int], size: tuple[int, int]) -> DataFrame:
    """Copy a rectangle between images.

    ``pairs`` maps each source (``src_id, w, h``) to its target ``image_id``.
    The final join key holds the coordinates, so rows of one large image spread out.
    """
    (fx, fy), (tx, ty), (cx, cy) = from_xy, to_xy, size
    patch = source.filter(f"x >= {fx} AND x < {fx + cx} AND y >= {fy} AND y < {fy + cy}")
    targets = pairs.selectExpr("src_id AS image_id", "w", "h", "image_id AS _to")
    moved = attach_per_image(patch, targets).selectExpr(
        "_to AS image_id", f"x + {tx - fx} AS x", f"y + {ty - fy} AS y", "b AS _b", "g AS _g", "r AS _r"
    )
    merged = target.join(moved, ["image_id", "x", "y"], "left")
    for c in COLOURS:
        merged = merged.withColumn(c, F.coalesce(f"_{c}", c))
    return merged.drop("_b", "_g", "_r")


def _in_rect(left: int, top: int, right: int, bottom: int) -> str:
    return f"x >= {left} AND x < {right} AND y >= {top} AND y < {bottom}"


def dim_rect(pixels: DataFrame, rect: tuple[int, int, int, int], factor: float) -> DataFrame:
    """Darken inside a rectangle, clipped to the image, in 16.16 fixed point."""
    f = int(factor * 65536 + 0.5)
    return _moved(pixels, **{c: f"CASE WHEN {_in_rect(*rect)} THEN shiftright({c} * {f}, 16) ELSE {c} END" for c in COLOURS})


def fill_rect(pixels: DataFrame, rect: tuple[int, int, int, int], bgr: tuple[int, int, int]) -> DataFrame:
    return _moved(pixels, **{c: f"CASE WHEN {_in_rect(*rect)} THEN {v} ELSE {c} END" for c, v in zip(COLOURS, bgr)})


def grid_lines(pixels: DataFrame, max_cells: int = 8, min_cell: int = 40, bgr: tuple[int, int, int] = (192, 192, 192)) -> DataFrame:
    """Evenly spaced one-pixel lines, first and last pixel included; none on a side shorter than ``min_cell``."""

    def on(coordinate: str, side: str) -> str:
        cells = f"least({max_cells}, cast({side} div {min_cell} AS int))"
        return f"({side} >= {min_cell} AND exists(sequence(0, {cells}), i -> {coordinate} = i * ({side} - 1) div {cells}))"

    line = f"{on('x', 'w')} OR {on('y', 'h')}"
    return _moved(pixels, **{c: f"CASE WHEN {line} THEN {v} ELSE {c} END" for c, v in zip(COLOURS, bgr)})


def widen_single_channel(pixels: DataFrame, column: str = "v") -> DataFrame:
    return pixels.selectExpr("*", *[f"`{column}` AS {c}" for c in COLOURS]).drop(column)


def gray14_to_bgr(pixels: DataFrame, column: str = "gray14") -> DataFrame:
    return widen_single_channel(pixels.withColumn("_v", F.expr(f"shiftright(`{column}`, 6)")).drop(column), "_v")


def apply_palette(pixels: DataFrame, palettes: DataFrame, index: str = "idx") -> DataFrame:
    """Palette index to colours; ``palettes`` holds one array of 0xRRGGBB values per image."""
    joined = attach_per_image(pixels, palettes.select("image_id", "w", "h", "palette"))
    colour = F.element_at("palette", F.col(index) + 1)
    return (
        joined.withColumn("b", colour.bitwiseAND(255))
        .withColumn("g", F.shiftright(colour, 8).bitwiseAND(255))
        .withColumn("r", F.shiftright(colour, 16).bitwiseAND(255))
        .drop("palette", index)
    )


def alpha_blend(pixels: DataFrame, background: tuple[int, int, int], alpha: str = "a") -> DataFrame:
    """Blend over a background colour with the alpha column 0..255, rounding to nearest."""
    mix = {c: f"cast(({c} * {alpha} + {v} * (255 - {alpha})) / 255.0D + 0.5D AS int)" for c, v in zip(COLOURS, background)}
    return _moved(pixels, **mix).drop(alpha)


GRAY14 = (
    "shiftright(cast(0.299D * b * 65536.0D + 0.5D AS int) + cast(0.587D * g * 65536.0D + 0.5D AS int) "
    "+ cast(0.114D * r * 65536.0D + 0.5D AS int) + 32767, 10)"
)


def gray14(pixels: DataFrame) -> DataFrame:
    """14-bit gray; the weights meet the channels in b, g, r order (kept behaviour)."""
    return pixels.withColumn("gray14", F.expr(GRAY14))


def _targets(coordinate: str, increment: str, size: str) -> str:
    """Targets i in [0, size) with (i * increment) >> 16 = coordinate, as a sequence (or NULL)."""
    first = f"cast(ceil(cast({coordinate} AS bigint) * 65536 / cast({increment} AS double)) AS int)"
    last = f"least(cast({size} AS int) - 1, cast(ceil((cast({coordinate} AS bigint) + 1) * 65536 / cast({increment} AS double)) AS int) - 1)"
    return f"CASE WHEN {increment} = 0 THEN IF({coordinate} = 0, sequence(0, cast({size} AS int) - 1), NULL) WHEN {first} <= {last} THEN sequence({first}, {last}) END"


def scatter(pixels: DataFrame, width: str, height: str, inc_x: str, inc_y: str) -> DataFrame:
    """Nearest-pixel resampling from the source's side.

    Each source pixel lists the target pixels that read it, which needs neither
    a target grid nor a join.
    """
    sized = pixels.withColumns({"_tw": F.expr(width), "_th": F.expr(height)})
    stepped = sized.withColumns({"_ix": F.expr(inc_x), "_iy": F.expr(inc_y)})
    wide = stepped.withColumn("_x", F.explode(F.expr(_targets("x", "_ix", "_tw"))))
    tall = wide.withColumn("_y", F.explode(F.expr(_targets("y", "_iy", "_th"))))
    out = tall.drop("x", "y", "w", "h", "_ix", "_iy").withColumnsRenamed({"_x": "x", "_y": "y"})
    return out.withColumns({"w": F.col("_tw").cast("int"), "h": F.col("_th").cast("int")}).drop("_tw", "_th")


def resize_point(pixels: DataFrame, width: str, height: str) -> DataFrame:
    """Nearest-pixel resize. The width alone decides between the shrinking and the growing step (kept behaviour).

    Growing in height while shrinking in width can step past the last source
    row in the original; such target rows have no source pixel and are absent.
    """
    shrink = "_tw <= w"
    inc_x = f"CASE WHEN {shrink} THEN (cast(w AS bigint) * 65536) div _tw + 1 WHEN _tw = 1 THEN 0L ELSE (65536L * (w - 1) + 65535) div (_tw - 1) END"
    inc_y = f"CASE WHEN {shrink} THEN (cast(h AS bigint) * 65536) div _th + 1 WHEN _th = 1 THEN 0L ELSE (65536L * (h - 1) + 65535) div (_th - 1) END"
    return scatter(pixels, width, height, inc_x, inc_y)


def sample_grid(pixels: DataFrame, num_values: int = 120_000) -> DataFrame:
    """Fixed-point sub-sample of about ``num_values`` pixels; sides are padded to a multiple of four."""
    width = f"4 * ((cast((cast(w AS double) / h) * sqrt({num_values} / (cast(w AS double) / h)) AS int) + 3) div 4)"
    height = "4 * ((cast(_tw / (cast(w AS double) / h) AS int) + 3) div 4)"
    sized = pixels.withColumn("_tw", F.expr(width)).withColumn("_th", F.expr(height))
    return scatter(sized, "_tw", "_th", "(cast(w AS bigint) * 65536) div _tw", "(cast(h AS bigint) * 65536) div _th")


def rotation_terms(angle: str, out_w: str = "_tw", out_h: str = "_th", unit_steps: bool = False) -> dict[str, str]:
    """Fixed-point start and steps of the inverse mapping, as SQL over w, h and the target size.

    A target pixel (i, j) reads source ((fx + i*x1 + j*x2) >> 16, (fy + i*y1 + j*y2) >> 16).
    """
    cx, cy = "((w - 1) * 0.5D)", "((h - 1) * 0.5D)"
    co, si = f"cos(-({angle}))", f"sin(-({angle}))"
    step_x = f"CASE WHEN {out_w} = 1 THEN 0.0D ELSE {'1.0D' if unit_steps else f'cast(w AS double) / ({out_w} - 1)'} END"
    step_y = f"CASE WHEN {out_h} = 1 THEN 0.0D ELSE {'1.0D' if unit_steps else f'cast(h AS double) / ({out_h} - 1)'} END"

    def fixed(v: str) -> str:
        return f"cast(CASE WHEN {v} < 0 THEN 65536 * ({v}) - 0.5D ELSE 65536 * ({v}) + 0.5D END AS bigint)"

    return {
        "_fx": fixed(f"({co} * -{cx} - {si} * -{cy} + {cx})"),
        "_fy": fixed(f"({si} * -{cx} + {co} * -{cy} + {cy})"),
        "_x1": fixed(f"({co} * ({step_x}))"),
        "_y1": fixed(f"({si} * ({step_x}))"),
        "_x2": fixed(f"(-{si} * ({step_y}))"),
        "_y2": fixed(f"({co} * ({step_y}))"),
    }


def _inverse(angle: str, unit_steps: bool = False) -> dict[str, str]:
    """Places read by target line ``y``, for :func:`tiles.gather`."""
    t = rotation_terms(angle, unit_steps=unit_steps)
    return {"ax": f"({t['_fx']} + y * {t['_x2']})", "bx": t["_x1"], "ay": f"({t['_fy']} + y * {t['_y2']})", "by": t["_y1"]}


def _sized(images: DataFrame, width: str, height: str) -> DataFrame:
    return images.withColumns({"_tw": F.expr(f"cast({width} AS int)"), "_th": F.expr(f"cast({height} AS int)")})


def _nearest(window, left, top, w, h, x, line, background):
    sx, sy = (line["ax"] + x * line["bx"]) >> 16, (line["ay"] + x * line["by"]) >> 16
    return tiles.window_at(window, left, top, w, h, sx, sy, background)


def _gathered(pixels: DataFrame, images: DataFrame, terms: dict[str, str], reach: int, read, background, flags=None) -> DataFrame:
    return tiles.from_tiles(tiles.gather(tiles.to_tiles(pixels), images, terms, reach, read, background, flags))


def rotate_free(pixels: DataFrame, images: DataFrame, angle: str, width: str, height: str, background: tuple[int, int, int]) -> DataFrame:
    """Any rotation about the centre with nearest-pixel reads; background outside.

    ``images`` has one row per image (``image_id, w, h``); ``angle``, ``width`` and ``height`` are SQL over it.
    """
    return _gathered(pixels, _sized(images, width, height), _inverse(angle), 0, _nearest, background)


def rotate_bicubic(pixels: DataFrame, images: DataFrame, angle: str, width: str, height: str, background: tuple[int, int, int], phases: list[list[int]]) -> DataFrame:
    """Any rotation about the centre with 4x4 bicubic taps and 64 sub-pixel phases.

    Taps outside the source read the background, and a source line wholly outside is plain background. Rows are rounded per line first and then across
    lines, as integer arithmetic asks for.
    """
    weights = np.array(phases)

    def read(window, left, top, w, h, x, line, background):
        px, py = line["ax"] + x * line["bx"], line["ay"] + x * line["by"]
        sx, sy = px >> 16, py >> 16
        wx, wy = weights[(px & 65535) >> 10], weights[(py & 65535) >> 10]
        total = 0
        for j in range(4):
            ty = sy + j - 1
            along = sum(tiles.window_at(window, left, top, w, h, sx + i - 1, ty, background) * wx[..., i, None] for i in range(4))
            real = ((ty >= 0) & (ty < h))[..., None]
            total = total + np.where(real, (along + 8192) >> 14, background) * wy[..., j, None]
        near = ((sx >= -1) & (sx <= w) & (sy >= -1) & (sy <= h))[..., None]
        return np.where(near, np.clip((total + 8192) >> 14, 0, 255), background)

    return _gathered(pixels, _sized(images, width, height), _inverse(angle, True), 2, read, background)


# --- perspective -----------------------------------------------------------------------------

#: a trapezoid is named by the SQL expressions x1s, x1e (upper side), x2s, x2e (lower side), y1, y2
Trapezoid = dict[str, str]


def _source_line(t: Trapezoid, target_h: str, line: str) -> str:
    """16.16 source y of a target line: a / (y + c) + b for a real trapezoid, else even steps."""
    height = f"(({t['y2']}) - ({t['y1']}))"
    w1, w2 = f"(({t['x1e']}) - ({t['x1s']}))", f"(({t['x2e']}) - ({t['x2s']}))"
    d1, d2 = f"(({t['x1s']}) - ({t['x2s']}))", f"(({t['x1e']}) - ({t['x2e']}))"
    narrow = f"(CASE WHEN {w1} < {w2} THEN least({w1}, {w2}) ELSE -least({w1}, {w2}) END)"
    m1, m2 = f"(cast({height} AS double) / nullif({d1}, 0))", f"(cast({height} AS double) / nullif({d2}, 0))"
    apex = (
        f"(CASE WHEN {d1} = 0 AND {d2} = 0 THEN 0.0D WHEN {d1} = 0 THEN -{narrow} * {m2} WHEN {d2} = 0 THEN {narrow} * {m1} "
        f"WHEN abs({m2} - {m1}) < 1e-9D THEN 0.0D ELSE {narrow} * {m1} * {m2} / nullif({m2} - {m1}, 0.0D) END)"
    )
    full = f"({apex} + {height})"
    grows = f"{w1} < {w2}"
    a = f"({full} * ({height} - {full}))"
    b = f"(CASE WHEN {grows} THEN {full} ELSE {height} - {full} END)"
    c = f"(CASE WHEN {grows} THEN {full} - {height} ELSE -{full} END)"
    factor = f"(65536.0D * (h - 1) / nullif({target_h} - 1, 0))"
    bent = f"greatest(0, least(65536L * (h - 1), cast({factor} * ({a} / nullif({line} + {c}, 0.0D) + {b}) + 0.5D AS bigint)))"
    step = f"(CASE WHEN {target_h} <= h THEN (65536L * h) div ({target_h}) + 1 WHEN {target_h} = 1 THEN 0L ELSE (65536L * (h - 1) + 65535) div ({target_h} - 1) END)"
    return f"CASE WHEN {apex} > 0 THEN {bent} ELSE {line} * {step} END"


def perspective_point(pixels: DataFrame, images: DataFrame, t: Trapezoid, width: str, height: str, background: tuple[int, int, int]) -> DataFrame:
    """Trapezoid correction with nearest-pixel reads; the x step is linear within a line."""
    tall = f"(({t['y2']}) - ({t['y1']}))"
    left = f"((({t['x1s']}) - ({t['x2s']})) * 0.5D)"
    begin = f"({left} + y * (cast(({t['x2s']}) - ({t['x1s']}) AS double) / {tall}))"
    end = f"({left} + ({t['x1e']}) - ({t['x1s']}) + y * (cast(({t['x2e']}) - ({t['x1e']}) AS double) / {tall}))"
    step = f"(cast(65536.0D * w / nullif({end} - {begin} + 1, 0) AS bigint) + 1)"
    line = f"shiftleft(shiftright(cast({_source_line(t, '_th', 'y')} AS bigint), 16), 16)"
    terms = {"ax": f"(-{begin} * {step})", "bx": step, "ay": line, "by": "0"}
    return _gathered(pixels, _sized(images, width, height), terms, 0, _nearest, background)


def perspective_bicubic(
    pixels: DataFrame, images: DataFrame, t: Trapezoid, origin: tuple[str, str], width: str, height: str,
    background: tuple[int, int, int], phases: list[list[int]],
) -> DataFrame:
    """Trapezoid correction with bicubic taps, first across source lines, then along them.

    Source lines next to the upper and lower border are copied instead of
    filtered (kept behaviour). ``origin`` is the corner of the wanted part.
    """
    ox, oy = origin
    weights = np.array(phases)
    tall, y = f"(({t['y2']}) - ({t['y1']}))", f"(y + ({oy}))"
    begin = f"(({t['x1s']}) + {y} * (cast(({t['x2s']}) - ({t['x1s']}) AS double) / {tall}))"
    width_of = f"nullif((({t['x1e']}) + {y} * (cast(({t['x2e']}) - ({t['x1e']}) AS double) / {tall})) - {begin}, 0)"
    line = f"cast({_source_line(t, f'({tall} + 1)', y)} AS bigint)"
    terms = {"ax": f"(65536.0D * (w - 1) * (({ox}) - {begin}) / {width_of})", "bx": f"(65536.0D * (w - 1) / {width_of})", "ay": line, "by": "0"}
    flags = {"filtered": f"coalesce(shiftright({line}, 16) > 0 AND shiftright({line}, 16) < {tall} - 1, false)"}

    def read(window, left, top, w, h, x, line, background):
        px = line["ax"] + x * line["bx"]
        cx, sy = px >> 16, line["ay"] >> 16
        wx, wy = weights[(px & 65535) >> 10], weights[(line["ay"] & 65535) >> 10]
        filtered = (line["filtered"] > 0)[..., None]
        total = 0
        for i in range(4):
            sx = cx + i - 1
            column = (sx >= 0) & (sx < w)
            across, any_line = 0, np.zeros(sx.shape, bool)
            for j in range(4):
                ty = np.broadcast_to(sy + j - 1, sx.shape)
                own = tiles.window_at(window, left, top, w, h, sx, ty, np.zeros(3, np.int64))
                here = column & (ty >= 0) & (ty < h) & (filtered[..., 0] | (j == 1))
                any_line |= here
                across = across + own * wy[..., j, None]
                plain = own * 256 if j == 1 else plain if j else 0
            value = np.where(filtered, np.clip((across + 8192) >> 6, 0, 65535), plain)
            total = total + np.where(any_line[..., None], value, background * 256) * wx[..., i, None]
        near = ((cx >= -1) & (cx <= w))[..., None]
        return np.where(near, np.clip((total + 8192) >> 22, 0, 255), background)

    return _gathered(pixels, _sized(images, width, height), terms, 2, read, background, flags)

"""Look-up tables over 0..255 and the density map.

A table is one array of 256 values per image (or per distinct parameter set),
computed in place from that row, so pixels meet it in a single keyed join.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelquarry.functions.pixel import clamp, round_half_away
from pixelquarry.operators.scaling import attach_per_image, join_hot_keys

COLOURS = ("b", "g", "r")


def _steps(df: DataFrame, *steps: tuple[str, str]) -> DataFrame:
    for name, expr in steps:
        df = df.withColumn(name, F.expr(expr))
    return df


def levels(df: DataFrame) -> DataFrame:
    return df.withColumn("v_in", F.explode(F.sequence(F.lit(0), F.lit(255))))


def _table(value: str) -> str:
    """SQL for the array of 256 values of ``value``, an expression over the level ``v``."""
    return f"transform(sequence(0, 255), v -> cast({value} AS int))"


def contrast_gamma(params: DataFrame) -> DataFrame:
    """``lut`` array for every distinct (contrast, gamma)."""
    return with_contrast_gamma(params.select("contrast", "gamma").distinct())


def with_contrast_gamma(rows: DataFrame) -> DataFrame:
    """Adds ``lut``, the array for the ``contrast, gamma`` of each row.

    A curve is point-symmetric about the middle, so it is given by its rise over the distance ``d`` from there (0 to 1/2). Positive contrast ``k``: a
    line of slope 1 / (1 - k), from which a parabola is taken beyond half the height so that black and white stay. Negative contrast: the identity
    less a parabola with zeros in the middle and at the end. Gamma bends the result.
    """
    rise = "IF(_k < 0, _d + 3.0D * _k * _d * (0.5D - _d), (_d - 8.0D * _k * pow(greatest(0.0D, _d - (1.0D - _k) / 4.0D) / (1.0D + _k), 2)) / (1.0D - _k))"
    for name, value in (("_k", "least(0.5D, greatest(-0.5D, contrast)) / 2.0D"), ("_d", "abs(v / 255.0D - 0.5D)")):
        rise = rise.replace(name, f"({value})")
    curve = f"greatest(0.0D, least(1.0D, 0.5D + IF(v < 128, -1, 1) * ({rise})))"
    level = f"0.5D + 255.0D * pow({curve}, least(10.0D, greatest(0.1D, gamma)))"
    return rows.withColumn("lut", F.expr(_table(level)))


#: Name of a term -> (weight without, weight with saturation): factor = without + with * saturation
SATURATION_TERMS = {
    "red_self": (0.299, 0.701), "green_other": (0.587, -0.587), "blue_other": (0.114, -0.114),
    "red_other": (0.299, -0.299), "green_self": (0.587, 0.413), "blue_self": (0.114, 0.886),
}


def _sat_term(name: str, value: str, saturation: str) -> str:
    base, weight = SATURATION_TERMS[name]
    if weight < 0:
        factor = f"{value} * {base!r}D * (1.0D - {saturation}) * 65536.0D"
    else:
        factor = f"{value} * ({base!r}D + {weight!r}D * {saturation}) * 65536.0D"
    return round_half_away(factor)


def saturation_terms(params: DataFrame) -> DataFrame:
    """The six 16.16 fixed-point terms of the saturation matrix for every level and distinct saturation."""
    table = levels(params.select("saturation").distinct())
    return table.selectExpr("saturation", "v_in", *[f"{_sat_term(n, 'v_in', 'saturation')} AS {n}" for n in SATURATION_TERMS])


def saturate(pixels: DataFrame, saturation: str) -> DataFrame:
    """Apply the saturation matrix and clamp; ``saturation`` is SQL over the pixel row."""
    s = f"({saturation})"

    def total(*terms: tuple[str, str]) -> str:
        added = " + ".join(_sat_term(n, c, s) for n, c in terms)
        return f"cast(shiftright({clamp(added, 0, 255 * 65536)}, 16) AS int)"

    return pixels.withColumns({
        "r": F.expr(total(("red_self", "r"), ("green_other", "g"), ("blue_other", "b"))),
        "g": F.expr(total(("red_other", "r"), ("green_self", "g"), ("blue_other", "b"))),
        "b": F.expr(total(("red_other", "r"), ("green_other", "g"), ("blue_self", "b"))),
    })


def correction_strength(amount: float = 0.5, factor: float = 0.5) -> float:
    """Exponent of the point correction from the general amount and the image's own factor (both 0..1, 0.5 is neutral)."""
    one, two = (100.0 if v == 0 else math.log(v) / math.log(0.5) for v in (amount, factor))
    return max(1e-4, one * two)


def auto_contrast(points: DataFrame, casts: DataFrame, strength: float = 1.0, colour: float = 0.0, brightness: float = 1.0,
                  shifts: tuple[float, float, float] = (0.0, 0.0, 0.0), brightness_strength: float = 0.2) -> DataFrame:
    """Arrays ``lut_b, lut_g, lut_r`` per image from its black/white points, means and colour cast.

    ``shifts`` are the wanted cyan-red, magenta-green and yellow-blue corrections.
    """
    # one row per image: every value below is a handful of arithmetic on it
    wide = points.groupBy("image_id").agg(*[
        F.max(F.when(F.col("channel") == c, F.col(p))).alias(f"{p}_{c}") for c in ("b", "g", "r", "gray") for p in ("black", "white")
    ])
    facts = wide.join(casts, "image_id")
    # points far inside the range are corrected less, and less again for a narrow gray range
    width = f"pow(white_gray - black_gray, {strength * 0.5!r}D)"
    facts = facts.withColumns({
        **{f"_lo_{c}": F.expr(f"black_{c} * pow((1.0D - black_{c}) * (1.0D - black_gray), {strength!r}D) * {width}") for c in COLOURS},
        **{f"_hi_{c}": F.expr(f"1.0D - (1.0D - white_{c}) * pow(white_{c} * white_gray, {strength!r}D) * {width}") for c in COLOURS},
    })
    facts = facts.withColumns({"_lo": F.expr("(_lo_b + _lo_g + _lo_r) / 3.0D"), "_hi": F.expr("(_hi_b + _hi_g + _hi_r) / 3.0D")})
    facts = facts.withColumns({"_slope": F.expr("1.0D / nullif(_hi - _lo, 0.0D)"), "_mid": F.expr("(_hi + _lo) * 0.5D")})
    mean_cast = "((cast_b + cast_g + cast_r) / 3.0D)"
    largest = f"greatest(abs(cast_b - {mean_cast}), abs(cast_g - {mean_cast}), abs(cast_r - {mean_cast}))"
    room = f"(0.05D / greatest(0.00001D, {largest}))"
    weight = f"2.0D * (2.0D * {room} - 1.0D) * {colour!r}D + 1.0D" if colour > 0 else f"2.0D * ({room} + 1.0D) * {colour!r}D + 1.0D"
    facts = facts.withColumn("_weight", F.expr(weight))
    wanted = dict(zip("rgb", shifts))
    facts = facts.withColumns({
        f"_bend_{c}": F.expr(
            f"_slope * (_mid - _lo) - (_mid - _lo_{c}) / greatest(0.001D, _hi_{c} - _lo_{c}) - _weight * cast_{c} + 0.3D * {float(wanted[c])!r}D")
        for c in COLOURS
    })
    gray = "((b_mean * 0.1D + g_mean * 0.6D + r_mean * 0.3D) / 255.0D)"
    undo = "greatest(0.0D, _mid * (1.0D - _slope) + _lo * _slope)"
    facts = facts.withColumn("_lift", F.expr(
        f"{undo} - _bend_b * 0.1D - _bend_g * 0.6D - _bend_r * 0.3D "
        f"+ CASE WHEN {gray} < 0.5D THEN (0.5D - {gray}) * {brightness_strength * brightness!r}D ELSE 0.0D END"))
    # a channel without width keeps the full range
    facts = facts.withColumns({
        **{f"_l_{c}": F.expr(f"IF(_hi_{c} - _lo_{c} < 0.001D, 0.0D, _lo_{c})") for c in COLOURS},
        **{f"_h_{c}": F.expr(f"IF(_hi_{c} - _lo_{c} < 0.001D, 1.0D, _hi_{c})") for c in COLOURS},
        **{f"_top_{c}": F.expr(f"_bend_{c} + _lift") for c in COLOURS},
    })
    return facts.select("image_id", *[F.expr(_table(_curve(c))).alias(f"lut_{c}") for c in COLOURS])


def _curve(c: str) -> str:
    """Line between the two points of channel ``c`` plus a parabola that is highest at the middle."""
    x, lo, hi = "(v / 255.0D)", f"_l_{c}", f"_h_{c}"
    y = f"(({x} - {lo}) / ({hi} - {lo}))"
    u = f"coalesce(({x} - _mid) / nullif(IF({x} < _mid, _mid - {lo}, {hi} - _mid), 0.0D), 0.0D)"
    bent = f"floor(greatest(0.0D, least(1.0D, {y} + _top_{c} * (1.0D - pow({u}, 2)))) * 255.0D + 0.5D)"
    return f"CASE WHEN {y} < 0 THEN 0 WHEN {y} > 1 THEN 255 ELSE {bent} END"


def compose(first: DataFrame, then: DataFrame, pairs: DataFrame, **kw) -> DataFrame:
    """``then(first(v))`` per image; ``first`` is one array ``lut`` per ``lut_id``, a missing side is the identity.

    ``pairs`` maps each ``image_id`` to the ``lut_id`` of its single-channel
    table; a table shared by very many images is spread by salt.
    """
    return composed(join_hot_keys(pairs, first, ["lut_id"], "left", **kw).join(then, "image_id", "left"))


def composed(both: DataFrame, *keep: str) -> DataFrame:
    """Arrays of ``lut_c(lut(v))`` from rows that hold ``lut`` and the three channel arrays (each may be NULL)."""
    same = "sequence(0, 255)"
    return both.select(
        "image_id", *keep,
        *[F.expr(f"transform(coalesce(lut, {same}), v -> element_at(coalesce(lut_{c}, {same}), v + 1))").alias(f"lut_{c}") for c in COLOURS],
    )


def apply_luts(pixels: DataFrame, arrays: DataFrame) -> DataFrame:
    """Map each channel through its image's table; ``arrays`` carries image_id, w, h and three arrays."""
    joined = attach_per_image(pixels, arrays.select("image_id", "w", "h", *[f"lut_{c}" for c in COLOURS]))
    for c in COLOURS:
        joined = joined.withColumn(c, F.element_at(f"lut_{c}", F.col(c) + 1))
    return joined.drop(*[f"lut_{c}" for c in COLOURS])


# --- density map -----------------------------------------------------------------------------

#: Saddle-shaped response to the local brightness: its distance from the middle to the power 2.5, and the full range keeps its ends.
RESPONSE = "cast(127.49D - sign(_gray - 127.5D) * pow(abs(_gray - 127.5D), 2.5D) / pow(127.5D, 1.5D) AS int)"
BLOCK_GRAY = "cast(shiftright(b * 256 + g * 512 + r * 256, 10) AS int)"


def density_map(blocks: DataFrame) -> DataFrame:
    """Response of each block, with dark blue blocks lifted less; smoothed with a triangle of three."""
    cast = "(b - greatest(g, r))"
    lifted = (
        f"CASE WHEN {cast} > 0 AND _gray < 128 THEN _gray + CASE WHEN {cast} <= 30 THEN (128 - _gray) * {cast} div 30 "
        f"ELSE (128 - _gray) * (255 - {cast}) div 225 END ELSE _gray END"
    )
    raw = blocks.withColumn("_gray", F.expr(BLOCK_GRAY)).withColumn("_gray", F.expr(lifted).cast("int")).withColumn("m", F.expr(RESPONSE))
    return smooth3(raw.select("image_id", "w", "h", "x", "y", "m"))


def smooth3(mask: DataFrame) -> DataFrame:
    """Three-tap smoothing along x, then along y; masks with a side up to 2 stay as they are.

    A window holds one line of one mask, whose length is bounded by the image side.
    """
    for across, along, last in (("y", "x", "w"), ("x", "y", "h")):
        w = Window.partitionBy("image_id", across).orderBy(along)
        near = mask.withColumn("_p", F.lag("m").over(w)).withColumn("_n", F.lead("m").over(w))
        value = (
            f"CASE WHEN w <= 2 OR h <= 2 THEN m WHEN {along} = 0 THEN shiftright(m * 768 + _n * 256, 10) "
            f"WHEN {along} = {last} - 1 THEN shiftright(m * 768 + _p * 256, 10) ELSE shiftright(_p * 128 + m * 768 + _n * 128, 10) END"
        )
        mask = near.withColumn("m", F.expr(value).cast("int")).drop("_p", "_n")
    return mask


def scale_map(mask: DataFrame, lighten: float = 0.5, darken: float = 0.25) -> DataFrame:
    """Scale deviations from 127, with separate strengths above and below."""
    up, down = (int(min(1.0, max(0.0, v)) * 65536 + 0.5) for v in (lighten, darken))
    return mask.withColumn("m", F.expr(f"cast(CASE WHEN m <= 127 THEN 127 - shiftright((127 - m) * {down}, 16) ELSE 127 + shiftright((m - 127) * {up}, 16) END AS int)"))


def density_gain(points: DataFrame) -> DataFrame:
    """Array ``gain`` per image: a window from the black to the white point, zero at and outside both, full over the middle two fifths.

    Over the first three tenths it rises as a power, over the last three tenths it falls straight.
    """
    place = "((v / 255.0D - black_pt) / nullif(white_pt - black_pt, 0.0D))"
    power = "greatest(0.0D, least(1.0D, 1.0D - 0.98D * steepness))"
    window = f"least(1.0D, pow({place} / 0.3D, {power}), (1.0D - {place}) / 0.3D)"
    gain = f"IF(white_pt > black_pt AND v / 255.0D >= black_pt AND v / 255.0D < white_pt, floor(0.8D * 16384.0D * {window} + 0.5D), 0)"
    return points.select("image_id", F.expr(_table(gain)).alias("gain"))


def density_facts(mask: DataFrame, gain: DataFrame) -> DataFrame:
    """Map and gain as one array each per image. A map has at most some 7 500 cells, a gain 256 entries."""
    cells = mask.groupBy("image_id").agg(F.max("w").alias("map_w"), F.max("h").alias("map_h"), F.array_sort(F.collect_list(F.struct("y", "x", "m"))).alias("_c"))
    cells = cells.select("image_id", "map_w", "map_h", F.transform("_c", lambda c: c["m"]).alias("map"))
    return cells.join(gain.select("image_id", "gain"), "image_id")


def density_correct(pixels: DataFrame, facts: DataFrame) -> DataFrame:
    """Add the bilinearly read map value times the gain; images up to 2 pixels wide or high stay as they are."""
    joined = attach_per_image(pixels, facts.select("image_id", "w", "h", "map_w", "map_h", "map", "gain"))
    steps = [
        ("_ix", "CASE WHEN map_w = 1 OR w <= 2 THEN 0 ELSE (65536 * (map_w - 1)) div (w - 1) - 1 END"),
        ("_iy", "CASE WHEN map_h = 1 OR h <= 2 THEN 0 ELSE (65536 * (map_h - 1)) div (h - 1) - 1 END"),
        ("_cx", "cast(x * _ix AS bigint)"), ("_cy", "cast(y * _iy AS bigint)"),
        ("_col", "cast(shiftright(_cx, 16) AS int)"), ("_row", "cast(shiftright(_cy, 16) AS int)"),
        ("_col1", "least(_col + 1, map_w - 1)"), ("_row1", "least(_row + 1, map_h - 1)"),
        ("_tl", "element_at(map, _row * map_w + _col + 1)"), ("_tr", "element_at(map, _row * map_w + _col1 + 1)"),
        ("_bl", "element_at(map, _row1 * map_w + _col + 1)"), ("_br", "element_at(map, _row1 * map_w + _col1 + 1)"),
        ("_left", "shiftright((_cy & 65535) * (_bl - _tl), 16) + _tl"), ("_right", "shiftright((_cy & 65535) * (_br - _tr), 16) + _tr"),
        ("_mask", "shiftright((_cx & 65535) * (_right - _left), 16) + _left - 127"),
    ]
    done = _steps(joined, *steps)
    for c in COLOURS:
        done = done.withColumn(c, F.expr(f"CASE WHEN w <= 2 OR h <= 2 THEN {c} ELSE cast({clamp(f'{c} + shiftright(_mask * element_at(gain, {c} + 1), 14)')} AS int) END"))
    return done.select(*pixels.columns)

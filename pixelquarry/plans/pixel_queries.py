"""Queries over pixel sets, look-up tables, kernels and content keys."""

import re
import uuid

from pyspark.sql import functions as F

from pixelquarry.operators import hashes, kernels, luts, stages, stats
from pixelquarry.operators import pixels as px
from pixelquarry.operators.scaling import join_hot_keys
from pixelquarry.plans import views
from pixelquarry.plans.registry import Registry
from pixelquarry.plans.stats_queries import BLOCKS, CAST, H8, HIST, MEANS, RUNS
from pixelquarry.session import shared_folder

R = Registry()
PX = ["image_id", "w", "h", "x", "y", "b", "g", "r"]
CLAMP = "greatest(0, least(255, {}))"


def p8(s, d):
    return views.pixels(s, d).select(*PX)


def wide8(s, d):
    """The pixels of 8x8 images as 16x4 ones, so that width and height differ."""
    return p8(s, d).selectExpr("image_id", "16 AS w", "4 AS h", "(y * 8 + x) % 16 AS x", "cast((y * 8 + x) div 16 AS int) AS y", "b", "g", "r")


WIDE = "wide AS (SELECT image_id, 16 AS w, 4 AS h, (y * 8 + x) % 16 AS x, (y * 8 + x) // 16 AS y, b, g, r FROM pixels)"

# --- moves and fills -------------------------------------------------------------------------

R.add("px_rotate90", f"""WITH {WIDE} SELECT image_id, 90 AS angle, h AS w, w AS h, h - 1 - y AS x, x AS y, b, g, r FROM wide UNION ALL
 SELECT image_id, 180, w, h, w - 1 - x, h - 1 - y, b, g, r FROM wide UNION ALL SELECT image_id, 270, h, w, y, w - 1 - x, b, g, r FROM wide""", "pixels")(
    lambda s, d: px.rotate90(wide8(s, d), 90).withColumn("angle", F.lit(90))
    .unionByName(px.rotate90(wide8(s, d), 180).withColumn("angle", F.lit(180)))
    .unionByName(px.rotate90(wide8(s, d), 270).withColumn("angle", F.lit(270))))
R.add("px_mirror", f"""WITH {WIDE} SELECT image_id, 'h' AS how, w, h, w - 1 - x AS x, y, b, g, r FROM wide UNION ALL SELECT image_id, 'v', w, h, x, h - 1 - y, b, g, r FROM wide""", "pixels")(
    lambda s, d: px.mirror(wide8(s, d)).withColumn("how", F.lit("h")).unionByName(px.mirror(wide8(s, d), False).withColumn("how", F.lit("v"))))
R.add("px_crop", "SELECT image_id, 10 AS w, 17 AS h, x - 7 AS x, y - 3 AS y, b, g, r FROM pixels32 WHERE x >= 7 AND x < 17 AND y >= 3 AND y < 20", "pixels32")(
    lambda s, d: px.crop(views.pixels32(s, d), 7, 3, 17, 20))
R.add("px_paste", f"""SELECT t.image_id, t.w, t.h, t.x, t.y, coalesce(s.b, t.b) AS b, coalesce(s.g, t.g) AS g, coalesce(s.r, t.r) AS r FROM pixels t
 LEFT JOIN pixels s ON t.x >= 4 AND t.x < 7 AND t.y >= 2 AND t.y < 6 AND s.image_id = t.image_id + 1 AND s.x = t.x - 3 AND s.y = t.y - 1 AND t.image_id % 2 = 0""", "pixels")(
    lambda s, d: px.paste(p8(s, d), p8(s, d), p8(s, d).select("image_id", "w", "h").distinct().filter("image_id % 2 = 0").selectExpr("image_id", "image_id + 1 AS src_id", "w", "h"), (1, 1), (4, 2), (3, 4)))
R.add("px_dim_rect", f"""SELECT image_id, w, h, x, y, """ + ", ".join(f"CASE WHEN x >= 2 AND x < 99 AND y >= 0 AND y < 5 THEN ({c} * 29491) >> 16 ELSE {c} END AS {c}" for c in "bgr") + " FROM pixels", "pixels")(
    lambda s, d: px.dim_rect(p8(s, d), (2, -3, 99, 5), 0.45))
R.add("px_fill_rect", """SELECT image_id, w, h, x, y, CASE WHEN on_line THEN 192 WHEN fill THEN 1 ELSE b END AS b, CASE WHEN on_line THEN 192 WHEN fill THEN 2 ELSE g END AS g, CASE WHEN on_line THEN 192 WHEN fill THEN 3 ELSE r END AS r
 FROM (SELECT *, x >= 5 AND x < 9 AND y >= 5 AND y < 30 AS fill, x IN (0, 10, 20, 31) OR y IN (0, 10, 20, 31) AS on_line FROM pixels32)""", "pixels32")(
    lambda s, d: px.grid_lines(px.fill_rect(views.pixels32(s, d), (5, 5, 9, 30), (1, 2, 3)), max_cells=8, min_cell=10))


@R.add("px_palette", "SELECT image_id, w, h, x, y, (g * 3 + label) % 256 AS b, (g * 5 + label) % 256 AS g, (g * 7 + label) % 256 AS r FROM pixels", "pixels")
def px_palette(s, d):
    rows = views.pixels(s, d)
    palettes = rows.select("image_id", "w", "h", "label").distinct().withColumn(
        "palette", F.expr("transform(sequence(0, 255), i -> (i * 3 + label) % 256 + ((i * 5 + label) % 256) * 256 + ((i * 7 + label) % 256) * 65536)"))
    return px.apply_palette(rows.selectExpr("image_id", "w", "h", "x", "y", "g AS idx"), palettes)


R.add("px_widen", "SELECT image_id, w, h, x, y, (b * 64 + 63) >> 6 AS b, (b * 64 + 63) >> 6 AS g, (b * 64 + 63) >> 6 AS r FROM pixels", "pixels")(
    lambda s, d: px.gray14_to_bgr(p8(s, d).selectExpr("image_id", "w", "h", "x", "y", "b * 64 + 63 AS gray14")))
R.add("px_alpha_blend", "SELECT image_id, w, h, x, y, " + ", ".join(f"trunc(({c} * a + {v} * (255 - a)) / 255.0::DOUBLE + 0.5)::BIGINT AS {c}" for c, v in (("b", 30), ("g", 20), ("r", 10))) + " FROM (SELECT *, (b + x * 9) % 256 AS a FROM pixels)", "pixels")(
    lambda s, d: px.alpha_blend(p8(s, d).withColumn("a", F.expr("(b + x * 9) % 256")), (30, 20, 10)))
GRAY14 = "((trunc(0.299::DOUBLE * b * 65536.0 + 0.5)::BIGINT + trunc(0.587::DOUBLE * g * 65536.0 + 0.5)::BIGINT + trunc(0.114::DOUBLE * r * 65536.0 + 0.5)::BIGINT + 32767) >> 10)"
R.add("px_gray14", f"SELECT image_id, x, y, {GRAY14} AS gray14 FROM pixels", "pixels")(
    lambda s, d: px.gray14(p8(s, d)).select("image_id", "x", "y", "gray14"))

# --- sampling --------------------------------------------------------------------------------

_POINT = """SELECT p.image_id, {tw} AS w, {th} AS h, tx.i AS x, ty.i AS y, p.b, p.g, p.r FROM pixels32 p, range(0, {tw}) tx(i), range(0, {th}) ty(i) WHERE p.x = (tx.i * {ix}) >> 16 AND p.y = (ty.i * {iy}) >> 16"""
R.add("px_resize_point", _POINT.format(tw=13, th=20, ix=32 * 65536 // 13 + 1, iy=32 * 65536 // 20 + 1) + " UNION ALL " + _POINT.format(tw=40, th=35, ix=(65536 * 31 + 65535) // 39, iy=(65536 * 31 + 65535) // 34), "pixels32")(
    lambda s, d: px.resize_point(views.pixels32(s, d), "13", "20").unionByName(px.resize_point(views.pixels32(s, d), "40", "35")))
_GW = 4 * ((int(64 / 16 * (1500 / (64 / 16)) ** 0.5) + 3) // 4)
_GH = 4 * ((int(_GW / (64 / 16)) + 3) // 4)
R.add("point_sample_grid", f"""WITH p AS (SELECT image_id, (y % 2) * 32 + x AS x, y // 2 AS y, b, g, r FROM pixels32)
 SELECT p.image_id, {_GW} AS w, {_GH} AS h, tx.i AS x, ty.i AS y, p.b, p.g, p.r FROM p, range(0, {_GW}) tx(i), range(0, {_GH}) ty(i)
 WHERE p.x = (tx.i * {64 * 65536 // _GW}) >> 16 AND p.y = (ty.i * {16 * 65536 // _GH}) >> 16""", "pixels32")(
    lambda s, d: px.sample_grid(views.pixels32(s, d).selectExpr("image_id", "64 AS w", "16 AS h", "(y % 2) * 32 + x AS x", "cast(y div 2 AS int) AS y", "b", "g", "r"), 1500))

# --- tables ----------------------------------------------------------------------------------


def chain(start: str, steps: list[tuple[str, str]], name: str = "s") -> tuple[str, str]:
    """Nested common table expressions that add one named column each; returns text and last name."""
    parts, last = [], start
    for i, (column, expr) in enumerate(steps):
        expr = re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1::DOUBLE", expr)
        parts.append(f"{name}{i} AS (SELECT *, {expr} AS {column} FROM {last})")
        last = f"{name}{i}"
    return ", ".join(parts), last



#: contrast/gamma curve for DuckDB, over contrast, gamma, v_in: rise over the distance from the middle, mirrored about it
CONTRAST_GAMMA = [
    ("_k", "greatest(-0.5, least(0.5, contrast)) / 2.0"),
    ("_d", "abs(v_in / 255.0 - 0.5)"),
    ("_rise", "CASE WHEN _k < 0 THEN _d + 3.0 * _k * _d * (0.5 - _d) ELSE (_d - 8.0 * _k * pow(greatest(0.0, _d - (1.0 - _k) / 4.0) / (1.0 + _k), 2)) / (1.0 - _k) END"),
    ("_y", "greatest(0.0, least(1.0, 0.5 + CASE WHEN v_in < 128 THEN -_rise ELSE _rise END))"),
    ("_out", "floor(0.5 + 255.0 * pow(_y, greatest(0.1, least(10.0, gamma))))"),
]


def _auto_steps(strength: float, colour: float, brightness: float, shifts: tuple[float, float, float], brightness_strength: float) -> list[tuple[str, str]]:
    """Named steps from points, means and casts of one image to its three curves (plain SQL).

    Inputs: ``black_*, white_*`` for b, g, r, gray; ``*_mean``; ``cast_*``.
    ``shifts`` are the wanted cyan-red, magenta-green and yellow-blue corrections.
    """
    shift = dict(zip("rgb", shifts))
    steps = [("_width", f"pow(white_gray - black_gray, {strength * 0.5!r})")]
    for c in "bgr":
        steps.append((f"_bk_{c}", f"black_{c} * pow((1.0 - black_{c}) * (1.0 - black_gray), {strength!r}) * _width"))
        steps.append((f"_wh_{c}", f"1.0 - (1.0 - white_{c}) * pow(white_{c} * white_gray, {strength!r}) * _width"))
    steps += [
        ("_mb", "(_bk_b + _bk_g + _bk_r) / 3.0"),
        ("_mw", "(_wh_b + _wh_g + _wh_r) / 3.0"),
        ("_a", "1.0 / nullif(_mw - _mb, 0.0)"),
        ("_sh", "-_mb * _a"),
        ("_mid", "(_mw + _mb) * 0.5"),
        ("_lift0", "greatest(0.0, _mid * (1.0 - _a) - _sh)"),
        ("_ymid", "_a * _mid + _sh"),
        ("_cmean", "(cast_b + cast_g + cast_r) / 3.0"),
        ("_cmax", "greatest(abs(cast_b - _cmean), abs(cast_g - _cmean), abs(cast_r - _cmean))"),
        ("_cfact", "0.05 / greatest(0.00001, _cmax)"),
        ("_cmult", f"2.0 * (2.0 * _cfact - 1.0) * {colour!r} + 1.0" if colour > 0 else f"2.0 * (_cfact + 1.0) * {colour!r} + 1.0"),
    ]
    for c in "bgr":
        span = f"greatest(0.001, _wh_{c} - _bk_{c})"
        steps.append((f"_k_{c}", f"_ymid - (_mid - _bk_{c}) / {span} - _cmult * cast_{c} + 0.3 * {float(shift[c])!r}"))
    steps += [
        ("_gray", "(b_mean * 0.1 + g_mean * 0.6 + r_mean * 0.3) / 255.0"),
        ("_add", f"CASE WHEN _gray < 0.5 THEN (0.5 - _gray) * {brightness_strength * brightness!r} ELSE 0.0 END"),
        ("_lift", "(_lift0 - _k_b) * 0.1 + (_lift0 - _k_g) * 0.6 + (_lift0 - _k_r) * 0.3 + _add"),
    ]
    return steps


def curve_steps(c: str) -> list[tuple[str, str]]:
    """Named steps of one channel's curve at ``v_in`` (plain SQL)."""
    return [
        (f"_flat_{c}", f"_wh_{c} - _bk_{c} < 0.001"),
        (f"_lo_{c}", f"CASE WHEN _flat_{c} THEN 0.0 ELSE _bk_{c} END"),
        (f"_hi_{c}", f"CASE WHEN _flat_{c} THEN 1.0 ELSE _wh_{c} END"),
        (f"_y_{c}", f"(v_in / 255.0 - _lo_{c}) / (_hi_{c} - _lo_{c})"),
        (f"_u_{c}", f"coalesce((v_in / 255.0 - _mid) / nullif(CASE WHEN v_in / 255.0 < _mid THEN _mid - _lo_{c} ELSE _hi_{c} - _mid END, 0.0), 0.0)"),
        (
            f"lut_{c}",
            f"CASE WHEN _y_{c} < 0 THEN 0 WHEN _y_{c} > 1 THEN 255 "
            f"ELSE floor(greatest(0.0, least(1.0, _y_{c} + (_k_{c} + _lift) * (1.0 - _u_{c} * _u_{c}))) * 255.0 + 0.5) END",
        ),
    ]


#: gain between black and white point at ``v_in`` (plain SQL); inputs black_pt, white_pt, steepness
DENSITY_GAIN = [
    ("_t", "(v_in / 255.0 - black_pt) / nullif(white_pt - black_pt, 0.0)"),
    ("_inside", "white_pt > black_pt AND v_in / 255.0 >= black_pt AND v_in / 255.0 < white_pt"),
    ("_up", "pow(greatest(0.0, _t) / 0.3, greatest(0.0, least(1.0, 1.0 - 0.98 * steepness)))"),
    ("_gain", "CASE WHEN _inside THEN floor(0.8 * 16384.0 * least(1.0, _up, (1.0 - _t) / 0.3) + 0.5) ELSE 0 END"),
]

_cg, _cgl = chain("cgv", CONTRAST_GAMMA, "cg")
CGAMMA = f"cgp AS (SELECT DISTINCT contrast, gamma FROM params), cgv AS (SELECT *, unnest(range(0, 256)) AS v_in FROM cgp), {_cg}"
R.add("lut_contrast_gamma", f"WITH {CGAMMA} SELECT contrast, gamma, v_in, _out::BIGINT AS v_out FROM {_cgl}", "params")(
    # not posexplode: Spark would test the size of each row's array before the distinct, and so make the array for every row of the table
    lambda s, d: luts.contrast_gamma(views.params(s, d)).select("contrast", "gamma", F.posexplode_outer("lut").alias("v_in", "v_out")))

_ROUND = "trunc(CASE WHEN {v} < 0 THEN {v} - 0.5 ELSE {v} + 0.5 END)::BIGINT"
_TERMS = {
    "red_self": "{i} * (0.299::DOUBLE + 0.701::DOUBLE * {s}) * 65536.0", "green_other": "{i} * 0.587::DOUBLE * (1.0 - {s}) * 65536.0", "blue_other": "{i} * 0.114::DOUBLE * (1.0 - {s}) * 65536.0",
    "red_other": "{i} * 0.299::DOUBLE * (1.0 - {s}) * 65536.0", "green_self": "{i} * (0.587::DOUBLE + 0.413::DOUBLE * {s}) * 65536.0", "blue_self": "{i} * (0.114::DOUBLE + 0.886::DOUBLE * {s}) * 65536.0",
}


def term(name, i, s):
    return _ROUND.format(v="(" + _TERMS[name].format(i=i, s=s) + ")")


R.add("lut_saturation", "WITH t AS (SELECT *, unnest(range(0, 256)) AS v_in FROM (SELECT DISTINCT saturation FROM params)) SELECT saturation, v_in, "
      + ", ".join(f"{term(n, 'v_in', 'saturation')} AS {n}" for n in _TERMS) + " FROM t", "params")(lambda s, d: luts.saturation_terms(views.params(s, d)))


def sat_duck(src, s):
    def one(*ts):
        return "greatest(0, least(16711680, " + " + ".join(term(n, c, s) for n, c in ts) + ")) >> 16"
    return (f"SELECT image_id, w, h, x, y, {one(('red_other', 'r'), ('green_other', 'g'), ('blue_self', 'b'))} AS b, {one(('red_other', 'r'), ('green_self', 'g'), ('blue_other', 'b'))} AS g, "
            f"{one(('red_self', 'r'), ('green_other', 'g'), ('blue_other', 'b'))} AS r FROM {src}")


_ac, _acl = chain("acw", _auto_steps(1.0, 0.25, 1.0, (0.1, 0.0, -0.2), 0.2), "ac")
_cv, _cvl = chain("cvv", [st for c in "bgr" for st in curve_steps(c)], "cv")
POINTS = """lv AS (SELECT *, floor(total * 0.05::DOUBLE + 0.5::DOUBLE)::BIGINT AS level FROM runs), pts AS (SELECT image_id, channel, CASE WHEN max(level) = 0 THEN 0.0::DOUBLE ELSE min(bin) FILTER (WHERE cum_up >= level) / 255.0::DOUBLE END AS black,
  CASE WHEN max(level) = 0 THEN 1.0::DOUBLE ELSE max(bin) FILTER (WHERE cum_down >= level) / 255.0::DOUBLE END AS white FROM lv GROUP BY 1, 2)"""
AUTO = f"""{H8}, {RUNS}, {MEANS}, {CAST}, {POINTS}, pw AS (SELECT image_id, """ + ", ".join(
    f"max(CASE WHEN channel = '{c}' THEN {p} END) AS {p}_{c}" for c in ("b", "g", "r", "gray") for p in ("black", "white")) + f""" FROM pts GROUP BY 1),
 acw AS (SELECT * FROM pw JOIN casts USING (image_id)), {_ac}, cvv AS (SELECT *, unnest(range(0, 256)) AS v_in FROM {_acl}), {_cv}"""


def long_luts(arrays):
    # zipped first: columns carried past a generator would be computed again for every row it makes
    rows = arrays.select("image_id", F.posexplode(F.arrays_zip("lut_b", "lut_g", "lut_r")).alias("v_in", "l"))
    return rows.select("image_id", "v_in", "l.lut_b", "l.lut_g", "l.lut_r")


def auto_luts(s, d):
    hist = stats.hist_exact(p8(s, d))
    return luts.auto_contrast(stats.bw_points(hist, 0.05), stats.color_cast(stats.hist_means(hist)), strength=1.0, colour=0.25, shifts=(0.1, 0.0, -0.2))


R.add("lut_auto_contrast", f"WITH {AUTO} SELECT image_id, v_in, lut_b::BIGINT AS lut_b, lut_g::BIGINT AS lut_g, lut_r::BIGINT AS lut_r FROM {_cvl}", "pixels")(
    lambda s, d: long_luts(auto_luts(s, d)))


@R.add("lut_compose", f"""WITH {AUTO}, au AS MATERIALIZED (SELECT image_id, v_in, lut_b::BIGINT AS lut_b, lut_g::BIGINT AS lut_g, lut_r::BIGINT AS lut_r FROM {_cvl}),
 {CGAMMA}, sg AS MATERIALIZED (SELECT p.hash AS lut_id, v_in, _out::BIGINT AS v_out FROM {_cgl} c JOIN params p USING (contrast, gamma)),
 pr AS (SELECT DISTINCT image_id, CASE WHEN image_id % 3 = 0 THEN -1 ELSE image_id % 40 END AS lut_id FROM pixels),
 v AS (SELECT image_id, lut_id, unnest(range(0, 256)) AS v0 FROM pr), one AS (SELECT v.image_id, v0, coalesce(sg.v_out, v0) AS v1 FROM v LEFT JOIN sg ON v.lut_id = sg.lut_id AND sg.v_in = v0)
 SELECT one.image_id, v0 AS v_in, coalesce(lut_b, v1) AS lut_b, coalesce(lut_g, v1) AS lut_g, coalesce(lut_r, v1) AS lut_r FROM one LEFT JOIN au ON au.image_id = one.image_id AND au.v_in = v1""", "pixels params")
def lut_compose(s, d):
    params = views.params(s, d)
    first = params.select(F.col("hash").alias("lut_id"), "contrast", "gamma").join(luts.contrast_gamma(params), ["contrast", "gamma"]).select("lut_id", "lut")
    pairs = p8(s, d).select("image_id").distinct().withColumn("lut_id", F.expr("IF(image_id % 3 = 0, -1, image_id % 40)"))
    return long_luts(luts.compose(first, auto_luts(s, d), pairs, hot_rows=50))


@R.add("px_apply_lut", f"""WITH {AUTO}, au AS MATERIALIZED (SELECT image_id, list(lut_b::BIGINT ORDER BY v_in) AS lb, list(lut_g::BIGINT ORDER BY v_in) AS lg, list(lut_r::BIGINT ORDER BY v_in) AS lr FROM {_cvl} GROUP BY 1)
 SELECT p.image_id, w, h, x, y, lb[b + 1] AS b, lg[g + 1] AS g, lr[r + 1] AS r FROM pixels p JOIN au ON au.image_id = p.image_id""", "pixels")
def px_apply_lut(s, d):
    return luts.apply_luts(p8(s, d), auto_luts(s, d).withColumns({"w": F.lit(8), "h": F.lit(8)}))


@R.add("px_saturate_lut", f"""WITH sat AS ({sat_duck('pixels', '((image_id % 9) / 4.0::DOUBLE)')}), {CGAMMA}, sg AS MATERIALIZED (SELECT p.hash, v_in, _out::BIGINT AS v_out FROM {_cgl} c JOIN params p USING (contrast, gamma))
 SELECT image_id, w, h, x, y, ub.v_out AS b, ug.v_out AS g, ur.v_out AS r FROM sat JOIN sg ub ON ub.hash = image_id + 1 AND ub.v_in = b JOIN sg ug ON ug.hash = image_id + 1 AND ug.v_in = g JOIN sg ur ON ur.hash = image_id + 1 AND ur.v_in = r""", "pixels params")
def px_saturate_lut(s, d):
    rows = luts.saturate(p8(s, d), "(image_id % 9) / 4.0D")
    params = views.params(s, d)
    lut = params.select((F.col("hash") - 1).alias("image_id"), "contrast", "gamma").join(luts.contrast_gamma(params), ["contrast", "gamma"]).select("image_id", "lut")
    arrays = rows.select("image_id", "w", "h").distinct().join(lut, "image_id")
    return luts.apply_luts(rows, arrays.select("image_id", "w", "h", *[F.col("lut").alias(f"lut_{c}") for c in "bgr"]))


# --- density ---------------------------------------------------------------------------------

DENSITY = f"""{BLOCKS}, dg AS (SELECT *, (b * 256 + g * 512 + r * 256) >> 10 AS gr, b - greatest(g, r) AS bc FROM blocks),
 dl AS (SELECT *, CASE WHEN bc > 0 AND gr < 128 THEN gr + CASE WHEN bc <= 30 THEN ((128 - gr) * bc) // 30 ELSE ((128 - gr) * (255 - bc)) // 225 END ELSE gr END AS v FROM dg),
 dm AS (SELECT image_id, w, h, x, y, CASE WHEN v >= 128 THEN trunc(127.0::DOUBLE - power(v - 128 + 0.5::DOUBLE, 2.5::DOUBLE) / power(127.5::DOUBLE, 1.5::DOUBLE) + 0.49)::BIGINT
   ELSE trunc(127.0::DOUBLE + power(127 - v + 0.5::DOUBLE, 2.5::DOUBLE) / power(127.5::DOUBLE, 1.5::DOUBLE) + 0.49)::BIGINT END AS m FROM dl)"""
SMOOTH = """sx AS (SELECT * EXCLUDE (m), CASE WHEN x = 0 THEN (m * 768 + nx * 256) >> 10 WHEN x = w - 1 THEN (m * 768 + pv * 256) >> 10 ELSE (pv * 128 + m * 768 + nx * 128) >> 10 END AS m FROM
   (SELECT *, lag(m) OVER q AS pv, lead(m) OVER q AS nx FROM {src} WINDOW q AS (PARTITION BY image_id, y ORDER BY x))),
 sy AS (SELECT image_id, w, h, x, y, CASE WHEN y = 0 THEN (m * 768 + n2 * 256) >> 10 WHEN y = h - 1 THEN (m * 768 + p2 * 256) >> 10 ELSE (p2 * 128 + m * 768 + n2 * 128) >> 10 END AS m FROM
   (SELECT *, lag(m) OVER q AS p2, lead(m) OVER q AS n2 FROM sx WINDOW q AS (PARTITION BY image_id, x ORDER BY y)))"""
SCALED = "sc AS MATERIALIZED (SELECT image_id, w, h, x, y, CASE WHEN m <= 127 THEN 127 - (((127 - m) * 39322) >> 16) ELSE 127 + (((m - 127) * 58982) >> 16) END AS m FROM sy)"


def blocks32(s, d):
    return stats.block_mean_4x4(views.pixels32(s, d))


R.add("density_map", f"WITH {DENSITY}, {SMOOTH.format(src='dm')} SELECT * FROM sy", "pixels32")(lambda s, d: luts.density_map(blocks32(s, d)))
R.add("mask_smooth3", f"WITH base AS (SELECT image_id, w, h, x, y, g AS m FROM pixels32), {SMOOTH.format(src='base')} SELECT * FROM sy", "pixels32")(
    lambda s, d: luts.smooth3(views.pixels32(s, d).selectExpr("image_id", "w", "h", "x", "y", "g AS m")))
R.add("density_map_scale", f"WITH {DENSITY}, {SMOOTH.format(src='dm')}, {SCALED} SELECT * FROM sc", "pixels32")(
    lambda s, d: luts.scale_map(luts.density_map(blocks32(s, d)), lighten=0.9, darken=0.6))

_gn, _gnl = chain("gnv", DENSITY_GAIN, "gn")
GP32 = f"""{HIST.format(src='pixels32')}, {RUNS}, gl AS (SELECT *, trunc(total * 0.05::DOUBLE)::BIGINT AS lim FROM runs WHERE channel = 'gray'),
 gp AS (SELECT image_id, CASE WHEN max(lim) = 0 THEN -1 ELSE min(bin) FILTER (WHERE cum_up >= lim) END / 255.0::DOUBLE AS black_pt,
  CASE WHEN max(lim) = 0 THEN 256 ELSE max(bin) FILTER (WHERE cum_down >= lim) END / 255.0::DOUBLE AS white_pt, 0.5::DOUBLE AS steepness FROM gl GROUP BY 1),
 gnv AS (SELECT *, unnest(range(0, 256)) AS v_in FROM gp), {_gn}, gains AS MATERIALIZED (SELECT image_id, v_in, _gain::BIGINT AS gain FROM {_gnl})"""


def gains32(s, d):
    points = stats.gray_points(stats.hist_exact(views.pixels32(s, d)), 0.05).withColumn("steepness", F.lit(0.5))
    return luts.density_gain(points)


R.add("lut_density_gain", f"WITH {GP32} SELECT * FROM gains", "pixels32")(
    lambda s, d: gains32(s, d).select("image_id", F.posexplode("gain").alias("v_in", "gain")))
_LDC = f"""{GP32}, {DENSITY}, {SMOOTH.format(src='dm')}, {SCALED},
 pos AS (SELECT *, x * ((65536 * 7) // 31 - 1) AS cx, y * ((65536 * 7) // 31 - 1) AS cy FROM pixels32),
 sl AS (SELECT image_id, list(m ORDER BY y, x) AS ms FROM sc GROUP BY 1), gl2 AS (SELECT image_id, list(gain ORDER BY v_in) AS gs FROM gains GROUP BY 1),
 at4 AS (SELECT p.*, ms, gs, (cy >> 16) * 8 AS up, least(7, (cy >> 16) + 1) * 8 AS down, (cx >> 16) + 1 AS west, least(7, (cx >> 16) + 1) + 1 AS east FROM pos p JOIN sl USING (image_id) JOIN gl2 USING (image_id)),
 nb AS (SELECT *, ms[up + west] AS tl, ms[up + east] AS tr, ms[down + west] AS bl, ms[down + east] AS br FROM at4),
 lr AS (SELECT *, floor((cy & 65535) * (bl - tl) / 65536.0::DOUBLE)::BIGINT + tl AS lf, floor((cy & 65535) * (br - tr) / 65536.0::DOUBLE)::BIGINT + tr AS rt FROM nb),
 mk AS (SELECT *, floor((cx & 65535) * (rt - lf) / 65536.0::DOUBLE)::BIGINT + lf - 127 AS mask FROM lr),
 ldc AS (SELECT image_id, w, h, x, y, """ + ", ".join(CLAMP.format(f"{c} + floor(mask * gs[{c} + 1] / 16384.0::DOUBLE)::BIGINT") + f" AS {c}" for c in "bgr") + """ FROM mk)"""


@R.add("px_density_correct", f"WITH {_LDC} SELECT * FROM ldc", "pixels32")
def px_density_correct(s, d):
    mask = luts.scale_map(luts.density_map(stats.block_mean_4x4(px.sample_grid(views.pixels32(s, d), 1024))), lighten=0.9, darken=0.6)
    facts = luts.density_facts(mask, gains32(s, d)).withColumns({"w": F.lit(32), "h": F.lit(32)})
    return luts.density_correct(views.pixels32(s, d), facts)


# --- kernels ---------------------------------------------------------------------------------


_D = "::DOUBLE"
_SUM = "list_reduce(list_prepend(0.0::DOUBLE, {0}), lambda s, v: s + v)"
_LOBE = "(CASE WHEN abs(x) < 1e-6 THEN 1.0 ELSE 2 * sin(pi() * x) * sin(pi() / 2 * x) / (pi() * pi() * x * x) END)"
_PROFILE = {
    "quality": "CASE WHEN abs(x) > 2 THEN 0.0::DOUBLE WHEN abs(x) < 1 THEN 1 - x * x ELSE -s * (1 - (2 * abs(x) - 3) * (2 * abs(x) - 3)) END",
    "narrow": "CASE WHEN abs(x) > 1.5 THEN 0.0::DOUBLE WHEN abs(x) < 0.5 THEN 1 - 4 * x * x ELSE -s * (1 - (2 * abs(x) - 2) * (2 * abs(x) - 2)) END",
    "lanczos": f"CASE WHEN abs(x) > 2 THEN 0.0::DOUBLE WHEN abs(x) < 1 THEN {_LOBE} ELSE s * {_LOBE} END",
}


def taps_duck(name: str, pairs: str, sharpen: float, out: str) -> str:
    """Common table expressions that end in the taps ``out`` (src_size, dst_size, dst, src, weight) of the size pairs a query gives."""
    s = f"{sharpen!r}::DOUBLE"
    mult, length, strength = {
        "quality": ("CASE WHEN fa < 2 THEN 1 / (fa - 0.5::DOUBLE) ELSE 1 / ((fa + 1) * 0.5::DOUBLE) END", "trunc(4 * ((fa + 1) * 0.5::DOUBLE) + 0.99::DOUBLE)::BIGINT", f"CASE WHEN abs(fa - 1) < 0.01 THEN 0.0::DOUBLE ELSE {s} END"),
        "narrow": ("1 / fa", "trunc(4 * fa + 0.99::DOUBLE)::BIGINT", f"{s} / 2"),
        "lanczos": ("1 / fa", "trunc(5 * fa)::BIGINT", f"1 + {s} * 7"),
        "bicubic": ("1.0::DOUBLE", "4", "0.0::DOUBLE"),
    }[name]
    if name == "bicubic":
        step = "greatest(1, CASE WHEN src_size = 1 OR dst_size = 1 THEN (src_size * 65536) // dst_size ELSE ((src_size - 1) * 65536) // (dst_size - 1) END) AS st, 0 AS b0, 1 AS o"
        raw = "[-0.5::DOUBLE * power(1 + f, 3) + 2.5::DOUBLE * power(1 + f, 2) - 4 * (1 + f) + 2, 1.5::DOUBLE * power(f, 3) - 2.5::DOUBLE * power(f, 2) + 1, 1.5::DOUBLE * power(1 - f, 3) - 2.5::DOUBLE * power(1 - f, 2) + 1, -0.5::DOUBLE * power(2 - f, 3) + 2.5::DOUBLE * power(2 - f, 2) - 4 * (2 - f) + 2]"
    else:
        step = "(src_size * 65536) // dst_size + 1 AS st, ((src_size * 65536) // dst_size - 65535) >> 1 AS b0, (le - 1) // 2 AS o"
        points = "lambda j: list_transform(range(0, 32), lambda i: mu * (j - o - f) + (-0.5::DOUBLE + i * (1.0::DOUBLE / 31)) * mu)" if name != "lanczos" else "lambda j: [mu * (j - o - f)]"
        raw = f"list_transform(list_transform(range(0, le), {points}), lambda xs: {_SUM.format(f'list_transform(xs, lambda x: {_PROFILE[name]})')})"
    rounded = "list_transform(raw, lambda v: trunc(CASE WHEN 16383 * v / t < 0 THEN 16383 * v / t - 0.5 ELSE 16383 * v / t + 0.5 END)::BIGINT)"
    return f"""{out}0 AS (SELECT *, src_size::DOUBLE / dst_size AS fa FROM (SELECT DISTINCT src_size::BIGINT AS src_size, dst_size::BIGINT AS dst_size FROM ({pairs}))),
 {out}1 AS (SELECT *, {mult} AS mu, {length} AS le, {strength} AS s FROM {out}0), {out}2 AS (SELECT *, {step} FROM {out}1), {out}3 AS (SELECT *, unnest(range(0, dst_size)) AS dst FROM {out}2),
 {out}4 AS (SELECT *, (b0 + st * dst) >> 16 AS wh, (b0 + st * dst) & 65535 AS fr FROM {out}3), {out}5 AS (SELECT *, wh < o AS lo, wh >= o AND wh - o + le > src_size AS up FROM {out}4),
 {out}6 AS (SELECT *, CASE WHEN lo OR up THEN fr ELSE (fr >> 9) * 516 END / 65535.0::DOUBLE AS f FROM {out}5), {out}7 AS (SELECT *, {raw} AS raw FROM {out}6),
 {out}8 AS (SELECT *, {_SUM.format('raw')} AS t FROM {out}7), {out}9 AS (SELECT *, {rounded} AS q FROM {out}8), {out}a AS (SELECT * EXCLUDE (q), list_prepend(q[1] + 16383 - list_sum(q)::BIGINT, q[2:]) AS q FROM {out}9),
 {out}b AS (SELECT *, CASE WHEN lo THEN q[o - wh + 1:][1:src_size] WHEN up THEN q[1:least(src_size, src_size - wh + o)] ELSE q END AS k FROM {out}a),
 {out}c AS (SELECT *, CASE WHEN (lo OR up) AND list_sum(k) > 0 THEN list_transform(k, lambda v: trunc(v * 16383 / list_sum(k)::DOUBLE)::BIGINT) ELSE k END AS kk FROM {out}b),
 {out}d AS (SELECT *, CASE WHEN (lo OR up) AND list_sum(k) > 0 THEN list_prepend(kk[1] + 16383 - list_sum(kk)::BIGINT, kk[2:]) ELSE kk END AS kz FROM {out}c),
 {out} AS (SELECT src_size, dst_size, dst, CASE WHEN lo THEN 0 ELSE wh - o END + n - 1 AS src, kz[n] AS weight FROM (SELECT *, unnest(range(1, len(kz) + 1)) AS n FROM {out}d))"""


def gauss_duck(sizes: str, radius: float, out: str) -> str:
    """The same for blur taps of a query's ``src_size``."""
    scale = "CASE WHEN list_sum({0}) <= 0 THEN {0} ELSE list_transform({0}, lambda v: trunc(v * 16383 / list_sum({0})::DOUBLE)::BIGINT) END"
    close = "CASE WHEN list_sum({0}) <= 0 THEN {0} ELSE list_prepend({0}[1] + 16383 - list_sum({0})::BIGINT, {0}[2:]) END"
    return f"""{out}0 AS (SELECT list_transform(range(0, 8), lambda i: exp(-(i * i) / (2 * {radius!r}::DOUBLE * {radius!r}::DOUBLE))) AS hf),
 {out}1 AS (SELECT list_transform(list_filter(list_transform(hf, lambda v: v / (hf[1] + 2 * {_SUM.format('hf[2:]')})), lambda v: v > 0.002), lambda v: trunc(v * 16383 + 0.5)::BIGINT) AS hf FROM {out}0),
 {out}2 AS (SELECT list_concat(list_reverse(hf[2:]), hf) AS q, len(hf) - 1 AS o FROM {out}1), {out}3 AS (SELECT o, {scale.format('q')} AS q FROM {out}2), {out}4 AS (SELECT o, {close.format('q')} AS q FROM {out}3),
 {out}5 AS (SELECT *, unnest(range(0, src_size)) AS dst FROM (SELECT DISTINCT src_size::BIGINT AS src_size FROM ({sizes})), {out}4),
 {out}6 AS (SELECT *, CASE WHEN dst < o THEN q[o - dst + 1:][1:src_size] WHEN dst >= src_size - o THEN q[1:least(src_size, o + src_size - dst)] ELSE q END AS k, dst < o OR dst >= src_size - o AS ed FROM {out}5),
 {out}7 AS (SELECT *, CASE WHEN ed THEN {scale.format('k')} ELSE k END AS kk FROM {out}6), {out}8 AS (SELECT *, CASE WHEN ed THEN {close.format('kk')} ELSE kk END AS kz FROM {out}7),
 {out} AS (SELECT src_size, src_size AS dst_size, dst, CASE WHEN dst < o THEN 0 ELSE dst - o END + n - 1 AS src, kz[n] AS weight FROM (SELECT *, unnest(range(1, len(kz) + 1)) AS n FROM {out}8) WHERE CASE WHEN dst < o THEN 0 ELSE dst - o END + n - 1 < src_size)"""


def resize_duck(src, sizes, filter_, sharpen, name="rz"):
    """Pixels of ``src`` resized from (w, h) to (tw, th), with taps of its own."""
    w, h, tw, th = sizes

    def sums(c):
        return CLAMP.format(f"floor((sum({c} * weight)::BIGINT + 255) / 16384.0::DOUBLE)::BIGINT") + f" AS {c}"
    pairs = f"SELECT {w} AS src_size, {tw} AS dst_size UNION SELECT {h}, {th}"
    return f"""{taps_duck(filter_, pairs, sharpen, name + "k")}, {name}m AS MATERIALIZED (SELECT * FROM {name}k),
 {name}x AS (SELECT image_id, y, dst AS x, {', '.join(sums(c) for c in 'bgr')} FROM {src} JOIN {name}m ON src = x AND src_size = {w} AND dst_size = {tw} GROUP BY image_id, y, dst),
 {name} AS (SELECT image_id, {tw} AS w, {th} AS h, x, dst AS y, {', '.join(sums(c) for c in 'bgr')} FROM {name}x JOIN {name}m ON src = y AND src_size = {h} AND dst_size = {th} GROUP BY image_id, x, dst)"""


_DOWN = resize_duck("pixels32", (32, 32, 11, 14), "quality", 0.15, "dn")
_UP = resize_duck("pixels", (8, 8, 13, 10), "bicubic", 0.0, "up")
R.add("px_resize_hq", f"WITH {_DOWN}, {_UP} SELECT 'down' AS how, * FROM dn UNION ALL SELECT 'up', * FROM up", "pixels32 pixels")(
    lambda s, d: kernels.resize(views.pixels32(s, d), "11", "14", "quality", 0.15).withColumn("how", F.lit("down"))
    .unionByName(kernels.resize(p8(s, d), "13", "10", "bicubic").withColumn("how", F.lit("up"))))
# two steps of a factor of sqrt(32 / 5) each, rounded down: 32x32 to 12x12 (softer filter), then to 5x4
_STEPS = f"{resize_duck('pixels32', (32, 32, 12, 12), 'quality', 0.15, 's1')}, {resize_duck('s1', (12, 12, 5, 4), 'quality', 0.3, 's2')}"
R.add("px_resize_steps", f"WITH {_STEPS} SELECT * FROM s2", "pixels32")(lambda s, d: kernels.resize_steps(views.pixels32(s, d), (32, 32), (5, 4), "sharpen medium"))

_GROWING = "SELECT p_size + 2 AS src_size, p_size * 2 + 5 AS dst_size FROM part"
R.add("kernel_bicubic", f"WITH {taps_duck('bicubic', _GROWING, 0.0, 'k')} SELECT * FROM k")(
    lambda s, d: kernels.kernel_table(views.table(s, d, "part").selectExpr("p_size + 2 AS src_size", "p_size * 2 + 5 AS dst_size"), "bicubic"))


_SHRINKING = "SELECT p_size + 20 AS src_size, p_size // 3 + 5 AS dst_size FROM part"
@R.add("kernel_downsample", "WITH " + ", ".join(taps_duck(n, _SHRINKING, 0.15, n) for n in ("quality", "lanczos", "narrow"))
       + " SELECT *, 'quality' AS filter FROM quality UNION ALL SELECT *, 'lanczos' FROM lanczos UNION ALL SELECT *, 'narrow' FROM narrow")
def kernel_downsample(s, d):
    pairs = views.table(s, d, "part").selectExpr("p_size + 20 AS src_size", "cast(p_size div 3 AS int) + 5 AS dst_size")
    out = None
    for name in ("quality", "lanczos", "narrow"):
        one = kernels.kernel_table(pairs, name, 0.15).withColumn("filter", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


R.add("kernel_gauss", f"WITH {gauss_duck('SELECT p_size + 3 AS src_size FROM part', 1.5, 'k')} SELECT * FROM k")(lambda s, d: kernels.gauss_kernels(views.table(s, d, "part").selectExpr("p_size + 3 AS src_size"), 1.5))

GAUSS = f"""{gauss_duck("SELECT 8 AS src_size", 1.0, "gt")}, g0 AS (SELECT image_id, w, h, x, y, b, g, r, {GRAY14} AS gray14 FROM pixels), gk AS MATERIALIZED (SELECT dst, src, weight FROM gt),
 g1 AS (SELECT image_id, y, dst AS x, floor(sum(gray14 * weight)::BIGINT / 16384.0::DOUBLE)::BIGINT AS gray14 FROM g0 JOIN gk ON src = x GROUP BY image_id, y, dst),
 g2 AS (SELECT image_id, x, dst AS y, floor(sum(gray14 * weight)::BIGINT / 16384.0::DOUBLE)::BIGINT AS gray14 FROM g1 JOIN gk ON src = y GROUP BY image_id, x, dst)"""
R.add("px_gauss", f"WITH {GAUSS} SELECT image_id, x, y, gray14 FROM g2", "pixels")(
    lambda s, d: kernels.gauss(px.gray14(p8(s, d)), 1.0).select("image_id", "x", "y", "gray14"))
R.add("px_unsharp", f"""WITH {GAUSS}, df AS (SELECT g0.*, floor((g0.gray14 - g2.gray14) / 16.0::DOUBLE)::BIGINT AS i FROM g0 JOIN g2 USING (image_id, x, y)),
 ps AS (SELECT *, abs(i) / 1024.0::DOUBLE AS p, {4.0 / 255.0!r}::DOUBLE AS t FROM df), tf AS (SELECT *, CASE WHEN p < t THEN (p / t) * (p / t) * p WHEN p < 0.2 THEN p ELSE (p * 0.2::DOUBLE - 0.2::DOUBLE) / -0.8::DOUBLE END AS f FROM ps),
 lu AS (SELECT *, floor(trunc(CASE WHEN i <= 0 THEN -16384.0::DOUBLE * f - 0.5 ELSE 9830.4::DOUBLE * f + 0.5 END)::BIGINT * 6144 / 262144.0::DOUBLE)::BIGINT AS sh FROM tf)
 SELECT image_id, w, h, x, y, """ + ", ".join(CLAMP.format(f"{c} + floor(sh * {c} / 256.0::DOUBLE)::BIGINT") + f" AS {c}" for c in "bgr") + " FROM lu", "pixels")(
    lambda s, d: kernels.unsharp(p8(s, d), 1.0, 1.5, 4.0))

# --- rotation and perspective ----------------------------------------------------------------

BACK = (11, 22, 33)


def images8(s, d):
    return views.table(s, d, "embeddings").selectExpr("vec_id AS image_id", "8 AS w", "8 AS h", "label")


def _fixed(v):
    return f"trunc(CASE WHEN {v} < 0 THEN 65536 * ({v}) - 0.5 ELSE 65536 * ({v}) + 0.5 END)::BIGINT"


ROT = f"""im AS (SELECT vec_id AS image_id, (vec_id % 13) * 0.21::DOUBLE + 0.017 AS a FROM embeddings),
 rt AS (SELECT *, {_fixed('(cos(-a) * -3.5 - sin(-a) * -3.5 + 3.5)')} AS fx, {_fixed('(sin(-a) * -3.5 + cos(-a) * -3.5 + 3.5)')} AS fy, {_fixed('(cos(-a) * (8.0::DOUBLE / 9))')} AS x1, {_fixed('(sin(-a) * (8.0::DOUBLE / 9))')} AS y1,
  {_fixed('(-sin(-a) * (8.0::DOUBLE / 8))')} AS x2, {_fixed('(cos(-a) * (8.0::DOUBLE / 8))')} AS y2 FROM im),
 gr AS (SELECT *, unnest(range(0, 10)) AS x FROM (SELECT *, unnest(range(0, 9)) AS y FROM rt)), mp AS (SELECT image_id, x, y, floor((fx + x * x1 + y * x2) / 65536.0::DOUBLE)::BIGINT AS sx, floor((fy + x * y1 + y * y2) / 65536.0::DOUBLE)::BIGINT AS sy FROM gr)"""
R.add("px_rotate_free", f"""WITH {ROT} SELECT m.image_id, 10 AS w, 9 AS h, m.x, m.y, coalesce(b, 11) AS b, coalesce(g, 22) AS g, coalesce(r, 33) AS r FROM mp m LEFT JOIN pixels p ON p.image_id = m.image_id AND p.x = sx AND p.y = sy""", "pixels")(
    lambda s, d: px.rotate_free(p8(s, d), images8(s, d), "((image_id % 13) * 0.21D + 0.017D)", "10", "9", BACK))
R.add("px_rotate_bicubic")(
    lambda s, d: px.rotate_bicubic(p8(s, d), images8(s, d), "((image_id % 13) * 0.21D + 0.017D)", "10", "9", BACK, kernels.bicubic_phases()))

TRAPEZOID = {"x1s": "(label % 3)", "x1e": "9", "x2s": "1", "x2e": "(8 + label % 3)", "y1": "0", "y2": "9"}
R.add("px_perspective", """WITH im AS (SELECT vec_id AS image_id, label % 3 AS x1s, 9 AS x1e, 1 AS x2s, 8 + label % 3 AS x2e, 9 AS hh FROM embeddings),
 e AS (SELECT *, x1e - x1s AS w1, x2e - x2s AS w2, x1s - x2s AS d1, x1e - x2e AS d2, CASE WHEN x1e - x1s < x2e - x2s THEN least(x1e - x1s, x2e - x2s) ELSE -least(x1e - x1s, x2e - x2s) END AS nw FROM im),
 ap AS (SELECT *, CASE WHEN d1 = 0 AND d2 = 0 THEN 0 WHEN d1 = 0 THEN -nw * hh::DOUBLE / d2 WHEN d2 = 0 THEN nw * hh::DOUBLE / d1 WHEN d1 = d2 THEN 0 ELSE nw * (hh::DOUBLE / d1) * (hh::DOUBLE / d2) / (hh::DOUBLE / d2 - hh::DOUBLE / d1) END AS apex FROM e),
 rw AS (SELECT *, unnest(range(0, 10)) AS y FROM ap),
 ry AS (SELECT *, CASE WHEN apex > 0 THEN greatest(0, least(65536 * 7, trunc(65536.0::DOUBLE * 7 / 9 * ((apex + hh) * (hh - (apex + hh)) / (y + CASE WHEN w1 < w2 THEN apex ELSE -(apex + hh) END) + CASE WHEN w1 < w2 THEN apex + hh ELSE hh - (apex + hh) END) + 0.5)::BIGINT))
   ELSE y * ((65536 * 7 + 65535) // 9) END >> 16 AS sy, (x1s - x2s) * 0.5::DOUBLE + y * ((x2s - x1s)::DOUBLE / hh) AS t1, (x1s - x2s) * 0.5::DOUBLE + x1e - x1s + y * ((x2e - x1e)::DOUBLE / hh) AS t2 FROM rw),
 ri AS (SELECT *, trunc(65536.0::DOUBLE * 8 / (t2 - t1 + 1))::BIGINT + 1 AS inc FROM ry), gr AS (SELECT *, unnest(range(0, 11)) AS x FROM ri),
 mp AS (SELECT image_id, x, y, sy, floor((trunc(-t1 * inc)::BIGINT + x * inc) / 65536.0::DOUBLE)::BIGINT AS sx FROM gr)
 SELECT m.image_id, 11 AS w, 10 AS h, m.x, m.y, coalesce(b, 11) AS b, coalesce(g, 22) AS g, coalesce(r, 33) AS r FROM mp m LEFT JOIN pixels p ON p.image_id = m.image_id AND p.x = sx AND p.y = sy""", "pixels")(
    lambda s, d: px.perspective_point(p8(s, d), images8(s, d), TRAPEZOID, "11", "10", BACK).select(*PX))
R.add("px_perspective_bicubic")(
    lambda s, d: px.perspective_bicubic(p8(s, d), images8(s, d), TRAPEZOID, ("0", "0"), "11", "10", BACK, kernels.bicubic_phases()))

# --- stages ----------------------------------------------------------------------------------

_TH = resize_duck("pixels32", (32, 32, 14, 14), "quality", 0.0, "th")
R.add("thumbnail", f"WITH {_TH} SELECT * FROM th", "pixels32")(lambda s, d: stages.thumbnail(views.pixels32(s, d), (20, 14)))

_CHAIN = f"""pt AS ({_POINT.format(tw=13, th=20, ix=32 * 65536 // 13 + 1, iy=32 * 65536 // 20 + 1)}), sat AS ({sat_duck('pt', '1.4::DOUBLE')}),
 cgp AS (SELECT 0.2::DOUBLE AS contrast, 1.3::DOUBLE AS gamma), cgv AS (SELECT *, unnest(range(0, 256)) AS v_in FROM cgp), {_cg}, sg AS MATERIALIZED (SELECT v_in, _out::BIGINT AS v_out FROM {_cgl}),
 lt AS (SELECT image_id, w, h, x, y, ub.v_out AS b, ug.v_out AS g, ur.v_out AS r FROM sat JOIN sg ub ON ub.v_in = b JOIN sg ug ON ug.v_in = g JOIN sg ur ON ur.v_in = r),
 done AS (SELECT image_id, w, h, x, y, {', '.join(f'CASE WHEN x >= 3 AND x < 9 AND y >= 2 AND y < 8 THEN ({c} * 32768) >> 16 ELSE {c} END AS {c}' for c in 'bgr')} FROM lt)"""
STEPS = stages.Stages(width="13", height="20", high_quality=False, saturation=1.4, contrast=0.2, gamma=1.3, dim=[((3, 2, 9, 8), 0.5)], grid=True)
R.add("process_chain", f"WITH {_CHAIN} SELECT * FROM done", "pixels32")(lambda s, d: stages.process(views.pixels32(s, d), STEPS).select(*PX))
R.add("process_chain_full")(
    lambda s, d: stages.process(views.pixels32(s, d), stages.Stages(
        width="20", height="24", unsharp=(1.0, 1.0, 3.0), saturation=0.8, contrast=-0.1, gamma=0.9, auto_contrast=True, auto_cut=0.02, density=True,
        density_values=1024, density_cut=0.05, grid=True)).select(*PX))
_HP = f"{_TH}, dim2 AS (SELECT image_id, {', '.join(f'CASE WHEN x >= 2 AND x < 10 AND y >= 1 AND y < 9 THEN ({c} * 45875) >> 16 ELSE {c} END AS {c}' for c in 'bgr')} FROM th)"
R.add("hist_processed", f"WITH {_HP}, {HIST.format(src='dim2')} SELECT * FROM hist", "pixels32")(
    lambda s, d: stats.hist_exact(stages.process(stages.thumbnail(views.pixels32(s, d), (20, 14)), stages.Stages(dim=[((2, 1, 10, 9), 0.7)]))))

# --- content keys ----------------------------------------------------------------------------

CRC = """tab AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_concat([n], range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"""
STATE = "list_reduce(list_concat([4294967295], {bytes}), lambda c, b: xor(tab[((xor(c, b) & 255) + 1)::BIGINT], c >> 8))"
SIGNED = "(CASE WHEN {k} >= 9223372036854775808 THEN {k} - 18446744073709551616 ELSE {k} END)::BIGINT"
R.add("pixel_hash", f"""WITH {CRC}, cnt AS (SELECT image_id, v, sum(CASE WHEN c = 'b' THEN 1 ELSE 0 END)::BIGINT AS b, sum(CASE WHEN c = 'g' THEN 1 ELSE 0 END)::BIGINT AS g, sum(CASE WHEN c = 'r' THEN 1 ELSE 0 END)::BIGINT AS r
  FROM (SELECT image_id, unnest(['b','g','r']) AS c, unnest([b, g, r]) AS v FROM pixels32) GROUP BY 1, 2),
 ful AS (SELECT i.image_id, i.v, coalesce(b, 0) AS b, coalesce(g, 0) AS g, coalesce(r, 0) AS r FROM (SELECT image_id, unnest(range(0, 256)) AS v FROM (SELECT DISTINCT image_id FROM pixels32)) i LEFT JOIN cnt USING (image_id, v)),
 byt AS (SELECT image_id, v * 4 + k AS n, [(b >> (8 * k)::INT) & 255, (g >> (8 * k)::INT) & 255, (r >> (8 * k)::INT) & 255] AS t FROM (SELECT *, unnest(range(0, 4)) AS k FROM ful)),
 hb AS (SELECT image_id, flatten(list(t ORDER BY n)) AS hb FROM byt GROUP BY 1), lb AS (SELECT image_id, flatten(list([b, 0] ORDER BY x)) AS lb FROM pixels32 WHERE y = 8 GROUP BY 1),
 tot AS (SELECT image_id, sum(b + g + r)::BIGINT AS total FROM pixels32 GROUP BY 1),
 key AS (SELECT image_id, {STATE.format(bytes='list_concat(hb, lb)')}::HUGEINT * 4294967296 + total AS k FROM hb JOIN lb USING (image_id) JOIN tot USING (image_id), tab)
 SELECT image_id, {SIGNED.format(k='k')} AS hash FROM key""", "pixels32")(lambda s, d: hashes.pixel_hash(views.pixels32(s, d), 1024))

R.add("stream_hash", f"""WITH {CRC}, hx AS (SELECT doc_id, hex(content) AS hx, octet_length(content) AS n FROM blobs),
 jp AS (SELECT doc_id, hx, n, CASE WHEN n - 2 < 4 THEN 0 ELSE 2 END AS st FROM hx WHERE hx LIKE 'FFD8%' AND n >= 3),
 by_ AS (SELECT doc_id, list_transform(range(st, n, greatest(1, (n - st) // 700)), lambda i: ('0x' || hx[2 * i + 1:2 * i + 2])::BIGINT) AS bs FROM jp),
 key AS (SELECT doc_id, {STATE.format(bytes='bs')}::HUGEINT * 4294967296 + list_sum(bs)::BIGINT AS k FROM by_, tab)
 SELECT doc_id, {SIGNED.format(k='k')} AS hash FROM key UNION ALL SELECT doc_id, 0 FROM hx WHERE NOT (hx LIKE 'FFD8%' AND n >= 3)""", "blobs")(
    lambda s, d: hashes.stream_hash(views.blobs(s, d), "doc_id", 700))


@R.add("save_processed")
def save_processed(s, d):
    done = px.dim_rect(p8(s, d), (0, 0, 8, 8), 0.5)
    keys = hashes.pixel_hash(done, 64)
    store = views.params(s, d).select("hash")
    return stages.save_processed(done, keys, store, f"{shared_folder(s)}/saved-{uuid.uuid4().hex}", {"contrast": 0.0, "gamma": 1.0})


@R.add("pixel_source", "SELECT image_id, count(*) AS n, sum(b)::BIGINT AS b, sum(g)::BIGINT AS g, sum(r)::BIGINT AS r FROM pixels GROUP BY 1", "pixels")
def pixel_source(s, d):
    """Spark packs each image into the ``image`` source's byte layout and the source's unpacking step reads it back."""
    from pixelquarry.sources import files

    packed = (
        p8(s, d).groupBy("image_id", F.col("w").alias("width"), F.col("h").alias("height"))
        .agg(F.array_sort(F.collect_list(F.struct("y", "x", "b", "g", "r"))).alias("_p"))
        .select("image_id", "width", "height", F.lit(3).alias("nChannels"),
                F.unhex(F.array_join(F.transform("_p", lambda p: F.concat(*[F.substring(F.hex(p[c] + 256), 2, 2) for c in "bgr"])), "")).alias("data"))
    )
    return files.explode_pixels(packed).groupBy("image_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "bgr"])

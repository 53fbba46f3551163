"""Sizes and rectangles as columns. Arguments are SQL text over the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gcd(a: str, b: str) -> str:
    """Greatest common divisor; 47 Euclid steps cover every 32-bit pair."""
    return (
        f"aggregate(sequence(1, 47), named_struct('a', cast({a} AS bigint), 'b', cast({b} AS bigint)), "
        f"(s, i) -> IF(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b)), s -> s.a)"
    )


def with_fit(df: DataFrame, box_w: str, box_h: str, zoom_in: bool = False, fill: bool = False, limit_area: bool = False,
             w: str = "w", h: str = "h") -> DataFrame:
    """Adds ``zoom, fit_w, fit_h``: the image scaled to fit (or fill) a box.

    Without ``zoom_in`` small images keep their size. ``limit_area`` falls back
    from fill to fit when filling would cover more than 1.5 times the box. A
    result one pixel off the box snaps to it.
    """
    sized = df.withColumns({"_a1": F.expr(f"{w} / cast({box_w} AS double)"), "_a2": F.expr(f"{h} / cast({box_h} AS double)")})
    low, high = "least(_a1, _a2)", "greatest(_a1, _a2)"
    first = low if fill else high
    keep = f"{first} <= 1.0D AND {high} <= 1.0D" if not zoom_in else "false"
    step = f"CASE WHEN {first} <= 1.0D THEN {high} ELSE {first} END" if fill and not zoom_in else first
    sized = sized.withColumns({"_keep": F.expr(keep), "_ar": F.expr(step)})
    if fill and limit_area:
        sized = sized.withColumn("_ar", F.expr(f"CASE WHEN ({w} / _ar * {h} / _ar) / ({box_w} * {box_h}) > 1.5D THEN {high} ELSE _ar END"))
    sized = sized.withColumns({"_fw": F.expr(f"cast({w} / _ar + 0.5D AS int)"), "_fh": F.expr(f"cast({h} / _ar + 0.5D AS int)")})
    snap = f"abs(_fw - ({box_w})) <= 1 AND abs(_fh - ({box_h})) <= 1"
    return sized.withColumns({
        "zoom": F.expr(f"CASE WHEN _keep THEN 1.0D WHEN {snap} THEN IF({box_w} > {box_h}, ({box_w}) / cast({w} AS double), ({box_h}) / cast({h} AS double)) ELSE 1.0D / _ar END"),
        "fit_w": F.expr(f"CASE WHEN _keep THEN {w} WHEN {snap} THEN {box_w} ELSE _fw END"),
        "fit_h": F.expr(f"CASE WHEN _keep THEN {h} WHEN {snap} THEN {box_h} ELSE _fh END"),
    }).drop("_a1", "_a2", "_keep", "_ar", "_fw", "_fh")


def centred_rect(w: str, h: str, left: str, top: str, right: str, bottom: str, fill: bool = False) -> dict[str, Column]:
    """Rectangle of aspect w:h fitted into (or filled around) a rectangle and centred on it."""
    rw, rh = f"({right} - {left})", f"({bottom} - {top})"
    ratio = f"({w} / cast({h} AS double))"
    wider = f"{ratio} > {rw} / cast({rh} AS double)"
    by_width = f"NOT ({wider})" if fill else wider
    new_h = f"cast({rw} / {ratio} + 0.5D AS int)"
    new_w = f"cast({rh} * {ratio} + 0.5D AS int)"
    x0, y0 = f"{left} + cast(({rw} - {new_w}) / 2 AS int)", f"{top} + cast(({rh} - {new_h}) / 2 AS int)"
    return {
        "rect_left": F.expr(f"CASE WHEN {by_width} THEN {left} ELSE {x0} END"),
        "rect_top": F.expr(f"CASE WHEN {by_width} THEN {y0} ELSE {top} END"),
        "rect_right": F.expr(f"CASE WHEN {by_width} THEN {right} ELSE {x0} + {new_w} END"),
        "rect_bottom": F.expr(f"CASE WHEN {by_width} THEN {y0} + {new_h} ELSE {bottom} END"),
    }


def aspect(w: str, h: str) -> tuple[Column, Column]:
    g = gcd(w, h)
    return F.expr(f"{w} div {g}"), F.expr(f"{h} div {g}")


def ratio_height(w: str, ratio: str) -> Column:
    return F.expr(f"cast(floor({w} / {ratio} + 0.5D) AS int)")


def ratio_width(h: str, ratio: str) -> Column:
    return F.expr(f"cast(floor({h} * {ratio} + 0.5D) AS int)")


def block_aligned(w: str, h: str, block_w: int, block_h: int) -> Column:
    """Can the image be turned without loss: both sides are whole codec blocks."""
    return F.expr(f"{w} % {block_w} = 0 AND {h} % {block_h} = 0")


def snap_to_blocks(start: str, end: str, limit: str, block: int) -> tuple[Column, Column]:
    """Widen [start, end) to whole blocks; the end steps back inside if it passes ``limit``."""
    up = f"(({end} + {block - 1}) & ~{block - 1})"
    return F.expr(f"{start} & ~{block - 1}"), F.expr(f"CASE WHEN {up} > {limit} THEN {up} - {block} ELSE {up} END")


def rotated_size(df: DataFrame, angle: str, crop: bool = False, keep_ratio: bool = False, w: str = "w", h: str = "h") -> DataFrame:
    """Adds ``rot_x, rot_y, rot_w, rot_h``: the bounding or the largest inscribed rectangle after a rotation about the centre."""
    cx, cy = f"(({w} - 1) * 0.5D)", f"(({h} - 1) * 0.5D)"
    corners = [(f"-{cx}", f"-{cy}"), (cx, f"-{cy}"), (cx, cy), (f"-{cx}", cy)]
    df = df.withColumns({"_co": F.expr(f"cos({angle})"), "_si": F.expr(f"sin({angle})")})
    for i, (x, y) in enumerate(corners):
        df = df.withColumns({f"_x{i}": F.expr(f"_co * {x} - _si * {y}"), f"_y{i}": F.expr(f"_si * {x} + _co * {y}")})
    xs, ys = ", ".join(f"_x{i}" for i in range(4)), ", ".join(f"_y{i}" for i in range(4))
    df = df.withColumns({
        "_xmin": F.expr(f"least({xs})"), "_xmax": F.expr(f"greatest({xs})"), "_ymin": F.expr(f"least({ys})"), "_ymax": F.expr(f"greatest({ys})"),
    })
    drop = ["_co", "_si", "_xmin", "_xmax", "_ymin", "_ymax", *[f"_{a}{i}" for a in "xy" for i in range(4)]]
    if crop:
        if keep_ratio:
            df = df.withColumns({
                "_need": F.expr(f"({w} / cast({h} AS double)) * (_ymax - _ymin)"), "_mid": F.expr("(_xmax + _xmin) * 0.5D"),
            }).withColumns({"_xmin": F.expr("_mid - 0.5D * _need"), "_xmax": F.expr("_mid + 0.5D * _need")})
            drop += ["_need", "_mid"]
        # diagonals of the box meet the four sides; the nearest meeting point gives the corner
        points = []
        for sign in ("-1.0D", "1.0D"):
            for i in range(4):
                j = (i + 1) % 4
                vx, vy = f"(_x{j} - _x{i})", f"(_y{j} - _y{i})"
                t = f"((_x{i} * _ymin - _y{i} * {sign} * _xmax) / nullif({vy} * {sign} * _xmax - {vx} * _ymin, 0.0D))"
                points.append(
                    f"CASE WHEN {t} > -1e-8D AND {t} - 1 < 1e-8D THEN named_struct('x', _x{i} + {t} * {vx}, 'y', _y{i} + {t} * {vy}) END"
                )
        df = df.withColumn("_pts", F.array(*[F.expr(p) for p in points]))
        start = "named_struct('x', (_xmax - _xmin) * 0.5D, 'y', (_ymax - _ymin) * 0.5D)"
        df = df.withColumn("_best", F.expr(
            f"aggregate(array_compact(_pts), {start}, (s, p) -> IF(p.x * p.x + p.y * p.y < s.x * s.x + s.y * s.y, p, s))"
        ))
        drop += ["_pts", "_best"]

        def near(v: str) -> str:
            return f"cast(CASE WHEN {v} < 0 THEN {v} - 0.5D ELSE {v} + 0.5D END AS int)"

        spans = {"x": (near(f"(-abs(_best.x) + {cx})"), near(f"(abs(_best.x) + {cx})")), "y": (near(f"(-abs(_best.y) + {cy})"), near(f"(abs(_best.y) + {cy})"))}
    else:
        spans = {a: (f"cast(_{a}min + {c} - 0.999D AS int)", f"cast(_{a}max + {c} + 0.999D AS int)") for a, c in (("x", cx), ("y", cy))}
    return df.withColumns({
        "rot_x": F.expr(spans["x"][0]), "rot_y": F.expr(spans["y"][0]),
        "rot_w": F.expr(f"{spans['x'][1]} - {spans['x'][0]} + 1"), "rot_h": F.expr(f"{spans['y'][1]} - {spans['y'][0]} + 1"),
    }).drop(*drop)


def trapezoid_inner_rect(df: DataFrame, ratio: str | None = None) -> DataFrame:
    """Adds ``in_left, in_top, in_right, in_bottom``: the largest upright rectangle inside x1s..x1e (at y1), x2s..x2e (at y2).

    With ``ratio`` (width / height) it keeps that shape. A trapezoid that leans
    is first cut to the part between its inner sides.
    """
    if ratio is None:
        return df.withColumns({
            "in_left": F.expr("greatest(x1s, x2s)"), "in_top": F.col("y1"), "in_right": F.expr("least(x1e, x2e)"), "in_bottom": F.col("y2"),
        })
    nested = "((x1s >= x2s AND x1e <= x2e) OR (x1s <= x2s AND x1e >= x2e))"
    grows, leans = "x1e - x1s < x2e - x2s", "x1s < x2s"
    cut = {
        "_as": f"CASE WHEN {nested} OR NOT ({leans}) THEN x1s WHEN {grows} THEN x2s ELSE x1s END",
        "_ae": f"CASE WHEN {nested} OR {leans} THEN x1e WHEN {grows} THEN x2e ELSE x1e END",
        "_bs": f"CASE WHEN {nested} OR {leans} THEN x2s WHEN {grows} THEN x2s ELSE x1s END",
        "_be": f"CASE WHEN {nested} OR NOT ({leans}) THEN x2e WHEN {grows} THEN x2e ELSE x1e END",
    }
    df = df.withColumns({k: F.expr(v) for k, v in cut.items()})
    df = df.withColumns({"_w1": F.expr("_ae - _as"), "_w2": F.expr("_be - _bs"), "_hh": F.expr("y2 - y1")})
    df = df.withColumn("_slope", F.expr("(_w2 - _w1) / cast(_hh AS double)")).withColumn("_up", F.expr("_w1 < _w2"))
    df = df.withColumn("_dy", F.expr(f"CASE WHEN _up THEN ({ratio} * _hh - _w1) / ({ratio} + _slope) ELSE _w1 / ({ratio} - _slope) END"))
    df = df.withColumn("_al", F.expr("_dy / _hh"))
    return df.withColumns({
        "in_left": F.expr("cast((_bs - _as) * _al + _as + 0.5D AS int)"),
        "in_top": F.expr("CASE WHEN _up THEN cast(_dy + y1 + 0.5D AS int) ELSE y1 END"),
        "in_right": F.expr("cast(_ae + (_be - _ae) * _al + 0.5D AS int)"),
        "in_bottom": F.expr("CASE WHEN _up THEN y2 ELSE cast(_dy + y1 + 0.5D AS int) END"),
    }).drop("_as", "_ae", "_bs", "_be", "_w1", "_w2", "_hh", "_slope", "_up", "_dy", "_al")

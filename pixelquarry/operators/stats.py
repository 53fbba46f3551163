"""Histograms, points, scores and other pixel statistics.

A histogram is long: ``image_id, channel, bin, n``. The count is a two-phase
hash aggregate, so even one image holding most pixels sends at most 1024 rows
per task through the shuffle. Everything after it works on those few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelquarry.functions.pixel import GRAY


def hist_exact(pixels: DataFrame) -> DataFrame:
    """256-bin counts of blue, green, red and gray for every image.

    Channel and bin are counted as one small integer: two fixed-width keys keep
    the aggregate on its fast path, the channel name is put back afterwards.
    """
    slots = pixels.selectExpr("image_id", f"explode(array(b, 256 + g, 512 + r, 768 + {GRAY})) AS _slot")
    counts = slots.groupBy("image_id", "_slot").agg(F.count("*").alias("n"))
    return counts.selectExpr(
        "image_id", "CASE shiftright(_slot, 8) WHEN 0 THEN 'b' WHEN 1 THEN 'g' WHEN 2 THEN 'r' ELSE 'gray' END AS channel",
        "_slot & 255 AS bin", "n",
    )


def hist_sampled(pixels: DataFrame, num_values: int = 50_000) -> DataFrame:
    """Same counts on a grid that keeps about ``num_values`` pixels of an image."""
    step = f"cast(0.5D + sqrt(1.0D + (cast(w AS bigint) * h) div {num_values}) AS int)"
    return hist_exact(
        pixels.withColumn("_step", F.expr(step)).filter(
            "x % _step = 0 AND y % _step = 0 AND x div _step < greatest(1, w div _step) AND y div _step < greatest(1, h div _step)"
        )
    )


def hist_region(pixels: DataFrame, left: int, top: int, right: int, bottom: int) -> DataFrame:
    """Histogram of the half-open rectangle [left, right) x [top, bottom)."""
    return hist_exact(pixels.filter(f"x >= {left} AND x < {right} AND y >= {top} AND y < {bottom}"))


def hist_merge(hist: DataFrame, by: str) -> DataFrame:
    """Add up histograms that share ``by``; keeps bins."""
    return hist.groupBy(by, "channel", "bin").agg(F.sum("n").alias("n"))


def hist_means(hist: DataFrame, key: str = "image_id") -> DataFrame:
    """Integer (truncated) mean per colour channel, and the number of pixels."""
    def mean(ch: str):
        return F.expr(
            f"sum(CASE WHEN channel = '{ch}' THEN bin * n ELSE 0 END) div sum(CASE WHEN channel = '{ch}' THEN n ELSE 0 END)"
        )
    return hist.groupBy(key).agg(
        F.expr("sum(CASE WHEN channel = 'gray' THEN n ELSE 0 END)").alias("total"),
        mean("b").alias("b_mean"), mean("g").alias("g_mean"), mean("r").alias("r_mean"),
    )


def _area_bins(start: float, end: float) -> tuple[int, int]:
    return int(start * 255 + 0.5), int(end * 255 + 0.5)


def hist_area(hist: DataFrame, start: float, end: float) -> DataFrame:
    """Share of an image's pixels whose value lies in [start, end] of the full range."""
    low, high = _area_bins(start, end)
    return hist.groupBy("image_id", "channel").agg(
        F.expr(f"cast(sum(CASE WHEN bin BETWEEN {low} AND {high} THEN n ELSE 0 END) AS double) / sum(n)").alias("area")
    )


def running_histogram(hist: DataFrame) -> DataFrame:
    """Counts accumulated from below and from above; a window holds at most 256 bins."""
    whole = Window.partitionBy("image_id", "channel")
    up = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    # counts from above are what is left of the total, which saves the second sort
    summed = hist.withColumn("cum_up", F.sum("n").over(up))
    return summed.withColumn("cum_down", F.sum("n").over(whole) - F.col("cum_up") + F.col("n"))


def bw_points(hist: DataFrame, cut: float = 0.001) -> DataFrame:
    """Black and white point per channel: the bins where the outer ``cut`` share ends."""
    whole = Window.partitionBy("image_id", "channel")
    runs = (
        running_histogram(hist)
        .withColumn("_total", F.sum("n").over(whole))
        .withColumn("level", F.expr(f"cast(floor(_total * {cut!r}D + 0.5D) AS bigint)"))
    )
    return runs.groupBy("image_id", "channel").agg(
        F.max("level").alias("level"),
        F.expr("CASE WHEN max(level) = 0 THEN 0.0D ELSE min(CASE WHEN cum_up >= level THEN bin END) / 255.0D END").alias("black"),
        F.expr("CASE WHEN max(level) = 0 THEN 1.0D ELSE max(CASE WHEN cum_down >= level THEN bin END) / 255.0D END").alias("white"),
    )


def gray_points(hist: DataFrame, cut: float = 0.01) -> DataFrame:
    """Second variant, gray only: with a zero limit it gives -1/255 and 256/255."""
    whole = Window.partitionBy("image_id")
    runs = running_histogram(hist.filter("channel = 'gray'")).withColumn("_total", F.sum("n").over(whole)).withColumn(
        "_limit", F.expr(f"cast(_total * {cut!r}D AS bigint)")
    )
    return runs.groupBy("image_id").agg(
        F.expr("CASE WHEN max(_limit) = 0 THEN -1 ELSE min(CASE WHEN cum_up >= _limit THEN bin END) END / 255.0D").alias("black_pt"),
        F.expr("CASE WHEN max(_limit) = 0 THEN 256 ELSE max(CASE WHEN cum_down >= _limit THEN bin END) END / 255.0D").alias("white_pt"),
    )


def night_score(hist: DataFrame) -> DataFrame:
    """Gray level under which 80 % of the pixels lie, and the 0..1 night-shot score."""
    whole = Window.partitionBy("image_id", "channel")
    runs = running_histogram(hist).withColumn("_total", F.sum("n").over(whole)).withColumn("_limit", F.expr("_total * 80 div 100"))
    dark_low, dark_high = _area_bins(0.0, 0.1)
    light_low, light_high = _area_bins(0.4, 1.0)

    def light(ch: str) -> str:
        return (
            f"cast(sum(CASE WHEN channel = '{ch}' AND bin BETWEEN {light_low} AND {light_high} THEN n ELSE 0 END) AS double) / max(_total)"
        )

    facts = runs.groupBy("image_id").agg(
        F.expr(
            "CASE WHEN max(_limit) = 0 THEN -1 ELSE min(CASE WHEN channel = 'gray' AND cum_up >= _limit THEN bin END) END / 255.0D"
        ).alias("value80"),
        F.expr(
            f"cast(sum(CASE WHEN channel = 'gray' AND bin BETWEEN {dark_low} AND {dark_high} THEN n ELSE 0 END) AS double) / max(_total)"
        ).alias("_dark"),
        F.expr(f"greatest({light('b')}, {light('g')}, {light('r')})").alias("_light"),
    )
    score = "least(1.0D, (1.0D - value80) * 1.6D) - greatest(0.0D, 1.0D - _dark * 3.0D) - 5.0D * _light"
    return facts.selectExpr("image_id", "value80", f"greatest(0.0D, least(1.0D, {score})) AS night")


def histogram_normalized(hist: DataFrame) -> DataFrame:
    """Bar height of each bin relative to the tallest bin of its channel, on a square-root scale."""
    tallest = F.max("n").over(Window.partitionBy("image_id", "channel"))
    return hist.withColumn("height", F.sqrt("n") / F.sqrt(tallest))


# fixed values: correction strengths for red, green, blue, cyan, magenta and yellow casts
CAST_STRENGTHS = (0.2, 0.1, 0.3, 0.3, 0.3, 0.15)


def color_cast(means: DataFrame, strengths: tuple[float, ...] = CAST_STRENGTHS) -> DataFrame:
    """Deviation of each channel mean from their average, weighted by sign.

    ``strengths`` are red, green, blue, cyan, magenta, yellow.
    """
    red, green, blue, cyan, magenta, yellow = (f"{s!r}D" for s in strengths)
    middle = "(b_mean + g_mean + r_mean) / 765.0D"

    def one(col: str, plus: str, minus: str) -> str:
        dev = f"({col} / 255.0D - {middle})"
        return f"{dev} * CASE WHEN {dev} > 0 THEN {plus} ELSE {minus} END"

    return means.selectExpr(
        "*", f"{one('b_mean', blue, yellow)} AS cast_b", f"{one('g_mean', green, magenta)} AS cast_g",
        f"{one('r_mean', red, cyan)} AS cast_r",
    )


def block_mean_4x4(pixels: DataFrame) -> DataFrame:
    """Means of 4x4 blocks per channel; blocks keep their own width and height."""
    return (
        pixels.groupBy("image_id", F.expr("cast(w div 4 AS int)").alias("w"), F.expr("cast(h div 4 AS int)").alias("h"),
                       F.expr("cast(x div 4 AS int)").alias("x"), F.expr("cast(y div 4 AS int)").alias("y"))
        .agg(*[F.expr(f"cast(shiftright(sum({c}), 4) AS int)").alias(c) for c in "bgr"])
    )


def row_means(blocks: DataFrame) -> DataFrame:
    """Truncated mean of each channel for every row of the block image."""
    return blocks.groupBy("image_id", "h", "y").agg(*[F.expr(f"sum({c}) div max(w)").alias(c) for c in "bgr"])


def middle_gray(rows: DataFrame) -> DataFrame:
    return rows.groupBy("image_id").agg(F.expr(f"sum({GRAY}) / cast(max(h) AS double) / 255.0D").alias("middle_gray"))


def sunset_flag() -> str:
    """SQL test of a b, g, r row: is its hue a typical sunset colour?"""
    top, low = "greatest(r, g, b)", "least(r, g, b)"
    hue = (
        f"60.0D * CASE WHEN r = {top} THEN (g - b) / cast({top} - {low} AS double) "
        f"WHEN g = {top} THEN 2.0D + (b - r) / cast({top} - {low} AS double) "
        f"ELSE 4.0D + (r - g) / cast({top} - {low} AS double) END"
    )
    return (
        f"CASE WHEN {top} = 0 OR {top} = {low} THEN false "
        f"ELSE ((({hue}) < 0 AND ({hue}) + 360 > 350) OR (({hue}) >= 0 AND (({hue}) < 30 OR ({hue}) > 350))) "
        f"AND {top} > 51 AND ({top} - {low}) * 10 > {top} END"
    )


def sunset_pixel_share(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("image_id").agg(
        F.expr(f"sum(CASE WHEN {sunset_flag()} THEN 1 ELSE 0 END) / cast(count(*) AS double)").alias("share")
    )


def sunset_score(blocks: DataFrame) -> DataFrame:
    """Heuristic 0..1: dark bottom fifth, brighter upper part, enough sunset colours; 0 for heights up to 4."""
    rows = row_means(blocks)
    bottom = "y >= h - h div 5"
    tone = "shiftright(b * 128 + g * 768 + r * 128, 10)"
    halves = rows.groupBy("image_id").agg(
        F.max("h").alias("_h"),
        F.expr(f"sum(CASE WHEN {bottom} THEN {tone} ELSE 0 END)").alias("_low"),
        F.expr(f"sum(CASE WHEN {bottom} THEN 0 ELSE {tone} END)").alias("_up"),
        F.expr(f"sum({GRAY}) / cast(max(h) AS double) / 255.0D").alias("middle_gray"),
    )
    facts = halves.join(sunset_pixel_share(blocks), "image_id").selectExpr(
        "image_id", "_h", "middle_gray", "share", "CASE WHEN _h > 4 THEN _low div (_h div 5) END AS lower",
        "CASE WHEN _h > 4 THEN _up div (_h - _h div 5) END AS upper",
    )
    ratio = "CASE WHEN lower = 0 THEN 1.0D WHEN upper < lower THEN 0.0D ELSE 1.0D END"
    upper_fac = "greatest(0, least(255, 512 - upper * 2)) / 255.0D"
    lower_fac = "greatest(0, least(128, 128 - lower)) / 128.0D"
    score = (
        f"CASE WHEN _h <= 4 THEN 0.0D ELSE least(1.0D, 2.0D * CASE WHEN middle_gray > 0.35D THEN 0.0D ELSE 1.0D END "
        f"* ({ratio}) * {upper_fac} * ({lower_fac}) * ({lower_fac}) * ({lower_fac}) "
        f"* CASE WHEN share > 0.05D THEN 1.0D ELSE 0.0D END) END"
    )
    return facts.selectExpr("image_id", "middle_gray", "share", f"{score} AS sunset")

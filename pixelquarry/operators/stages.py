"""The fixed order of processing stages, and idempotent saving of results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelquarry.functions.geometry import with_fit
from pixelquarry.operators import kernels, luts, stats
from pixelquarry.operators import pixels as px
from pixelquarry.session import materialise

NEUTRAL = 1e-4


@dataclass
class Stages:
    """What to do to a group of images that share their parameters."""

    width: str = "w"
    height: str = "h"
    high_quality: bool = True
    grow: bool = False
    unsharp: tuple[float, float, float] = (1.0, 0.0, 0.0)
    saturation: float = 1.0
    contrast: float = 0.0
    gamma: float = 1.0
    auto_contrast: bool = False
    auto_cut: float = 0.001
    density: bool = False
    density_values: int = 120_000
    density_cut: float = 0.01
    lighten: float = 0.5
    darken: float = 0.25
    steepness: float = 0.5
    dim: list[tuple[tuple[int, int, int, int], float]] = field(default_factory=list)
    grid: bool = False


def resample(pixels: DataFrame, s: Stages) -> DataFrame:
    if not s.high_quality:
        return px.resize_point(pixels, s.width, s.height)
    return kernels.resize(pixels, s.width, s.height, "bicubic" if s.grow else "quality")


def sizes_of(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg(F.max("w").alias("w"), F.max("h").alias("h"))


def process(pixels: DataFrame, s: Stages, images: DataFrame | None = None) -> DataFrame:
    """Resample, unsharp, saturation, tables, density, dimming, grid; neutral stages are left out of the plan.

    Statistics for the automatic tables come from the unprocessed pixels. Sizes
    after each stage follow from ``images`` (image_id, w, h; counted from the
    pixels if absent), never from processed pixels. A resampled set that the
    unsharp stage reads twice is written once.
    """
    source = pixels
    radius, amount, threshold = s.unsharp
    sharpen = abs(amount) >= NEUTRAL
    curved = abs(s.contrast) >= NEUTRAL or abs(s.gamma - 1.0) >= NEUTRAL
    resized = (s.width, s.height) != ("w", "h")
    if images is None and (curved or s.auto_contrast or s.density):
        images = sizes_of(source)
    if resized:
        pixels = resample(pixels, s)
        pixels = materialise(pixels) if sharpen else pixels
        images = images.selectExpr("image_id", f"cast({s.width} AS int) AS w", f"cast({s.height} AS int) AS h") if images is not None else None
    if sharpen:
        pixels = kernels.unsharp(pixels, radius, amount, threshold)
    if abs(s.saturation - 1.0) > NEUTRAL:
        pixels = luts.saturate(pixels, f"{s.saturation!r}D")
    if curved or s.auto_contrast:
        arrays = images
        if curved:
            fixed = images.withColumns({"contrast": F.lit(s.contrast), "gamma": F.lit(s.gamma)})
            arrays = luts.with_contrast_gamma(fixed).drop("contrast", "gamma")
        else:
            arrays = arrays.withColumn("lut", F.lit(None).cast("array<int>"))
        if s.auto_contrast:
            hist = stats.hist_exact(source)
            curves = luts.auto_contrast(stats.bw_points(hist, s.auto_cut), stats.color_cast(stats.hist_means(hist)))
            arrays = luts.composed(arrays.join(curves, "image_id", "left"), "w", "h")
        else:
            arrays = arrays.select("image_id", "w", "h", *[F.col("lut").alias(f"lut_{c}") for c in "bgr"])
        pixels = luts.apply_luts(pixels, arrays)
    if s.density:
        grid = px.sample_grid(source, s.density_values)
        mask = luts.scale_map(luts.density_map(stats.block_mean_4x4(grid)), s.lighten, s.darken)
        points = stats.gray_points(stats.hist_exact(grid), s.density_cut).withColumn("steepness", F.lit(s.steepness))
        facts = luts.density_facts(mask, luts.density_gain(points))
        pixels = luts.density_correct(pixels, facts.join(images, "image_id"))
    for rect, factor in s.dim:
        pixels = px.dim_rect(pixels, rect, factor)
    return px.grid_lines(pixels) if s.grid else pixels


def thumbnail(pixels: DataFrame, box: tuple[int, int] = (160, 160), small: int | None = None) -> DataFrame:
    """Fit into a box without enlarging. ``small``: images of so many pixels or more start from their sub-sample; by default all start from all pixels."""
    if small is None:
        return _fitted(pixels, pixels, box)
    large = f"cast(w AS bigint) * h >= {small}"
    start = pixels.filter(f"NOT ({large})").unionByName(px.sample_grid(pixels.filter(large), small).select(*pixels.columns))
    return _fitted(pixels, start, box)


def _fitted(pixels: DataFrame, start: DataFrame, box: tuple[int, int]) -> DataFrame:
    sized = with_fit(start, str(box[0]), str(box[1])).withColumnsRenamed({"fit_w": "tw", "fit_h": "th"}).drop("zoom")
    same = sized.filter("tw = w AND th = h").select(*pixels.columns)
    smaller = sized.filter("NOT (tw = w AND th = h)")
    return same.unionByName(kernels.resize(smaller, "tw", "th", "quality").select(*pixels.columns))


def register_saved(store: DataFrame, hashes: DataFrame, neutral: dict[str, float]) -> DataFrame:
    """Rows to append to the store so that saved results are never processed again.

    Keys already stored are skipped, so a repeated run appends nothing.
    """
    fresh = hashes.filter("hash <> 0").select("hash").distinct().join(store.select("hash"), "hash", "left_anti")
    return fresh.select("hash", *[F.lit(v).alias(k) for k, v in neutral.items()])


def save_processed(pixels: DataFrame, hashes: DataFrame, store: DataFrame, folder: str, neutral: dict[str, float]) -> DataFrame:
    """Append the pixels of images whose key isn't in the store yet, and return the store rows to append.

    ``hashes`` (image_id, hash) are joined before anything is written, so a run with the store's new rows adds and erases nothing (an image without
    a key, hash 0, can't be known and is written each time). Rows are dealt by (image, line), so a giant image is written by many tasks.
    """
    known = hashes.filter("hash <> 0").join(store.select("hash"), "hash", "left_semi").select("image_id").distinct()
    pixels.join(known, "image_id", "left_anti").repartition("image_id", "y").write.mode("append").parquet(folder)
    return register_saved(store, hashes, neutral)

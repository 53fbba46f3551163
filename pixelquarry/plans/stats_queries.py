"""Queries over histograms and scores."""

from pyspark.sql import functions as F

from pixelquarry.operators import stats
from pixelquarry.plans import views
from pixelquarry.plans.registry import Registry

R = Registry()

HIST = """hist AS (SELECT image_id, channel, bin, count(*) AS n FROM (
  SELECT image_id, unnest(['b','g','r','gray']) AS channel, unnest([b, g, r, (b * 128 + g * 640 + r * 256) >> 10]) AS bin FROM {src}) GROUP BY ALL)"""
RUNS = """runs AS (SELECT *, sum(n) OVER (PARTITION BY image_id, channel ORDER BY bin)::BIGINT AS cum_up,
  sum(n) OVER (PARTITION BY image_id, channel ORDER BY bin DESC)::BIGINT AS cum_down,
  sum(n) OVER (PARTITION BY image_id, channel)::BIGINT AS total FROM hist)"""
H8 = HIST.format(src="pixels")
BLOCKS = """blocks AS (SELECT image_id, w // 4 AS w, h // 4 AS h, x // 4 AS x, y // 4 AS y, (sum(b)::BIGINT) >> 4 AS b, (sum(g)::BIGINT) >> 4 AS g,
  (sum(r)::BIGINT) >> 4 AS r FROM pixels32 GROUP BY ALL)"""
ROWS = "brows AS (SELECT image_id, h, y, sum(b)::BIGINT // max(w) AS b, sum(g)::BIGINT // max(w) AS g, sum(r)::BIGINT // max(w) AS r FROM blocks GROUP BY ALL)"
SHARE = """hue AS (SELECT *, greatest(r, g, b) AS top, least(r, g, b) AS low FROM blocks),
hue2 AS (SELECT *, 60.0::DOUBLE * CASE WHEN top = low THEN 0 WHEN r = top THEN (g - b)::DOUBLE / (top - low) WHEN g = top THEN 2 + (b - r)::DOUBLE / (top - low) ELSE 4 + (r - g)::DOUBLE / (top - low) END AS hue0 FROM hue),
hue3 AS (SELECT *, CASE WHEN hue0 < 0 THEN hue0 + 360 ELSE hue0 END AS hdeg FROM hue2),
share AS (SELECT image_id, sum(CASE WHEN top > 0 AND top <> low AND (hdeg > 350 OR hdeg < 30) AND top > 51 AND (top - low) * 10 > top THEN 1 ELSE 0 END)::DOUBLE / count(*) AS share FROM hue3 GROUP BY 1)"""


def hist8(s, d):
    return stats.hist_exact(views.pixels(s, d))


def blocks32(s, d):
    return stats.block_mean_4x4(views.pixels32(s, d))


R.add("hist_exact", f"WITH {HIST.format(src='pixel_samples')} SELECT * FROM hist", "pixel_samples")(
    lambda s, d: stats.hist_exact(views.pixel_samples(s, d)))

R.add("hist_sampled", f"""WITH keep AS (SELECT * FROM pixels32 WHERE x % 2 = 0 AND y % 2 = 0 AND x // 2 < 16 AND y // 2 < 16),
 {HIST.format(src='keep')} SELECT * FROM hist""", "pixels32")(
    lambda s, d: stats.hist_sampled(views.pixels32(s, d), num_values=500))

R.add("hist_region", f"""WITH keep AS (SELECT * FROM pixels32 WHERE x >= 5 AND x < 21 AND y >= 8 AND y < 30),
 {HIST.format(src='keep')} SELECT * FROM hist""", "pixels32")(
    lambda s, d: stats.hist_region(views.pixels32(s, d), 5, 8, 21, 30))


@R.add("hist_merge", f"""WITH {H8}, m AS (SELECT image_id // 16 AS album, channel, bin, n FROM hist)
 SELECT album, sum(CASE WHEN channel = 'gray' THEN n ELSE 0 END)::BIGINT AS total,
  sum(CASE WHEN channel = 'b' THEN bin * n END)::BIGINT // sum(CASE WHEN channel = 'b' THEN n END)::BIGINT AS b_mean,
  sum(CASE WHEN channel = 'g' THEN bin * n END)::BIGINT // sum(CASE WHEN channel = 'g' THEN n END)::BIGINT AS g_mean,
  sum(CASE WHEN channel = 'r' THEN bin * n END)::BIGINT // sum(CASE WHEN channel = 'r' THEN n END)::BIGINT AS r_mean FROM m GROUP BY 1""", "pixels")
def hist_merge(s, d):
    merged = stats.hist_merge(hist8(s, d).withColumn("album", F.expr("image_id div 16")), "album")
    return stats.hist_means(merged, "album")


R.add("hist_area", f"""WITH {H8} SELECT image_id, channel,
 sum(CASE WHEN bin BETWEEN 26 AND 128 THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE AS area FROM hist GROUP BY 1, 2""", "pixels")(
    lambda s, d: stats.hist_area(hist8(s, d), 0.1, 0.5))

R.add("running_histogram", f"WITH {H8}, {RUNS} SELECT image_id, channel, bin, n, cum_up, cum_down FROM runs", "pixels")(
    lambda s, d: stats.running_histogram(hist8(s, d)))

R.add("bw_points", f"""WITH {HIST.format(src='pixel_samples')}, {RUNS}, l AS (SELECT *, floor(total * 0.1::DOUBLE + 0.5::DOUBLE)::BIGINT AS level FROM runs)
 SELECT image_id, channel, max(level) AS level,
  CASE WHEN max(level) = 0 THEN 0.0::DOUBLE ELSE min(bin) FILTER (WHERE cum_up >= level) / 255.0::DOUBLE END AS black,
  CASE WHEN max(level) = 0 THEN 1.0::DOUBLE ELSE max(bin) FILTER (WHERE cum_down >= level) / 255.0::DOUBLE END AS white
 FROM l GROUP BY 1, 2""", "pixel_samples")(
    lambda s, d: stats.bw_points(stats.hist_exact(views.pixel_samples(s, d)), cut=0.1))

R.add("gray_points", f"""WITH {H8}, {RUNS}, l AS (SELECT *, trunc(total * 0.02::DOUBLE)::BIGINT AS lim FROM runs WHERE channel = 'gray')
 SELECT image_id, CASE WHEN max(lim) = 0 THEN -1 ELSE min(bin) FILTER (WHERE cum_up >= lim) END / 255.0::DOUBLE AS black_pt,
  CASE WHEN max(lim) = 0 THEN 256 ELSE max(bin) FILTER (WHERE cum_down >= lim) END / 255.0::DOUBLE AS white_pt FROM l GROUP BY 1""", "pixels")(
    lambda s, d: stats.gray_points(hist8(s, d), cut=0.02))

NIGHT = """nf AS (SELECT image_id, CASE WHEN max(total * 80 // 100) = 0 THEN -1 ELSE min(bin) FILTER (WHERE channel = 'gray' AND cum_up >= total * 80 // 100) END / 255.0::DOUBLE AS value80,
  sum(CASE WHEN channel = 'gray' AND bin <= 26 THEN n ELSE 0 END)::DOUBLE / max(total)::DOUBLE AS dark,
  greatest(sum(CASE WHEN channel = 'b' AND bin >= 102 THEN n ELSE 0 END)::DOUBLE / max(total)::DOUBLE,
   sum(CASE WHEN channel = 'g' AND bin >= 102 THEN n ELSE 0 END)::DOUBLE / max(total)::DOUBLE,
   sum(CASE WHEN channel = 'r' AND bin >= 102 THEN n ELSE 0 END)::DOUBLE / max(total)::DOUBLE) AS light FROM runs GROUP BY 1),
night AS (SELECT image_id, value80, greatest(0.0::DOUBLE, least(1.0::DOUBLE, least(1.0::DOUBLE, (1.0::DOUBLE - value80) * 1.6::DOUBLE)
  - greatest(0.0::DOUBLE, 1.0::DOUBLE - dark * 3.0::DOUBLE) - 5.0::DOUBLE * light)) AS night FROM nf)"""


def dimmed(px):
    """Darker and darker copies of the images, so that night scores differ."""
    return px.selectExpr("image_id", "w", "h", "x", "y", *[f"cast({c} div (1 + image_id % 8 * 2) AS int) AS {c}" for c in "bgr"])


DIMMED = "dimmed AS (SELECT image_id, w, h, x, y, b // (1 + image_id % 8 * 2) AS b, g // (1 + image_id % 8 * 2) AS g, r // (1 + image_id % 8 * 2) AS r FROM pixels)"
R.add("night_score", f"WITH {DIMMED}, {HIST.format(src='dimmed')}, {RUNS}, {NIGHT} SELECT * FROM night", "pixels")(
    lambda s, d: stats.night_score(stats.hist_exact(dimmed(views.pixels(s, d)))))

R.add("percentile_80", f"WITH {H8}, {RUNS}, {NIGHT} SELECT image_id, value80 FROM night", "pixels")(
    lambda s, d: stats.night_score(hist8(s, d)).select("image_id", "value80"))

R.add("histogram_normalized", f"""WITH {H8} SELECT image_id, channel, bin, n,
 sqrt(n::DOUBLE) / sqrt(max(n) OVER (PARTITION BY image_id, channel)::DOUBLE) AS height FROM hist""", "pixels")(
    lambda s, d: stats.histogram_normalized(hist8(s, d)))

MEANS = """means AS (SELECT image_id, sum(CASE WHEN channel = 'gray' THEN n ELSE 0 END)::BIGINT AS total,
  sum(CASE WHEN channel = 'b' THEN bin * n END)::BIGINT // sum(CASE WHEN channel = 'b' THEN n END)::BIGINT AS b_mean,
  sum(CASE WHEN channel = 'g' THEN bin * n END)::BIGINT // sum(CASE WHEN channel = 'g' THEN n END)::BIGINT AS g_mean,
  sum(CASE WHEN channel = 'r' THEN bin * n END)::BIGINT // sum(CASE WHEN channel = 'r' THEN n END)::BIGINT AS r_mean FROM hist GROUP BY 1)"""
CAST = """dev AS (SELECT *, b_mean / 255.0::DOUBLE - (b_mean + g_mean + r_mean) / 765.0::DOUBLE AS db, g_mean / 255.0::DOUBLE - (b_mean + g_mean + r_mean) / 765.0::DOUBLE AS dg,
  r_mean / 255.0::DOUBLE - (b_mean + g_mean + r_mean) / 765.0::DOUBLE AS dr FROM means),
casts AS (SELECT image_id, total, b_mean, g_mean, r_mean, db * CASE WHEN db > 0 THEN 0.3::DOUBLE ELSE 0.15::DOUBLE END AS cast_b,
 dg * CASE WHEN dg > 0 THEN 0.1::DOUBLE ELSE 0.3::DOUBLE END AS cast_g, dr * CASE WHEN dr > 0 THEN 0.2::DOUBLE ELSE 0.3::DOUBLE END AS cast_r FROM dev)"""
R.add("color_cast", f"""WITH {H8}, {MEANS}, {CAST} SELECT image_id, total, b_mean, g_mean, r_mean, floor(cast_b * 1e9 + 0.5)::BIGINT AS cast_b,
 floor(cast_g * 1e9 + 0.5)::BIGINT AS cast_g, floor(cast_r * 1e9 + 0.5)::BIGINT AS cast_r FROM casts""", "pixels")(
    lambda s, d: stats.color_cast(stats.hist_means(hist8(s, d))).selectExpr(
        "image_id", "total", "b_mean", "g_mean", "r_mean", *[f"floor(cast_{c} * 1e9D + 0.5D) AS cast_{c}" for c in "bgr"]))

R.add("block_mean_4x4", f"WITH {BLOCKS} SELECT * FROM blocks", "pixels32")(blocks32)


@R.add("row_means", f"""WITH {BLOCKS}, {ROWS} SELECT image_id, h, y, b, g, r, mg AS middle_gray FROM brows
 JOIN (SELECT image_id, sum((b * 128 + g * 640 + r * 256) >> 10)::DOUBLE / max(h)::DOUBLE / 255.0::DOUBLE AS mg FROM brows GROUP BY 1) USING (image_id)""", "pixels32")
def row_means(s, d):
    rows = stats.row_means(blocks32(s, d))
    return rows.join(stats.middle_gray(rows), "image_id")


R.add("sunset_pixel_share", f"WITH {BLOCKS}, {SHARE} SELECT * FROM share", "pixels32")(
    lambda s, d: stats.sunset_pixel_share(blocks32(s, d)))


def dusk(px):
    """Images whose lower rows are dark and whose upper rows are reddish, to a varying degree."""
    return px.selectExpr(
        "image_id", "w", "h", "x", "y",
        "cast(b div (CASE WHEN y >= 25 THEN 8 ELSE 4 + image_id % 3 END) AS int) AS b",
        "cast(g div (CASE WHEN y >= 25 THEN 8 ELSE 3 + image_id % 2 END) AS int) AS g",
        "cast(CASE WHEN y >= 25 THEN r div 6 ELSE 60 + r div (2 + image_id % 3) END AS int) AS r",
    )


DUSK = """dusk AS (SELECT image_id, w, h, x, y, b // (CASE WHEN y >= 25 THEN 8 ELSE 4 + image_id % 3 END) AS b,
 g // (CASE WHEN y >= 25 THEN 8 ELSE 3 + image_id % 2 END) AS g, CASE WHEN y >= 25 THEN r // 6 ELSE 60 + r // (2 + image_id % 3) END AS r FROM pixels32)"""
R.add("sunset_score", f"""WITH {DUSK}, {BLOCKS.replace('pixels32', 'dusk')}, {ROWS}, {SHARE},
 halves AS (SELECT image_id, sum((b * 128 + g * 640 + r * 256) >> 10)::DOUBLE / max(h)::DOUBLE / 255.0::DOUBLE AS middle_gray,
  sum(CASE WHEN y >= h - h // 5 THEN (b * 128 + g * 768 + r * 128) >> 10 ELSE 0 END)::BIGINT // max(h // 5) AS lower,
  sum(CASE WHEN y >= h - h // 5 THEN 0 ELSE (b * 128 + g * 768 + r * 128) >> 10 END)::BIGINT // max(h - h // 5) AS upper FROM brows GROUP BY 1),
 f AS (SELECT *, greatest(0, least(128, 128 - lower)) / 128.0::DOUBLE AS lf, greatest(0, least(255, 512 - upper * 2)) / 255.0::DOUBLE AS uf FROM halves JOIN share USING (image_id))
 SELECT image_id, middle_gray, share, least(1.0::DOUBLE, 2.0::DOUBLE * CASE WHEN middle_gray > 0.35 THEN 0 ELSE 1 END
  * CASE WHEN lower = 0 THEN 1 WHEN upper < lower THEN 0 ELSE 1 END * uf * lf * lf * lf * CASE WHEN share > 0.05 THEN 1 ELSE 0 END) AS sunset FROM f""", "pixels32")(
    lambda s, d: stats.sunset_score(stats.block_mean_4x4(dusk(views.pixels32(s, d)))))

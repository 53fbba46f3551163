"""Queries over photo metadata and geometry."""

from pyspark.sql import functions as F

from pixelquarry.functions import geometry, metadata
from pixelquarry.plans import views
from pixelquarry.plans.registry import Registry

R = Registry()


def micro(c):
    return F.floor(c * 1e6 + 0.5)


_P = r"'^\s*(\d+):\s*(\d+):\s*(\d+)\s+(\d+):\s*(\d+):\s*(\d+)'"
DATE = f"""dates AS (SELECT *, TRY_CAST(regexp_extract(date_raw, {_P}, 1) AS INT) AS yy, CASE WHEN TRY_CAST(regexp_extract(date_raw, {_P}, 1) AS INT) > 1600 THEN TRY(make_timestamp(regexp_extract(date_raw, {_P}, 1)::BIGINT, regexp_extract(date_raw, {_P}, 2)::BIGINT,
 regexp_extract(date_raw, {_P}, 3)::BIGINT, regexp_extract(date_raw, {_P}, 4)::BIGINT, regexp_extract(date_raw, {_P}, 5)::BIGINT, regexp_extract(date_raw, {_P}, 6)::DOUBLE)) END AS taken FROM exif)"""
R.add("exif_date_parse", f"WITH {DATE} SELECT image_id, strftime(taken, '%Y-%m-%d %H:%M:%S') AS taken FROM dates", "exif")(
    lambda s, d: views.exif(s, d).select("image_id", F.date_format(metadata.photo_date("date_raw"), "yyyy-MM-dd HH:mm:ss").alias("taken")))

R.add("capture_date", f"WITH {DATE} SELECT image_id, strftime(coalesce(taken, CASE WHEN image_id % 2 = 0 THEN TIMESTAMP '2001-02-03 04:05:06' END, mtime), '%Y-%m-%d %H:%M:%S') AS shot FROM dates", "exif")(
    lambda s, d: views.exif(s, d).withColumn("saved", F.expr("IF(image_id % 2 = 0, '2001:2:3 4:5:6', NULL)")).select(
        "image_id", F.date_format(F.coalesce(metadata.photo_date("date_raw"), metadata.photo_date("saved"), F.col("mtime")), "yyyy-MM-dd HH:mm:ss").alias("shot")))


def _reduced(s, d):
    rows = views.exif(s, d).selectExpr("image_id", "exposure_num * IF(image_id % 3 = 0, -12, 12) AS n", "exposure_den * 9 AS m")
    num, den = metadata.reduced("n", "m")
    return rows.select("image_id", num.alias("num"), den.alias("den"))


R.add("rational_reduce", """WITH t AS (SELECT image_id, exposure_num * CASE WHEN image_id % 3 = 0 THEN -12 ELSE 12 END AS n, exposure_den * 9 AS m FROM exif)
 SELECT image_id, CASE WHEN n = 0 OR m = 0 THEN n WHEN n < 0 THEN -(abs(n) // gcd(abs(n), abs(m))) ELSE n // gcd(n, m) END AS num, CASE WHEN n = 0 OR m = 0 THEN m ELSE m // gcd(abs(n), m) END AS den FROM t""", "exif")(_reduced)

R.add("rational_to_double", "SELECT image_id, CASE WHEN exposure_den = 0 THEN NULL ELSE exposure_num::DOUBLE / exposure_den::DOUBLE END AS exposure FROM exif", "exif")(
    lambda s, d: views.exif(s, d).select("image_id", metadata.fraction_value("exposure_num", "exposure_den").alias("exposure")))

GPS = """g AS (SELECT image_id, lat_ref, lon_ref, CASE WHEN lat_min = 0 AND lat_sec = 0 THEN trunc(lat_deg) ELSE lat_deg END AS d1, CASE WHEN lat_min = 0 AND lat_sec = 0 THEN 60 * abs(lat_deg - trunc(lat_deg)) ELSE lat_min END AS m1, lat_sec AS s1,
  CASE WHEN lon_min = 0 AND lon_sec = 0 THEN trunc(lon_deg) ELSE lon_deg END AS d2, CASE WHEN lon_min = 0 AND lon_sec = 0 THEN 60 * abs(lon_deg - trunc(lon_deg)) ELSE lon_min END AS m2, lon_sec AS s2 FROM exif),
 g2 AS (SELECT image_id, lat_ref, lon_ref, d1, CASE WHEN s1 = 0 THEN trunc(m1) ELSE m1 END AS m1, CASE WHEN s1 = 0 THEN 60 * abs(m1 - trunc(m1)) ELSE s1 END AS s1,
  d2, CASE WHEN s2 = 0 THEN trunc(m2) ELSE m2 END AS m2, CASE WHEN s2 = 0 THEN 60 * abs(m2 - trunc(m2)) ELSE s2 END AS s2 FROM g),
 dec AS (SELECT *, CASE WHEN lat_ref = 'S' THEN -(d1 + m1 / 60 + s1 / 3600) ELSE d1 + m1 / 60 + s1 / 3600 END AS lat, CASE WHEN lon_ref = 'W' THEN -(d2 + m2 / 60 + s2 / 3600) ELSE d2 + m2 / 60 + s2 / 3600 END AS lng FROM g2)"""


@R.add("gps_decimal", f"""WITH {GPS} SELECT image_id, floor(lat * 1e6 + 0.5)::BIGINT AS lat_micro, floor(lng * 1e6 + 0.5)::BIGINT AS lng_micro,
 d1::BIGINT || '° ' || round_even(m1, 0)::BIGINT || ''' ' || round_even(s1, 0)::BIGINT || ''''' ' || lat_ref || ' / ' || d2::BIGINT || '° ' || round_even(m2, 0)::BIGINT || ''' ' || round_even(s2, 0)::BIGINT || ''''' ' || lon_ref AS dms,
 regexp_matches('https://map/' || round(lat, 3) || '/' || round(lng, 3), '^https://map/-?[0-9.]+/-?[0-9.]+$') AS url_ok FROM dec""", "exif")
def gps_decimal(s, d):
    rows = views.exif(s, d).withColumns({
        "lat": metadata.gps_decimal("lat_ref", "lat_deg", "lat_min", "lat_sec"), "lng": metadata.gps_decimal("lon_ref", "lon_deg", "lon_min", "lon_sec")})
    dms = metadata.dms_text(("lat_ref", "lat_deg", "lat_min", "lat_sec"), ("lon_ref", "lon_deg", "lon_min", "lon_sec"))
    url = metadata.map_url(F.col("lat"), F.col("lng"), "https://map/{lat}/{lng}")
    return rows.select("image_id", micro(F.col("lat")).alias("lat_micro"), micro(F.col("lng")).alias("lng_micro"), dms.alias("dms"),
                       url.rlike(r"^https://map/-?\d+\.\d{5}/-?\d+\.\d{5}$").alias("url_ok"))


R.add("gps_altitude", "SELECT image_id, CASE WHEN alt_den = 0 THEN NULL ELSE alt_num::DOUBLE / alt_den * CASE WHEN alt_ref = 1 THEN -1 ELSE 1 END END + 0.0 AS altitude FROM exif", "exif")(
    lambda s, d: views.exif(s, d).select("image_id", (metadata.altitude("alt_num", "alt_den", "alt_ref") + F.lit(0.0)).alias("altitude")))

R.add("camera_name", """SELECT image_id, CASE WHEN make = '' OR contains(model, string_split(make, ' ')[1]) THEN model ELSE string_split(make, ' ')[1] || ' ' || model END AS camera FROM exif""", "exif")(
    lambda s, d: views.exif(s, d).select("image_id", metadata.camera_name("make", "model").alias("camera")))

R.add("comment_pick", """SELECT image_id, coalesce(nullif(nullif(trim(user_comment), ''), 'User comments'), nullif(trim(description), ''), nullif(trim(jpeg_comment), '')) AS comment FROM exif""", "exif")(
    lambda s, d: views.exif(s, d).select("image_id", metadata.best_comment("user_comment", "description", "jpeg_comment").alias("comment")))

R.add("jpeg_comment", """SELECT doc_id, length(c) >= 7 AND length(regexp_replace(c, '[^a-zA-Z0-9 ,.]', '', 'g')) > length(c) * 8 // 10 AS readable FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN left(text, 5) ELSE text END AS c FROM documents)""")(
    lambda s, d: views.table(s, d, "documents").selectExpr("doc_id", "IF(doc_id % 9 = 0, left(text, 5), text) AS c").select("doc_id", metadata.mostly_plain("c").alias("readable")))

R.add("orientation_to_rotation", """SELECT image_id, CASE WHEN thumb_w > 0 AND thumb_h > 0 AND (width > height) <> (thumb_w > thumb_h) THEN -1 WHEN orientation = 1 THEN 0 WHEN orientation = 3 THEN 180 WHEN orientation = 6 THEN 90 WHEN orientation = 8 THEN 270 ELSE -1 END AS rotation,
 CASE WHEN width >= height AND (orientation & 4) <> 0 THEN CASE WHEN orientation & 1 = 1 THEN 270 ELSE 90 END ELSE 0 END AS raw_rotation FROM exif""", "exif")(
    lambda s, d: views.exif(s, d).select(
        "image_id", metadata.rotation("orientation", "width", "height", "thumb_w", "thumb_h", "-1").alias("rotation"),
        metadata.raw_rotation("orientation", "width", "height").alias("raw_rotation")))

R.add("flash_flag", "SELECT image_id, flash % 2 = 1 AS fired FROM exif", "exif")(
    lambda s, d: views.exif(s, d).select("image_id", metadata.flash_fired("flash").alias("fired")))

# --- geometry --------------------------------------------------------------------------------


def _fit_duck(name, zoom_in, fill, limit):
    low = "least(a1, a2)"
    high = "greatest(a1, a2)"
    first = low if fill else high
    keep = "false" if zoom_in else f"{first} <= 1 AND {high} <= 1"
    ar = f"CASE WHEN {first} <= 1 THEN {high} ELSE {first} END" if fill and not zoom_in else first
    lim = f"CASE WHEN (width / ar * height / ar) / (320 * 200) > 1.5 THEN {high} ELSE ar END" if fill and limit else "ar"
    return f"""{name}0 AS (SELECT *, {keep} AS kp, {ar} AS ar FROM base), {name}1 AS (SELECT * EXCLUDE (ar), {lim} AS ar FROM {name}0),
 {name}2 AS (SELECT *, trunc(width / ar + 0.5)::BIGINT AS fw, trunc(height / ar + 0.5)::BIGINT AS fh FROM {name}1),
 {name} AS (SELECT image_id, '{name}' AS how, CASE WHEN kp THEN width WHEN abs(fw - 320) <= 1 AND abs(fh - 200) <= 1 THEN 320 ELSE fw END AS fit_w,
  CASE WHEN kp THEN height WHEN abs(fw - 320) <= 1 AND abs(fh - 200) <= 1 THEN 200 ELSE fh END AS fit_h,
  floor(CASE WHEN kp THEN 1.0 WHEN abs(fw - 320) <= 1 AND abs(fh - 200) <= 1 THEN 320 / width::DOUBLE ELSE 1.0 / ar END * 1e6 + 0.5)::BIGINT AS zoom FROM {name}2)"""


_FITS = {"fit": (True, False, False), "fit_keep": (False, False, False), "fill": (True, True, False), "fill_keep": (False, True, True)}


@R.add("fit_rect", "WITH base AS (SELECT image_id, width, height, width / 320.0::DOUBLE AS a1, height / 200.0::DOUBLE AS a2 FROM exif), "
       + ", ".join(_fit_duck(n, *f) for n, f in _FITS.items()) + " " + " UNION ALL ".join(f"SELECT * FROM {n}" for n in _FITS), "exif")
def fit_rect(s, d):
    out = None
    for how, (zoom_in, fill, limit) in _FITS.items():
        one = geometry.with_fit(views.exif(s, d).select("image_id", "width", "height"), "320", "200", zoom_in, fill, limit, "width", "height")
        one = one.select("image_id", F.lit(how).alias("how"), "fit_w", "fit_h", micro(F.col("zoom")).alias("zoom"))
        out = one if out is None else out.unionByName(one)
    return out


@R.add("centred_rect", """WITH b AS (SELECT image_id, width::DOUBLE / height AS ar FROM exif)
 SELECT image_id, CASE WHEN ar > 280.0 / 160 THEN 20 ELSE 20 + trunc((280 - trunc(160 * ar + 0.5)) / 2)::INT END AS rect_left,
 CASE WHEN ar > 280.0 / 160 THEN 30 + trunc((160 - trunc(280 / ar + 0.5)) / 2)::INT ELSE 30 END AS rect_top,
 CASE WHEN ar > 280.0 / 160 THEN 300 ELSE 20 + trunc((280 - trunc(160 * ar + 0.5)) / 2)::INT + trunc(160 * ar + 0.5)::INT END AS rect_right,
 CASE WHEN ar > 280.0 / 160 THEN 30 + trunc((160 - trunc(280 / ar + 0.5)) / 2)::INT + trunc(280 / ar + 0.5)::INT ELSE 190 END AS rect_bottom FROM b""", "exif")
def centred_rect(s, d):
    return views.exif(s, d).select("image_id", *[c.alias(n) for n, c in geometry.centred_rect("width", "height", "20", "30", "300", "190").items()])


@R.add("aspect_ratio", """SELECT image_id, width // gcd(width, height) AS ratio_w, height // gcd(width, height) AS ratio_h, floor(width / 1.5::DOUBLE + 0.5)::BIGINT AS crop_h, floor(height * 1.5::DOUBLE + 0.5)::BIGINT AS crop_w FROM exif""", "exif")
def aspect_ratio(s, d):
    rw, rh = geometry.aspect("width", "height")
    return views.exif(s, d).select("image_id", rw.alias("ratio_w"), rh.alias("ratio_h"), geometry.ratio_height("width", "1.5D").alias("crop_h"), geometry.ratio_width("height", "1.5D").alias("crop_w"))


@R.add("crop_block_align", """WITH c AS (SELECT image_id, width, height, thumb_w % 60 + 1 AS l, width - 1 - orientation AS r FROM exif)
 SELECT image_id, width % 16 = 0 AND height % 8 = 0 AS whole_blocks, l - l % 16 AS crop_left, CASE WHEN r + (16 - r % 16) % 16 > width THEN r + (16 - r % 16) % 16 - 16 ELSE r + (16 - r % 16) % 16 END AS crop_right FROM c""", "exif")
def crop_block_align(s, d):
    rows = views.exif(s, d).selectExpr("image_id", "width", "height", "thumb_w % 60 + 1 AS l", "width - 1 - orientation AS r")
    left, right = geometry.snap_to_blocks("l", "r", "width", 16)
    return rows.select("image_id", geometry.block_aligned("width", "height", 16, 8).alias("whole_blocks"), left.alias("crop_left"), right.alias("crop_right"))


_CORNERS = """c0 AS (SELECT image_id, width AS w, height AS h, ((image_id % 80) - 40) * 0.011::DOUBLE + 0.003::DOUBLE AS ang, (width - 1) * 0.5::DOUBLE AS cx, (height - 1) * 0.5::DOUBLE AS cy FROM exif),
 c AS (SELECT *, [cos(ang) * -cx - sin(ang) * -cy, cos(ang) * cx - sin(ang) * -cy, cos(ang) * cx - sin(ang) * cy, cos(ang) * -cx - sin(ang) * cy] AS xs,
  [sin(ang) * -cx + cos(ang) * -cy, sin(ang) * cx + cos(ang) * -cy, sin(ang) * cx + cos(ang) * cy, sin(ang) * -cx + cos(ang) * cy] AS ys FROM c0),
 b AS (SELECT *, list_min(xs) AS xmin, list_max(xs) AS xmax, list_min(ys) AS ymin, list_max(ys) AS ymax FROM c)"""
R.add("rotated_size", f"""WITH {_CORNERS}, k AS (SELECT * EXCLUDE (xmin, xmax), (xmax + xmin) * 0.5 - 0.5 * (w::DOUBLE / h) * (ymax - ymin) AS x0, (xmax + xmin) * 0.5 + 0.5 * (w::DOUBLE / h) * (ymax - ymin) AS x1 FROM b),
 m AS (SELECT image_id, s.v AS sg, i.i AS i, xs[i.i + 1] AS xa, ys[i.i + 1] AS ya, xs[(i.i + 1) % 4 + 1] - xs[i.i + 1] AS vx, ys[(i.i + 1) % 4 + 1] - ys[i.i + 1] AS vy, x0, x1, ymin, ymax, cx, cy
  FROM k, (SELECT unnest([-1.0::DOUBLE, 1.0::DOUBLE]) AS v) s, (SELECT unnest([0, 1, 2, 3]) AS i) i),
 t AS (SELECT *, (xa * ymin - ya * sg * x1) / (vy * sg * x1 - vx * ymin) AS t FROM m),
 best AS (SELECT image_id, arg_min(xa + t * vx, power(xa + t * vx, 2) + power(ya + t * vy, 2)) FILTER (WHERE t > -1e-8 AND t - 1 < 1e-8) AS bx, arg_min(ya + t * vy, power(xa + t * vx, 2) + power(ya + t * vy, 2)) FILTER (WHERE t > -1e-8 AND t - 1 < 1e-8) AS by_,
  max(cx) AS cx, max(cy) AS cy FROM t GROUP BY 1)
 SELECT b.image_id, trunc(xmin + b.cx - 0.999)::BIGINT AS box_x, trunc(xmax + b.cx + 0.999)::BIGINT - trunc(xmin + b.cx - 0.999)::BIGINT + 1 AS box_w, trunc(ymax + b.cy + 0.999)::BIGINT - trunc(ymin + b.cy - 0.999)::BIGINT + 1 AS box_h,
  round(abs(bx) + best.cx)::BIGINT - round(-abs(bx) + best.cx)::BIGINT + 1 AS in_w, round(abs(by_) + best.cy)::BIGINT - round(-abs(by_) + best.cy)::BIGINT + 1 AS in_h
 FROM b JOIN best USING (image_id)""", "exif")(
    lambda s, d: geometry.rotated_size(
        geometry.rotated_size(
            views.exif(s, d).selectExpr("image_id", "width AS w", "height AS h", "((image_id % 80) - 40) * 0.011D + 0.003D AS ang"), "ang")
        .withColumnsRenamed({"rot_x": "box_x", "rot_w": "box_w", "rot_h": "box_h"}).drop("rot_y"), "ang", crop=True, keep_ratio=True)
    .selectExpr("image_id", "box_x", "box_w", "box_h", "rot_w AS in_w", "rot_h AS in_h"))


@R.add("trapezoid_inner_rect", """WITH t AS (SELECT image_id, orientation * 7 AS x1s, 200 + image_id % 90 AS x1e, (thumb_h + 5) % 40 AS x2s, 190 + orientation * 11 AS x2e, 10 AS y1, 10 + height AS y2 FROM exif),
 n AS (SELECT *, (x1s >= x2s AND x1e <= x2e) OR (x1s <= x2s AND x1e >= x2e) AS nested, x1e - x1s < x2e - x2s AS grows, x1s < x2s AS leans FROM t),
 c AS (SELECT *, CASE WHEN nested THEN x1s WHEN leans AND grows THEN x2s WHEN leans THEN x1s ELSE x1s END AS a, CASE WHEN nested OR leans THEN x1e WHEN grows THEN x2e ELSE x1e END AS b,
  CASE WHEN nested OR leans THEN x2s WHEN grows THEN x2s ELSE x1s END AS c, CASE WHEN nested THEN x2e WHEN leans AND NOT grows THEN x1e ELSE x2e END AS d FROM n),
 c2 AS (SELECT *, CASE WHEN nested OR NOT leans THEN d WHEN grows THEN x2e ELSE x1e END AS d2, b - a AS w1 FROM c),
 v AS (SELECT *, d2 - c AS w2, (y2 - y1) AS hh FROM c2), u AS (SELECT *, (w2 - w1)::DOUBLE / hh AS slope FROM v),
 y AS (SELECT *, CASE WHEN w1 < w2 THEN (1.25::DOUBLE * hh - w1) / (1.25::DOUBLE + slope) ELSE w1 / (1.25::DOUBLE - slope) END AS dy FROM u)
 SELECT image_id, greatest(x1s, x2s) AS free_left, least(x1e, x2e) AS free_right, trunc((c - a) * (dy / hh) + a + 0.5)::BIGINT AS in_left, CASE WHEN w1 < w2 THEN trunc(dy + y1 + 0.5)::BIGINT ELSE y1 END AS in_top,
  trunc(b + (d2 - b) * (dy / hh) + 0.5)::BIGINT AS in_right, CASE WHEN w1 < w2 THEN y2 ELSE trunc(dy + y1 + 0.5)::BIGINT END AS in_bottom FROM y""", "exif")
def trapezoid_inner_rect(s, d):
    rows = views.exif(s, d).selectExpr("image_id", "orientation * 7 AS x1s", "200 + image_id % 90 AS x1e", "(thumb_h + 5) % 40 AS x2s", "190 + orientation * 11 AS x2e", "10 AS y1", "10 + height AS y2")
    free = geometry.trapezoid_inner_rect(rows).withColumnsRenamed({"in_left": "free_left", "in_right": "free_right"}).drop("in_top", "in_bottom")
    return geometry.trapezoid_inner_rect(free, "1.25D").select("image_id", "free_left", "free_right", "in_left", "in_top", "in_right", "in_bottom")

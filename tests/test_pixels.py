"""Pixel sets: properties and brute force on small images."""

import math

import numpy as np
import pytest
import taps
from pyspark.sql import functions as F

from helpers import arrays_of, fits, random_images
from pixelquarry.operators import hashes, kernels, luts, pixels as px, stages, stats, tiles


@pytest.fixture(params=[128, 4])
def tile(request, monkeypatch):
    """Tiles that hold each image of these tests whole, and tiles so small that every filter reaches over several."""
    monkeypatch.setattr(tiles, "SIZE", request.param)


def test_tiles_round_trip(image, tile):
    img = random_images([(7, 5), (4, 4), (1, 9), (13, 130)])
    df = image(img).withColumn("keep", F.lit("k"))
    made = tiles.to_tiles(df, keep=["keep"])
    assert made.columns == ["image_id", "w", "h", "keep", "ty", "tx", "b", "g", "r"]
    fits(arrays_of(tiles.from_tiles(made)), img)


def test_small_and_giant_images_together(image, monkeypatch):
    img = random_images([(5, 4), (30, 17), (8, 8), (9, 3), (64, 2)])
    df = image(img)
    want = [arrays_of(f(df)) for f in (lambda d: kernels.resize(d, "w div 2 + 1", "h + 3", "lanczos"), lambda d: kernels.unsharp(d, 1.5, 1.0, 2.0))]
    monkeypatch.setattr(tiles, "SIZE", 8)
    got = [arrays_of(f(df)) for f in (lambda d: kernels.resize(d, "w div 2 + 1", "h + 3", "lanczos"), lambda d: kernels.unsharp(d, 1.5, 1.0, 2.0))]
    for a, b in zip(got, want, strict=True):
        fits(a, b)


def test_no_row_per_pixel_and_tap(image):
    plan = kernels.resize(image(random_images([(9, 7)])), "5", "4")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_four_turns_and_two_mirrors_are_identity(image):
    img = random_images([(5, 3), (2, 7)])
    df = image(img)
    turned = df
    for _ in range(4):
        turned = px.rotate90(turned, 90)
    fits(arrays_of(turned), img)
    fits(arrays_of(px.mirror(px.mirror(df), True)), img)
    fits(arrays_of(px.rotate90(px.rotate90(df, 90), 270)), img)
    fits(arrays_of(px.rotate90(df, 90)), {i: np.rot90(a, -1) for i, a in img.items()})
    with pytest.raises(ValueError):
        px.rotate90(df, 45)


def test_crop_rejects_and_cuts(image):
    img = random_images([(5, 4), (3, 3)])
    fits(arrays_of(px.crop(image(img), 1, 0, 5, 3)), {0: img[0][0:3, 1:5]})
    with pytest.raises(ValueError):
        px.crop(image(img), 2, 2, 2, 3)


def test_crop_of_paste_is_the_source(image, spark):
    img = random_images([(6, 6), (6, 6)])
    pairs = spark.createDataFrame([(1, 0, 6, 6)], "src_id bigint, image_id bigint, w int, h int")
    pasted = px.paste(image({0: img[0]}), image({1: img[1]}), pairs, (1, 2), (3, 0), (2, 3))
    fits(arrays_of(px.crop(pasted, 3, 0, 5, 3)), {0: img[1][2:5, 1:3]})


def test_resize_point_matches_brute_force(image):
    img = random_images([(7, 5), (3, 4)])
    for tw, th in [(4, 3), (9, 11), (7, 5), (1, 1)]:
        want = {}
        for i, a in img.items():
            h, w = a.shape[:2]
            if tw <= w:
                ix, iy = (w << 16) // tw + 1, (h << 16) // th + 1
            else:
                ix = 0 if tw == 1 else (65536 * (w - 1) + 65535) // (tw - 1)
                iy = 0 if th == 1 else (65536 * (h - 1) + 65535) // (th - 1)
            rows = [(j * iy) >> 16 for j in range(th)]
            if max(rows) >= h:
                continue
            want[i] = a[rows][:, [(k * ix) >> 16 for k in range(tw)]]
        got = arrays_of(px.resize_point(image({i: img[i] for i in want}), str(tw), str(th)))
        fits(got, want)


def _resized(a, kx, ky, tw, th):
    def one(src, k, n):
        out = np.zeros((n, *src.shape[1:]), int)
        for d, s, w in zip(k["dst"], k["src"], k["weight"]):
            out[d] += w * src[s]
        return np.clip((out + 255) >> 14, 0, 255)

    wide = one(a.transpose(1, 0, 2), kx, tw).transpose(1, 0, 2)
    return one(wide, ky, th)


@pytest.mark.parametrize("name,tw,th", [("quality", 5, 4), ("lanczos", 6, 7), ("narrow", 4, 3), ("bicubic", 15, 13)])
def test_filtered_resize_matches_brute_force(image, tile, name, tw, th):
    img = random_images([(11, 9), (11, 9)])
    kx, ky = taps.ResizeTaps(11, tw, name, 0.15).table(), taps.ResizeTaps(9, th, name, 0.15).table()
    want = {i: _resized(a, kx, ky, tw, th) for i, a in img.items()}
    fits(arrays_of(kernels.resize(image(img), str(tw), str(th), name, 0.15)), want)


@pytest.mark.parametrize("src,dst,name", [(64, 10, "quality"), (50, 49, "quality"), (33, 8, "lanczos"), (9, 5, "narrow"), (8, 31, "bicubic"), (2, 5, "bicubic"), (3, 2, "quality")])
def test_taps_add_up_to_one_and_stay_inside(src, dst, name):
    t = taps.ResizeTaps(src, dst, name, 0.2).table()
    assert t["src"].between(0, src - 1).all()
    assert sorted(t["dst"].unique()) == list(range(dst))
    assert (t.groupby("dst")["weight"].sum() == kernels.ONE).all()


def test_flat_image_stays_flat(image, tile):
    flat = {0: np.full((9, 12, 3), 77)}
    for name, w, h in [("quality", 5, 4), ("bicubic", 20, 21)]:
        out = arrays_of(kernels.resize(image(flat), str(w), str(h), name))[0]
        assert (out == 77).all()


def test_step_sizes():
    assert kernels.step_sizes(100, 50, 80, 40) == [(50, 40)]
    assert kernels.step_sizes(1000, 40, 500, 20) == [(200, 100), (40, 20)]


def test_resize_in_steps_is_a_chain_of_resizes(image, tile):
    img = random_images([(30, 24)])
    first, last = kernels.step_sizes(30, 4, 24, 3)
    soft = [taps.ResizeTaps(a, b, "quality", 0.15).table() for a, b in zip((30, 24), first)]
    hard = [taps.ResizeTaps(a, b, "quality", 0.3).table() for a, b in zip(first, last)]
    want = _resized(_resized(img[0], *soft, *first), *hard, *last)
    fits(arrays_of(kernels.resize_steps(image(img), (30, 24), (4, 3), "sharpen medium")), {0: want})


def test_thumbnail_uses_the_sub_sample_for_large_images(image):
    img = random_images([(20, 16), (6, 4)])
    got = arrays_of(stages.thumbnail(image(img), (8, 8), small=200))
    assert got[0].shape == (6, 8, 3)
    assert (got[1] == img[1]).all()


def test_gauss_keeps_the_sum_and_is_symmetric():
    for radius in (0.6, 1.0, 2.5):
        own = taps.gauss_taps(radius)
        assert own.sum() == kernels.ONE and len(own) % 2 == 1 and len(own) <= 15
        assert (own[1:-1] == own[1:-1][::-1]).all()
        half = kernels.blur_profile(radius)
        assert len(half) == len(own) // 2 + 1
    table = taps.gauss_table(5, 2.0)
    assert (table.groupby("dst")["weight"].sum() > 0).all() and table["src"].between(0, 4).all()
    assert kernels.bicubic_phases()[0] == [0, kernels.ONE, 0, 0] and all(sum(p) == kernels.ONE for p in kernels.bicubic_phases())


def _as_rows(table):
    return sorted(map(tuple, table[["src_size", "dst_size", "dst", "src", "weight"]].itertuples(index=False)))


@pytest.mark.parametrize("name", ["quality", "lanczos", "narrow", "bicubic"])
def test_kernel_tables(spark, name):
    pairs = [(8, 13), (1, 5), (2, 9), (5, 1), (3, 100)] if name == "bicubic" else [(32, 11), (9, 9), (100, 99), (7, 1), (640, 3), (2, 2), (1, 1), (33, 17)]
    got = kernels.kernel_table(spark.createDataFrame([*pairs, pairs[0]], "src_size int, dst_size int"), name, 0.2).toPandas()
    assert _as_rows(got) == sorted(r for a, b in pairs for r in _as_rows(taps.ResizeTaps(a, b, name, 0.2).table()))


def test_blur_tables(spark):
    for radius in (0.7, 1.5, 12.0):
        sizes = [1, 2, 5, 16, 200]
        got = kernels.gauss_kernels(spark.createDataFrame([(s,) for s in sizes], "src_size int"), radius).toPandas()
        assert _as_rows(got) == sorted(r for s in sizes for r in _as_rows(taps.gauss_table(s, radius)))


def _bicubic(a, fx, fy, back):
    """One pixel at a 16.16 position, taps outside the image read the background."""
    ph = kernels.bicubic_phases()
    h, w = a.shape[:2]
    sx, sy = fx >> 16, fy >> 16
    if not (-1 <= sx <= w and -1 <= sy <= h):
        return back
    kx, ky = ph[(fx & 0xFFFF) >> 10], ph[(fy & 0xFFFF) >> 10]
    out = []
    for c in range(3):
        total = 8192
        for j in range(4):
            yy = sy + j - 1
            if 0 <= yy < h:
                line = sum((a[yy, sx + i - 1, c] if 0 <= sx + i - 1 < w else back[c]) * kx[i] for i in range(4))
                total += ((line + 8192) >> 14) * ky[j]
            else:
                total += back[c] * ky[j]
        out.append(min(255, max(0, int(total) >> 14)))
    return out


def _near(v):
    return int(v + 0.5) if v >= 0 else int(v - 0.5)


@pytest.mark.parametrize("angle", [0.0, 0.3, -2.1])
def test_bicubic_rotation_matches_brute_force(image, tile, angle):
    img = random_images([(7, 6)])
    back, tw, th = (9, 8, 7), 8, 9
    h, w = img[0].shape[:2]
    cx, cy, co, si = (w - 1) / 2, (h - 1) / 2, math.cos(-angle), math.sin(-angle)
    fx, fy = _near(65536 * (co * -cx - si * -cy + cx)), _near(65536 * (si * -cx + co * -cy + cy))
    steps = _near(65536 * co), _near(65536 * si), _near(65536 * -si), _near(65536 * co)
    want = np.array([[_bicubic(img[0], fx + i * steps[0] + j * steps[2], fy + i * steps[1] + j * steps[3], back) for i in range(tw)] for j in range(th)])
    df = image(img)
    got = px.rotate_bicubic(df, stages.sizes_of(df), f"{angle}D", str(tw), str(th), back, kernels.bicubic_phases())
    fits(arrays_of(got), {0: want})


def _trapezoid_lines(t, n, src_h, dst_h, off):
    h = t["y2"] - t["y1"]
    w1, w2, d1, d2 = t["x1e"] - t["x1s"], t["x2e"] - t["x2s"], t["x1s"] - t["x2s"], t["x1e"] - t["x2e"]
    sign = 1 if w1 < w2 else -1
    nw = sign * min(w1, w2)
    if d1 == 0:
        apex = 0 if d2 == 0 else -nw * h / d2
    elif d2 == 0:
        apex = nw * h / d1
    else:
        m1, m2 = h / d1, h / d2
        apex = 0 if abs(m2 - m1) < 1e-9 else nw * m1 * m2 / (m2 - m1)
    if apex > 0:
        H = apex + h
        b, a, c = (H if sign > 0 else h - H), H * (h - H), (H - h if sign > 0 else -H)
        return [max(0, min((src_h - 1) << 16, int(65536 * (src_h - 1) / (dst_h - 1) * (a / (j + off + c) + b) + 0.5))) for j in range(n)]
    step = (src_h << 16) // dst_h + 1 if dst_h <= src_h else (65536 * (src_h - 1) + 65535) // (dst_h - 1)
    return [(j + off) * step for j in range(n)]


@pytest.mark.parametrize("t", [
    dict(x1s=2, x1e=9, x2s=0, x2e=11, y1=0, y2=8), dict(x1s=0, x1e=10, x2s=2, x2e=9, y1=0, y2=9), dict(x1s=1, x1e=9, x2s=1, x2e=9, y1=0, y2=6)])
def test_bicubic_perspective_matches_brute_force(image, tile, t):
    img = random_images([(9, 8)], seed=4)
    a, back, tw = img[0], (5, 6, 7), 10
    h, w = a.shape[:2]
    tall = t["y2"] - t["y1"]
    lines = tall + 1
    th = tall if tall < h else h
    ph = kernels.bicubic_phases()
    ys = _trapezoid_lines(t, th, h, lines, 0)
    want = np.zeros((th, tw, 3), int)
    for j in range(th):
        cy, fr = ys[j] >> 16, (ys[j] & 0xFFFF) >> 10
        if 0 < cy < lines - 2 and cy + 2 < h:
            mid = np.clip((sum(a[cy - 1 + k] * ph[fr][k] for k in range(4)) + 8192) >> 6, 0, 65535)
        elif 0 < cy < lines - 2:
            mid = np.clip((sum(a[cy - 1 + k] * ph[fr][k] for k in range(4) if cy - 1 + k < h) + 8192) >> 6, 0, 65535)
        else:
            mid = a[cy] * 256
        t1 = t["x1s"] + j * ((t["x2s"] - t["x1s"]) / tall)
        t2 = t["x1e"] + j * ((t["x2e"] - t["x1e"]) / tall)
        inc, start = int(65536 * (w - 1) / (t2 - t1)), int(65536 * (w - 1) * -t1 / (t2 - t1))
        for i in range(tw):
            pos = start + i * inc
            cx, f = pos >> 16, (pos & 0xFFFF) >> 10
            if -1 <= cx <= w:
                for c in range(3):
                    v = sum((mid[cx + k - 1, c] if 0 <= cx + k - 1 < w else back[c] * 256) * ph[f][k] for k in range(4))
                    want[j, i, c] = min(255, max(0, int(v + 8192) >> 22))
            else:
                want[j, i] = back
    df = image(img)
    sql = {k: str(v) for k, v in t.items()}
    got = px.perspective_bicubic(df, stages.sizes_of(df), sql, ("0", "0"), str(tw), str(th), back, ph)
    fits(arrays_of(got.select("image_id", "w", "h", "x", "y", "b", "g", "r")), {0: want})


def test_pixel_hash_matches_zlib(image):
    import zlib

    img = random_images([(8, 8), (12, 8)]) | {2: np.zeros((8, 8, 3), int)}
    want = {}
    for i, a in img.items():
        h, w = a.shape[:2]
        f = w / h
        gw = 4 * ((int(f * math.sqrt(200 / f)) + 3) // 4)
        gh = 4 * ((int(gw / f) + 3) // 4)
        s = a[[(j * (h * 65536 // gh)) >> 16 for j in range(gh)]][:, [(k * (w * 65536 // gw)) >> 16 for k in range(gw)]]
        hist = np.stack([np.bincount(s[..., c].ravel(), minlength=256) for c in range(3)]).astype("<u4")
        mixed = hist.view(np.uint8).reshape(3, 1024).T.tobytes()
        line = s[gh // 4, :, 0].astype("<u2").tobytes()
        total = int(s.sum()) & 0xFFFFFFFF
        key = ((zlib.crc32(mixed + line) ^ 0xFFFFFFFF) << 32) + total
        want[i] = 0 if total == 0 else key - (1 << 64) if key >= 1 << 63 else key
    got = {r["image_id"]: r["hash"] for r in hashes.pixel_hash(image(img), 200).collect()}
    assert got == want


def test_stream_key_ignores_metadata():
    pixels = b"\xff\xda" + bytes(range(256)) * 3
    pixels = b"\x01" + pixels
    plain = b"\xff\xd8" + pixels
    with_meta = b"\xff\xd8\xff\xe1\x00\x06abcd" + pixels
    assert hashes.stream_key(plain) == hashes.stream_key(with_meta) != 0
    assert hashes.stream_key(b"no jpeg") == 0


def test_histogram_total_is_pixel_count_and_points(image):
    img = random_images([(9, 7)])
    hist = stats.hist_exact(image(img))
    assert hist.filter("channel = 'gray'").agg(F.sum("n")).first()[0] == 63
    points = {r["channel"]: r for r in stats.bw_points(hist, 0.0).collect()}
    assert points["b"]["black"] == 0.0 and points["b"]["white"] == 1.0
    gray = stats.gray_points(hist, 0.0).first()
    assert gray["black_pt"] == -1 / 255 and gray["white_pt"] == 256 / 255


def test_identity_tables(image, spark):
    table = luts.contrast_gamma(spark.createDataFrame([(0.0, 1.0)], "contrast double, gamma double")).first()["lut"]
    assert table == list(range(256))
    img = random_images([(4, 4)])
    df = image(img)
    neutral = stages.process(df, stages.Stages())
    assert neutral is df
    fits(arrays_of(luts.saturate(df, "1.0D")), img)


def test_alpha_and_gray_round_trip(image):
    df = image(random_images([(3, 3)]))
    opaque = px.alpha_blend(df.withColumn("a", F.lit(255)), (1, 2, 3))
    fits(arrays_of(opaque), arrays_of(df))
    clear = px.alpha_blend(df.withColumn("a", F.lit(0)), (1, 2, 3))
    assert clear.filter("b <> 1 OR g <> 2 OR r <> 3").count() == 0


def test_tiny_masks_are_not_smoothed(spark):
    rows = [(1, 2, 5, x, y, 10 * x + y) for x in range(2) for y in range(5)]
    df = spark.createDataFrame(rows, "image_id bigint, w int, h int, x int, y int, m int")
    assert sorted(map(tuple, luts.smooth3(df).select("x", "y", "m").collect())) == sorted((r[3], r[4], r[5]) for r in rows)


def test_saved_results_are_registered_once(spark, image, tmp_path):
    df = image(random_images([(8, 8)]))
    keys = hashes.pixel_hash(df, 64)
    store = spark.createDataFrame([], "hash bigint")
    rows = stages.save_processed(df, keys, store, str(tmp_path / "out"), {"gamma": 1.0})
    assert rows.count() == 1 and spark.read.parquet(str(tmp_path / "out")).count() == 64
    assert stages.register_saved(rows.select("hash"), keys, {"gamma": 1.0}).count() == 0
    again = stages.save_processed(df, keys, rows.select("hash"), str(tmp_path / "out"), {"gamma": 1.0})
    assert again.count() == 0 and spark.read.parquet(str(tmp_path / "out")).count() == 64
    other = image({7: random_images([(8, 8), (8, 8)])[1]})
    stages.save_processed(other, hashes.pixel_hash(other, 64), rows.select("hash"), str(tmp_path / "out"), {"gamma": 1.0})
    assert spark.read.parquet(str(tmp_path / "out")).count() == 128


def test_wide_filters_read_every_source_pixel():
    own = taps.ResizeTaps(6000, 160, "quality", 0.0).table()
    assert own["src"].nunique() == 6000
    assert taps.gauss_taps(12.0).size > 50  # weights above 0.002 reach about 28 pixels to each side

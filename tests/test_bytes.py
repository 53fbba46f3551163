"""Parsers of hand-built bytes, files and text lines."""

import struct

import pytest
from pyspark.sql import functions as F

from pixelquarry.functions import formats
from pixelquarry.sources import exif_bytes as eb
from pixelquarry.sources import files, param_store, playlist


def build(order="<", camera=True, gps=True, lon=True, thumb="jpeg", break_camera=False):
    """A small EXIF block with one directory of each kind."""
    data = bytearray((b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8))
    later = []

    def entry(code, kind, count, raw):
        return (code, kind, count, raw)

    def directory(entries, follow=0):
        at = len(data)
        data.extend(struct.pack(order + "H", len(entries)) + b"\0" * (12 * len(entries)) + struct.pack(order + "I", follow))
        for i, (code, kind, count, raw) in enumerate(entries):
            if callable(raw):
                raw = raw()
            if len(raw) > 4:
                off = len(data)
                data.extend(raw)
                raw = struct.pack(order + "I", off)
            struct.pack_into(order + "HHI", data, at + 2 + 12 * i, code, kind, count)
            data[at + 10 + 12 * i:at + 14 + 12 * i] = raw.ljust(4, b"\0")
        return at, at + 2 + 12 * len(entries)

    def u16(v):
        return struct.pack(order + "H", v)

    def u32(v):
        return struct.pack(order + "I", v)

    def frac(*pairs, code="I"):
        return b"".join(struct.pack(order + code * 2, *p) for p in pairs)

    main = [
        entry(0x112, 3, 1, u16(6)), entry(0x110, 2, 9, b"Model X1\0"), entry(0x10F, 2, 11, b"Maker Corp\0"),
        entry(0x10E, 2, 6, "déscr".encode()), entry(0x131, 2, 3, b"sw\0"), entry(0x132, 2, 20, b"2020:01:02 03:04:05\0"),
    ]
    if camera:
        main.append(entry(0x8769, 4, 1, u32(0)))
    if gps:
        main.append(entry(0x8825, 4, 1, u32(0)))
    _, end = directory(main)

    def patch(index, value):
        struct.pack_into(order + "I", data, 8 + 2 + 12 * index + 8, value)

    if camera:
        at, _ = directory([
            entry(0x9003, 2, 20, b"2019:05:06 07:08:09\0"), entry(0x829A, 5, 1, frac((10, 500))), entry(0x9204, 10, 1, frac((-2, 6), code="i")),
            entry(0x9209, 3, 1, u16(9)), entry(0x920A, 5, 1, frac((50, 1))), entry(0x829D, 5, 1, frac((28, 10))), entry(0x8827, 3, 1, u16(400)),
            entry(0x9286, 7, 16, b"ASCII\0\0\0hello ok"),
        ])
        patch(6, 60000 if break_camera else at)
    if gps:
        tags = [entry(1, 2, 2, b"S\0"), entry(2, 5, 3, frac((10, 1), (30, 1), (0, 1)))]
        if lon:
            tags += [entry(3, 2, 2, b"W\0"), entry(4, 5, 3, frac((20, 1), (0, 1), (36, 1)))]
        at, _ = directory([*tags, entry(5, 1, 1, b"\1"), entry(6, 5, 1, frac((1234, 10)))])
        patch(7 if camera else 6, at)
    if thumb:
        if thumb == "jpeg":
            stream = b"\xff\xd8\xff\xc0\x00\x11\x08" + struct.pack(">HH", 48, 64) + b"\0" * 8
            tags = [entry(0x103, 3, 1, u16(6)), entry(0x201, 4, 1, u32(0)), entry(0x202, 4, 1, u32(len(stream)))]
            at, _ = directory(tags)
            off = len(data)
            data.extend(stream)
            struct.pack_into(order + "I", data, at + 2 + 12 + 8, off)
        else:
            at, _ = directory([entry(0x103, 3, 1, u16(1)), entry(0x100, 3, 1, u16(80)), entry(0x101, 4, 1, u32(60))])
        struct.pack_into(order + "I", data, end, at)
    block = b"Exif\0\0" + bytes(data)
    return b"\xff\xe1" + struct.pack(">H", len(block) + 2) + block


@pytest.mark.parametrize("order", ["<", ">"])
def test_all_fields_in_both_byte_orders(order):
    out = eb.parse_app1(build(order))
    assert out["orientation"] == 6 and out["model"] == "Model X1" and out["make"] == "Maker Corp" and out["description"] == "déscr"
    assert out["software"] == "sw" and out["modified"] == "2020:01:02 03:04:05" and out["taken"] == "2019:05:06 07:08:09"
    assert (out["exposure_num"], out["exposure_den"]) == (1, 50) and out["exposure_bias"] == pytest.approx(-1 / 3)
    assert out["flash_present"] and out["flash"] == 9 and out["focal_length"] == 50 and out["f_number"] == 2.8 and out["iso"] == 400
    assert out["user_comment"] == "hello ok"
    assert (out["lat_ref"], out["lat_deg"], out["lat_min"], out["lat_sec"]) == ("S", 10, 30, 0)
    assert (out["lon_ref"], out["lon_deg"], out["lon_min"], out["lon_sec"]) == ("W", 20, 0, 36)
    assert out["altitude"] == -123.4 and (out["thumb_w"], out["thumb_h"]) == (64, 48)


def test_quirks_of_the_block():
    # position is read only with a camera pointer (kept)
    assert "lat_deg" not in eb.parse_app1(build(camera=False))
    # without longitude the altitude is not reached (kept)
    out = eb.parse_app1(build(lon=False))
    assert out["lat_deg"] == 10 and "altitude" not in out
    # the uncompressed thumbnail's width is found (fixed)
    assert eb.parse_app1(build(thumb="plain"))["thumb_w"] == 80
    # orientation is ignored for formats that turn themselves
    assert eb.parse_app1(build(), "HEIF")["orientation"] == 0
    # a broken pointer ends reading with what was found
    broken = eb.parse_app1(build(break_camera=True))
    assert broken["model"] == "Model X1" and broken["lat_deg"] == 10 and "taken" not in broken


def test_every_truncation_is_survived():
    block = build()
    for cut in range(len(block)):
        eb.parse_app1(block[:cut])
        eb.file_facts(b"\xff\xd8" + block[:cut])


def test_comments():
    def seg(body):
        return b"\xff\xd8\xff\xfe" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda\x00"

    assert eb.jpeg_comment(seg("naïve text".encode())) == "naïve text"
    assert eb.jpeg_comment(seg(b"\xff\xfe" + "wide".encode("utf-16-le"))) == "wide"
    assert eb.jpeg_comment(seg(b"\xfe\xff" + "wide".encode("utf-16-be"))) is None
    assert eb.jpeg_comment(seg(b"Intel(R) JPEG Library, version 1")) is None
    assert eb.jpeg_comment(seg(b"caf\xe9 and more text")) == "café and more text"
    assert eb.jpeg_comment(seg(b"\xe9abc")) is None
    assert eb.jpeg_comment(seg(b"\xe9\xe9\xe9\xe9\xe9\xe9abc")) is None
    assert eb.jpeg_comment(b"\xff\xd8\xff\xda\x00") is None


def test_extract_exif_reads_files(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8" + build())
    (tmp_path / "b.jpg").write_bytes(b"no picture")
    df = spark.read.format("binaryFile").load(str(tmp_path))
    rows = {r["path"][-5:]: r for r in eb.extract_exif(df, "path").collect()}
    assert rows["a.jpg"]["iso"] == 400 and rows["b.jpg"]["model"] is None and len(rows["b.jpg"]) == len(eb.FIELDS) + 1


def test_param_store_bytes():
    head = struct.pack("<5I20x", 0, 0, *param_store.MAGIC, 2)
    rec = struct.pack("<q9B6B4h3BbH3x", 77, *range(1, 10), *range(6), -1, 2, 3, 4, 10, 11, 12, -5, 36000)
    free = bytes(40)
    t = param_store.unpack(head + rec + free + rec)
    assert list(t["hash"]) == [77, 77] and list(t["seq"]) == [0, 2]
    r = t.iloc[0]
    assert (r["contrast"], r["flags"], r["zoom_left"], r["cyan_red"], r["saturation"], r["angle"]) == (1, 9, -1, 10, -5, 36000)
    assert len(param_store.unpack(b"\1" + head[1:] + rec)) == 0
    old = struct.pack("<5I12x", 0, 0, *param_store.MAGIC, 1) + struct.pack("<q9B6B4hB", 5, *range(9), *range(6), 1, 2, 3, 4, 99)
    r = param_store.unpack(old).iloc[0]
    assert (r["hash"], r["cyan_red"], r["magenta_green"], r["yellow_blue"], r["saturation"]) == (5, 128, 128, 128, 0)


def test_folder_scan_is_exact_on_endings(spark, tmp_path):
    for name in ("a.tif", "b.tiff", "c.TIF", "d.txt", "sub/e.jpg"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x" * 5)
    flat = files.scan_folder(spark, str(tmp_path), ["tif"])
    assert sorted(r["title"] for r in flat.collect()) == ["a.tif", "c.TIF"]
    tree = {r["title"]: r["depth"] for r in files.scan_tree(spark, str(tmp_path)).collect()}
    assert tree == {"a.tif": 0, "b.tiff": 0, "c.TIF": 0, "e.jpg": 1}
    assert "content" not in flat._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_image_files_become_pixels(spark, tmp_path):
    # a 3x2 24-bit BMP: bottom row first, rows padded to four bytes
    rows = [[(1, 2, 3), (4, 5, 6), (7, 8, 9)], [(10, 11, 12), (13, 14, 15), (16, 17, 18)]]
    body = b"".join(b"".join(bytes(p) for p in r) + b"\0" * 3 for r in reversed(rows))
    head = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 3, 2, 1, 24, 0, len(body), 0, 0, 0, 0)
    (tmp_path / "p.bmp").write_bytes(head + body)
    got = {(r["x"], r["y"]): (r["b"], r["g"], r["r"]) for r in files.read_pixels(spark, str(tmp_path)).collect()}
    assert got == {(x, y): rows[y][x] for y in range(2) for x in range(3)}


def test_text_encoding(spark):
    cases = [
        (b"\xff\xfe" + "some longer text".encode("utf-16-le"), "UTF-16LE"), (b"\xef\xbb\xbf" + b"some longer text", "UTF-8"),
        (b'<?xml encoding="utf-8"?> and so on', "UTF-8"), ("plain text in wide".encode("utf-16-le"), "UTF-16LE"), (b"just plain ansi text", "ANSI"), (b"\xff\xfeshort", "ANSI"),
    ]
    df = spark.createDataFrame([(i, bytearray(c)) for i, (c, _) in enumerate(cases)], "i int, content binary")
    got = {r["i"]: r["e"] for r in df.select("i", formats.text_encoding(F.col("content")).alias("e")).collect()}
    assert got == {i: e for i, (_, e) in enumerate(cases)}


def test_playlist_lines(spark, tmp_path):
    lines = [
        "C:\\a\\b.jpg", '"D:\\x y\\c.png" rest', '<img src="rel/d.gif">', "\\\\host\\share\\e.jpg\r", "nothing here", "see pic.png and pic.jpg<br>", "f.jpg",
    ]
    (tmp_path / "one.txt").write_text("\n".join(lines), newline="")
    (tmp_path / "bad.txt").write_text("C:\\ok.jpg\n" + "y" * 512 + "\nC:\\no.jpg")
    rows = playlist.read_lines(spark, str(tmp_path))
    got = [r["name"] for r in playlist.playlist_entries(rows, "C:\\base").orderBy("line_no").collect()]
    assert got == ["C:\\a\\b.jpg", "D:\\x y\\c.png", "C:\\base\\rel/d.gif", "\\\\host\\share\\e.jpg", "C:\\base\\see pic.png and pic.jpg", "C:\\base\\f.jpg"]
    # a long line past the byte limit is never read, so its list is accepted
    long = spark.createDataFrame([("l", i, "C:\\" + "z" * 200 + ".jpg" if i < 6 else "y" * 600) for i in range(1, 8)], "list_id string, line_no bigint, line string")
    assert playlist.playlist_entries(long, "C:\\b", kilobytes=1).count() == 5

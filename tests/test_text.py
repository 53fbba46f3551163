"""Names, patterns, settings and translations: one test per kept or fixed quirk."""

import fnmatch

import pytest
from pyspark.sql import functions as F

from pixelquarry.functions import formats, metadata, text
from pixelquarry.operators import catalog as cat
from pixelquarry.operators import params as par
from pixelquarry.operators import strings as st
from pixelquarry.sources import settings as cfg


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_glob_is_open_at_the_end_and_skips_empty_parts(spark):
    pats = text.split_patterns("*.tif;;/A/*/c")
    assert one(spark, text.first_match(F.col("p"), pats), p="/x/y.TIFF") == "*.tif"
    assert one(spark, text.first_match(F.col("p"), pats), p="/a/b/cde") == "/A/*/c"
    assert one(spark, text.first_match(F.col("p"), pats), p="/q") is None
    rows = spark.createDataFrame([("abcabd",), ("xabd",), ("ab",), ("a.b",)], "p string")
    for pattern in ("ab*d", "*b", "a.b", "**d", "a*b*c"):
        got = [r[0] for r in rows.select(F.col("p").rlike(text.glob_regex(pattern))).collect()]
        assert got == [fnmatch.fnmatchcase(r[0], pattern + "*") for r in rows.collect()]


@pytest.mark.parametrize("p1,p2,want", [("/a/b*", "/a/*", 1), ("/a/*", "/A/b", -1), ("/a", "/a/b", -1), ("/a", "/A", 0), (None, "x", -1), ("x", None, 1), (None, None, 0), ("/a/x", "/a/y", 0)])
def test_specificity(spark, p1, p2, want):
    df = spark.createDataFrame([(p1, p2)], "p1 string, p2 string")
    assert df.select(text.more_specific("p1", "p2")).first()[0] == want


def test_natural_order(spark):
    names = ["File10.jpg", "file9.jpg", "File009b.jpg", "a.jpg", "File1.jpg", "File" + "9" * 30 + ".jpg"]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    got = [r[0] for r in df.orderBy(text.natural_key(F.col("t")), "t").collect()]
    assert got == ["a.jpg", "File1.jpg", "file9.jpg", "File009b.jpg", "File10.jpg", "File" + "9" * 30 + ".jpg"]


def test_rename_quirks(spark):
    df = spark.createDataFrame([(7, "img_12a.x.jpg"), (7, "noext"), (12345, "n9")], "number int, title string").withColumn("mtime", F.expr("timestamp'2021-03-04 05:06:07'"))

    def run(pattern, **kw):
        return [r[0] for r in df.select(text.rename_text(pattern, **kw)).collect()]

    assert run("%3x-%F.%e") == ["007-img_12a.x.jpg", "007-noext.%e", "12345-n9.%e"]
    # a number at the very end of the name is not found (kept)
    assert run("%n") == ["12", "", ""]
    # only the first % with a digit is looked at, so %2y before %3x leaves %3x alone (kept)
    assert run("%2y_%3x")[0] == "21_%3x"
    assert run("%y%m%d %h%min %M %3M")[0] == "20210304 0506 March Mar"
    assert run("%h", time_zone="Asia/Tokyo")[0] == "14"
    assert run("%pictures%/%x", pictures="/home/p")[0] == "/home/p/7"


def test_copy_needed(spark):
    cases = [("new.jpg", "/a/b", False), ("/A/B/new.jpg", "/a/b", False), ("/a/c/new.jpg", "/a/b", True), ("/a/new.jpg", "/a/b", False), ("/a/b/c/new.jpg", "/a/b", True)]
    df = spark.createDataFrame(cases, "n string, d string, w boolean")
    assert df.select((text.copy_needed("n", "d") == F.col("w")).alias("ok")).filter("NOT ok").count() == 0


def test_path_text_quotes_unless_next_to_a_separator(spark):
    df = spark.createDataFrame([("/a b/c.jpg",), ("plain.jpg",)], "path string")
    got = [r[0] for r in df.select(text.path_text("%filename% %filetitle% %directory%/x")).collect()]
    assert got == ['"/a b/c.jpg" "c.jpg" /a b/x', '"plain.jpg" "plain.jpg" ./x']
    assert [r[0] for r in df.select(text.path_text("%directory%")).collect()] == ['"/a b"', '"."']


def test_endings_and_formats(spark):
    assert len(formats.supported_endings(";".join(f"*.q{i}" for i in range(60)), most=48)) == 48
    assert "nef" in formats.supported_endings(";".join(f"*.q{i}" for i in range(60)))
    assert formats.parse_endings("*.a;x;*.bcd;") == ["a", "bcd"]
    df = spark.createDataFrame([("gif",), ("HIF",), ("psb",), ("NEF",), ("wdp",), ("",)], "e string")
    assert [r[0] for r in df.select(formats.format_of_ending(F.col("e"), "*.wdp")).collect()] == ["UNKNOWN", "HEIF", "UNKNOWN", "RAW", "CODEC", "UNKNOWN"]


def test_magic_wins_over_ending_but_not_for_tiff(spark):
    rows = [(b"\xff\xd8\xff", "png", "JPEG"), (b"II*\0abcd", "nef", "RAW"), (b"II*\0abcd", "zzz", "TIFF"), (b"\0\0\0\x18ftyp1pic", "zzz", "AVIF"), (b"\0\0\0\x18ftyp1pic", "heic", "HEIF"), (b"B", "bmp", "UNKNOWN"), (b"RIFF", "tga", "TGA")]
    df = spark.createDataFrame([(bytearray(c), e, w) for c, e, w in rows], "c binary, e string, w string")
    assert df.select(formats.format_of_content(F.col("c"), F.col("e")).alias("f"), "w").filter("f <> w").count() == 0


def test_dates(spark):
    cases = [("2020:1:2 3:4:5", "2020-01-02 03:04:05"), ("0000:00:00 00:00:00", None), ("1600:01:01 00:00:00", None), ("2020:13:01 00:00:00", None), ("2020:01:01", None), (None, None)]
    df = spark.createDataFrame(cases, "d string, w string")
    assert [r[0] for r in df.select(F.date_format(metadata.photo_date("d"), "yyyy-MM-dd HH:mm:ss")).collect()] == [w for _, w in cases]


def test_settings(spark):
    lines = [("p", "global", 1, "A=1"), ("p", "user", 1, "A = 2"), ("p", "user", 2, "A\t7"), ("p", "user", 3, "  "), ("p", "default", 1, "A=0"), ("p", "user", 4, "B=")]
    df = spark.createDataFrame(lines, "profile string, layer string, line_no int, raw_line string")
    rows = {r["key"]: r for r in cfg.layered(cfg.parse_lines(df)).collect()}
    # the last line of a key wins, the user layer wins, both layers are read (fixed)
    assert rows["A"]["set_value"] == "7" and rows["A"]["default_value"] == "0" and rows["B"]["set_value"] == ""
    typed = spark.createDataFrame([("3.9",), ("-5",), ("99",), ("",), (None,), ("junk",)], "set_value string")
    assert [r[0] for r in typed.select(cfg.as_int(2, 1, 16)).collect()] == [3, 1, 16, 2, 2, 1]
    flags = spark.createDataFrame([("TRUE",), ("False",), ("maybe",), (None,)], "set_value string")
    assert [r[0] for r in flags.select(cfg.as_bool(True)).collect()] == [True, False, True, True]


def test_preset_order(spark):
    df = spark.createDataFrame([(1.0,) * 12 + ("0.5 -1 3 -1 -1 -1 -1 -1 -1 -1 -1 9",)], ", ".join(f"{n} double" for n in par.PRESET_ORDER) + ", p string")
    r = par.apply_preset(df, "p").first()
    assert (r["contrast"], r["gamma"], r["sharpen"], r["saturation"]) == (0.5, 1.0, 3.0, 9.0)


def test_rules_tie_includes(spark):
    df = spark.createDataFrame([("/a/b/x",), ("/a/c",), ("/z",)], "path string")
    out = par.resolve_rules(df, {"f": (["/a/b*"], ["/a/*"]), "g": (["/a/"], ["/A/"])}).collect()
    assert [(r["f"], r["g"]) for r in out] == [(True, True), (False, True), (None, None)]


def test_translation_files(spark):
    lines = ["// UTF-8", "//: Language: Test: x", "Open\tAuf ", "//Old\t Alt ", "Open\tAgain", "Close", "", "//Old\tOther"]
    df = spark.createDataFrame([("xx", i, l) for i, l in enumerate(lines)], "lang string, line_no int, line string")
    t = st.parse_catalog(df)
    assert {r["key"]: r["value"] for r in t["strings"].collect()} == {"Open": "Auf", "Old": "Alt", "Close": ""}
    assert {r["key"] for r in t["errors"].collect()} == {"Open", "Old"}
    assert [(r["k"], r["v"]) for r in t["info"].collect()] == [("Language", "Test: x")]
    assert [r["line"] for r in t["comments"].collect()] == ["// UTF-8"]


def test_shapes_without_translation(spark):
    keep, drop = ["Open file", "ok!"], ["", " ", ".jpg", "*.tiff", "--", "1.5", "<b>", "%x%", "{a}", "/run", "a1"]
    df = spark.createDataFrame([(x,) for x in keep + drop], "t string")
    assert sorted(r[0] for r in df.filter(~st.needs_no_translation(F.col("t"))).collect()) == sorted(keep)


def test_sort_refuses_unknown_keys(spark):
    with pytest.raises(ValueError):
        cat.sort_key("colour")


def test_size_guard_and_quarantine(spark, tmp_path):
    mib = 1 << 20
    rows = [("a", "JPEG", 301 * mib, 10, 10), ("b", "PSD", 301 * mib, 10, 10), ("c", "PNG", 5, 70000, 1), ("d", "TGA", 900 * mib, 1, 1)]
    df = spark.createDataFrame(rows, "path string, format string, size bigint, width int, height int")
    guarded = cat.size_guard(df)
    assert {r["path"]: r["status"] for r in guarded.collect()} == {"a": "too many bytes", "b": "ok", "c": "side too long", "d": "ok"}
    assert sorted(r["path"] for r in cat.quarantine(guarded, str(tmp_path / "q")).collect()) == ["b", "d"]
    assert sorted(r["path"] for r in spark.read.parquet(str(tmp_path / "q")).collect()) == ["a", "c"]

"""Image formats by file extension and by leading bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: file endings that count as pictures, in search order
BUILT_IN_ENDINGS = [
    "jpg", "jpeg", "jfif", "bmp", "png", "tif", "tiff", "gif", "webp", "jxl", "avif", "heif", "heic", "tga", "qoi", "psd", "psb",
]
RAW_ENDINGS = "*.pef;*.dng;*.crw;*.nef;*.cr2;*.mrw;*.rw2;*.orf;*.x3f;*.arw;*.kdc;*.nrw;*.dcr;*.sr2;*.raf"
# fixed values: format by ending; gif and psb are listed above but have no entry, hif is the reverse (kept behaviour)
FORMAT_OF_ENDING = {
    "jpg": "JPEG", "jpeg": "JPEG", "jfif": "JPEG", "bmp": "BMP", "png": "PNG", "tif": "TIFF", "tiff": "TIFF", "webp": "WEBP",
    "jxl": "JXL", "avif": "AVIF", "heif": "HEIF", "heic": "HEIF", "hif": "HEIF", "tga": "TGA", "qoi": "QOI", "psd": "PSD",
}


def parse_endings(text: str) -> list[str]:
    """Endings of a ``*.a;*.b`` list; entries of up to two characters are ignored."""
    return [part[2:] for part in text.split(";") if len(part) > 2]


def supported_endings(codec_list: str = "", raw_list: str = RAW_ENDINGS, most: int | None = None) -> list[str]:
    """Built-in endings, those of installed codecs and raw formats; ``most`` keeps only the first so many."""
    extra = parse_endings(codec_list) if len(codec_list) > 2 else []
    return (BUILT_IN_ENDINGS + extra + parse_endings(raw_list))[:most]


def _in(column: Column, values: list[str]) -> Column:
    return column.isin(*values) if values else F.lit(False)


def format_of_ending(ending: Column, codec_list: str = "", raw_list: str = RAW_ENDINGS) -> Column:
    e = F.lower(ending)
    result = F.when(_in(e, []), F.lit(None))
    for name in dict.fromkeys(FORMAT_OF_ENDING.values()):
        result = result.when(_in(e, [k for k, v in FORMAT_OF_ENDING.items() if v == name]), F.lit(name))
    result = result.when(_in(e, [x.lower() for x in parse_endings(codec_list)]), F.lit("CODEC"))
    return result.when(_in(e, [x.lower() for x in parse_endings(raw_list)]), F.lit("RAW")).otherwise(F.lit("UNKNOWN"))


# fixed values: leading bytes as patterns over the hex text of the first 16 bytes, first match wins
SIGNATURES = [
    ("BMP", "^424D"), ("JPEG", "^FFD8"), ("PNG", "^89504E470D0A1A0A"), ("GIF", "^47494638(37|39)61"),
    ("WEBP", "^52494646.{8}57454250"), ("JXL", "^FF0A"), ("JXL", "^0000000C4A584C200D0A870A"),
    ("AVIF", "^.{8}66747970617669"), ("HEIF", "^.{8}667479706865(69|76)"), ("RAW", "^.{8}6674797063727820"),
    ("QOI", "^716F6966"), ("PSD", "^38425053"),
]
# tested only when the ending says nothing: raw files use TIFF containers
LATE_SIGNATURES = [("AVIF", "^.{8}66747970"), ("TIFF", "^(49492A00|4D4D002A)")]


def format_of_content(content: Column, ending: Column) -> Column:
    """Format by signature, else by ending, else by the late signatures."""
    head = F.hex(F.substring(content, 1, 16))
    known = F.when(F.length(head) < 4, F.lit("UNKNOWN"))
    for name, pattern in SIGNATURES:
        known = known.when(head.rlike(pattern), F.lit(name))
    by_ending = format_of_ending(ending)
    late = F.when(by_ending != "UNKNOWN", by_ending)
    for name, pattern in LATE_SIGNATURES:
        late = late.when(head.rlike(pattern), F.lit(name))
    return known.otherwise(late.otherwise(F.lit("UNKNOWN")))


def text_encoding(content: Column) -> Column:
    """``UTF-16LE``, ``UTF-8`` or ``ANSI`` from the first 64 bytes of a text file."""
    head = F.substring(content, 1, 64)
    hexed = F.hex(head)
    n = F.length(head)
    fits = F.aggregate(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
        F.lit(0),
        lambda acc, i: acc + F.when((F.substring(hexed, i * 2 + 1, F.lit(2)) == "00") == (i % 2 == 1), 1).otherwise(0),
    )
    xml_utf8 = hexed.contains("encoding=\"utf-8\"".encode().hex().upper())
    return (
        F.when((n >= 16) & hexed.startswith("EFBBBF"), "UTF-8")
        .when(xml_utf8, "UTF-8")
        .when(n < 16, "ANSI")
        .when(hexed.startswith("FFFE"), "UTF-16LE")
        .when(fits > F.floor(n * 2 / 3), "UTF-16LE")
        .otherwise("ANSI")
    )

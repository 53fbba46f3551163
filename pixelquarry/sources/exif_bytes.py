"""EXIF blocks and comments out of JPEG bytes.

The parser is a small helper that works on one file's bytes; the job around
it reads many files in parallel and turns them into one ``exif`` table.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from math import gcd

import pandas as pd
from pyspark.sql import DataFrame

from pixelquarry.operators.hashes import find_segment

EXIF_SCHEMA = (
    "orientation int, make string, model string, description string, software string, modified string, taken string, "
    "exposure_num bigint, exposure_den bigint, exposure_bias double, flash_present boolean, flash int, focal_length double, "
    "f_number double, iso bigint, user_comment string, lat_ref string, lat_deg double, lat_min double, lat_sec double, "
    "lon_ref string, lon_deg double, lon_min double, lon_sec double, altitude double, thumb_w int, thumb_h int, jpeg_comment string"
)
FIELDS = [part.split()[0] for part in EXIF_SCHEMA.split(", ")]
# fixed values: formats whose orientation tag must be ignored
NO_ORIENTATION = {"JXL", "HEIF", "AVIF"}
ENCODER_BANNER = "Intel(R) JPEG Library"


class _Tiff:
    """Bounds-checked reads from a TIFF block; a read outside it raises ``struct.error``."""

    def __init__(self, data: bytes):
        self.data = data
        order = {b"II": "<", b"MM": ">"}.get(data[:2])
        if order is None:
            raise struct.error("no byte order")
        self.order = order

    def get(self, code: str, at: int) -> int:
        if at < 0:
            raise struct.error("offset before block")
        return struct.unpack_from(self.order + code, self.data, at)[0]

    def directory(self, at: int) -> tuple[dict[int, int], int]:
        """Tags of a directory (first wins) as tag -> entry offset, and where the directory ends."""
        count = self.get("H", at)
        end = at + 2 + count * 12
        if end > len(self.data):
            raise struct.error("directory past block")
        tags: dict[int, int] = {}
        for entry in range(at + 2, end, 12):
            tags.setdefault(self.get("H", entry), entry)
        return tags, end

    def short(self, entry: int | None) -> int:
        return self.get("H", entry + 8) if entry is not None and self.get("H", entry + 2) == 3 else 0

    def long(self, entry: int | None) -> int:
        return self.get("I", entry + 8) if entry is not None and self.get("H", entry + 2) == 4 else 0

    def number(self, entry: int | None) -> int:
        return self.short(entry) or self.long(entry)

    def raw_text(self, entry: int | None, limit: int | None = None) -> bytes:
        if entry is None or self.get("H", entry + 2) != 2:
            return b""
        size = self.get("I", entry + 4)
        if limit is not None and size > limit:
            return b""
        start = entry + 8 if size <= 4 else self.get("I", entry + 8)
        if start > len(self.data):
            raise struct.error("text past block")
        return self.data[start:start + size].split(b"\0")[0]

    def text(self, entry: int | None, limit: int | None = None) -> str | None:
        return self.raw_text(entry, limit).decode("cp1252", "replace") or None

    def fraction(self, entry: int | None, index: int = 0) -> tuple[int, int] | None:
        """Reduced numerator and denominator; signs only for the signed type."""
        if entry is None or self.get("H", entry + 2) not in (5, 10) or index >= (self.get("I", entry + 4) & 0xFFFF):
            return None
        code = "i" if self.get("H", entry + 2) == 10 else "I"
        at = self.get("I", entry + 8) + index * 8
        num, den = self.get(code, at), self.get(code, at + 4)
        if num and den:
            g = gcd(abs(num), abs(den))
            num, den = (abs(num) // g) * (1 if num > 0 else -1), (abs(den) // g) * (1 if den > 0 else -1)
        return num, den

    def value(self, entry: int | None, index: int = 0) -> float | None:
        f = self.fraction(entry, index)
        return f[0] / f[1] if f and f[1] else None

    def comment(self, entry: int | None) -> str | None:
        if entry is None or self.get("H", entry + 2) != 7:
            return None
        size = self.get("I", entry + 4)
        if size <= 8:  # the name of the encoding alone
            return None
        start = self.get("I", entry + 8)
        body = self.data[start:start + size]
        if body.startswith(b"ASCII\0"):
            return body[8:].split(b"\0")[0].decode("cp1252", "replace") or None
        if body.startswith(b"UNICODE\0"):
            body, order = body[8:], self.order
            if body[:2] in (b"\xff\xfe", b"\xfe\xff"):
                order, body = ("<" if body[0] == 0xFF else ">"), body[2:]
            return body[: len(body) // 2 * 2].decode("utf-16-le" if order == "<" else "utf-16-be", "replace").split("\0")[0] or None
        return None


def _main_block(t: _Tiff, out: dict, image_format: str) -> tuple[dict[int, int], int]:
    tags, end = t.directory(t.get("I", 4))
    after = t.get("I", end)
    if image_format not in NO_ORIENTATION and 0x112 in tags:
        out["orientation"] = t.short(tags[0x112])
    out["model"], out["make"] = t.text(tags.get(0x110)), t.text(tags.get(0x10F))
    raw = t.raw_text(tags.get(0x10E))
    try:
        out["description"] = raw.decode("utf-8") or None
    except UnicodeDecodeError:
        out["description"] = raw.decode("cp1252", "replace")
    out["software"], out["modified"] = t.text(tags.get(0x131)), t.text(tags.get(0x132))
    return tags, after


def _position(t: _Tiff, out: dict, at: int) -> None:
    tags, _ = t.directory(at)
    for name, ref, entry in (("lat", 1, 2), ("lon", 3, 4)):
        if ref not in tags:
            return
        out[f"{name}_ref"] = t.text(tags[ref], 2)
        parts = [t.value(tags.get(entry), i) for i in range(3)]
        if None not in parts:
            out[f"{name}_deg"], out[f"{name}_min"], out[f"{name}_sec"] = parts
    if 6 in tags:
        height = t.value(tags[6])
        if height is not None and 5 in tags and t.get("B", tags[5] + 8) == 1:
            height = -height
        out["altitude"] = height


def _camera_block(t: _Tiff, out: dict, at: int) -> None:
    tags, _ = t.directory(at)
    out["taken"] = t.text(tags.get(0x9003))
    exposure = t.fraction(tags.get(0x829A))
    if exposure:
        out["exposure_num"], out["exposure_den"] = exposure
    out["exposure_bias"] = t.value(tags.get(0x9204))
    out["flash_present"], out["flash"] = 0x9209 in tags, t.short(tags.get(0x9209))
    out["focal_length"], out["f_number"] = t.value(tags.get(0x920A)), t.value(tags.get(0x829D))
    out["iso"] = t.short(tags[0x8827]) if 0x8827 in tags else t.long(tags.get(0x8833))
    comment = t.comment(tags.get(0x9286))
    out["user_comment"] = None if comment == "User comments" else comment


def _thumbnail(t: _Tiff, out: dict, at: int) -> None:
    tags, _ = t.directory(at)
    if 0x103 not in tags:
        return
    if t.short(tags[0x103]) != 6:
        # width is tag 0x0100 (looked up as 0x0001 in the original, fixed here)
        if 0x100 in tags and 0x101 in tags:
            out["thumb_w"], out["thumb_h"] = t.number(tags[0x100]), t.number(tags[0x101])
        return
    if 0x201 in tags and 0x202 in tags:
        start = t.long(tags[0x201])
        stream = t.data[start:start + t.long(tags[0x202])]
        frame = find_segment(stream, 0xC0)
        if frame is not None and frame + 9 <= len(stream):
            out["thumb_h"], out["thumb_w"] = struct.unpack_from(">HH", stream, frame + 5)


def parse_app1(block: bytes, image_format: str = "JPEG") -> dict:
    """Fields of an APP1 block; reading ends at the first broken offset with what was found so far."""
    out: dict = {"thumb_w": -1, "thumb_h": -1, "flash_present": False, "orientation": 0, "iso": 0}
    if block[:2] != b"\xff\xe1" or len(block) < 18:
        return out
    size = int.from_bytes(block[2:4], "big") + 2
    try:
        t = _Tiff(block[10:size])
        tags, after = _main_block(t, out, image_format)
        # position and exposure are read only with a camera block pointer (kept behaviour)
        if 0x8769 not in tags:
            return out
        if 0x8825 in tags and t.long(tags[0x8825]):
            try:
                _position(t, out, t.long(tags[0x8825]))
            except struct.error:
                pass
        camera = t.long(tags[0x8769])
        if camera == 0:
            return out
        _camera_block(t, out, camera)
        if after:
            _thumbnail(t, out, after)
    except struct.error:
        pass
    return out


def jpeg_comment(data: bytes) -> str | None:
    """Text of the comment segment, if it reads as text."""
    at = find_segment(data, 0xFE)
    if at is None or at + 4 > len(data):
        return None
    body = data[at + 4:at + 2 + int.from_bytes(data[at + 2:at + 4], "big")]
    if len(body) > 2 and len(body) % 2 == 0 and body[:2] == b"\xff\xfe":
        return body[2:].decode("utf-16-le", "replace") or None
    if len(body) > 2 and len(body) % 2 == 0 and body[:2] == b"\xfe\xff":
        return None
    try:
        text = body.decode("utf-8")
    except UnicodeDecodeError:
        plain = sum(chr(c).isascii() and (chr(c).isalnum() or chr(c) in " ,.") for c in body)
        if len(body) < 7 or plain <= len(body) * 8 // 10:
            return None
        text = body.decode("cp1252", "replace")
    return None if ENCODER_BANNER in text else text or None


def file_facts(data: bytes, image_format: str = "JPEG") -> dict:
    at = find_segment(data, 0xE1)
    facts = parse_app1(data[at:], image_format) if at is not None and data[at + 4:at + 8] == b"Exif" else {}
    facts["jpeg_comment"] = jpeg_comment(data)
    return facts


def extract_exif(files: DataFrame, key: str) -> DataFrame:
    """One ``exif`` row per file with a ``content`` column (and an optional ``format``)."""
    kind = dict(files.dtypes)[key]
    with_format = "format" in files.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            formats = batch["format"] if with_format else ["JPEG"] * len(batch)
            rows = [file_facts(bytes(c), f) for c, f in zip(batch["content"], formats)]
            table = pd.DataFrame({name: pd.Series([r.get(name) for r in rows], dtype=object) for name in FIELDS})
            table.insert(0, key, batch[key].to_numpy())
            yield table

    columns = [key, "content", "format"] if with_format else [key, "content"]
    return files.select(*columns).mapInPandas(run, f"`{key}` {kind}, {EXIF_SCHEMA}")

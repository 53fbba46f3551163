"""Byte coding of processing parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: stored range of each byte-coded parameter
RANGES = {
    "contrast": (-0.5, 0.5), "gamma": (0.5, 2.0), "sharpen": (0.0, 0.5), "lighten_shadows": (0.0, 1.0), "darken_highlights": (0.0, 1.0),
    "lighten_steepness": (0.0, 1.0), "color_correction": (-0.5, 0.5), "contrast_correction": (0.0, 1.0), "cyan_red": (-1.0, 1.0),
    "magenta_green": (-1.0, 1.0), "yellow_blue": (-1.0, 1.0),
}
# fixed values: bit of each stored flag; bits 3 and 4 hold quarter turns
FLAG_BITS = {"auto_contrast": 1, "density": 2, "high_quality": 4, "screen_relative": 32, "auto_crop": 64, "keep_ratio": 128}


def to_byte(value: str, low: float, high: float) -> str:
    return f"cast(0.5D + 255.0D * (greatest({low!r}D, least({high!r}D, {value})) - ({low!r}D)) / {high - low!r}D AS int)"


def from_byte(code: str, low: float, high: float) -> str:
    return f"({code} * {high - low!r}D / 255.0D + ({low!r}D))"


def saturation_to_code(value: str) -> str:
    """Signed byte around neutral 1.0, at most 127."""
    v = f"(128.0D * greatest(-1.0D, least(1.0D, {value} - 1.0D)))"
    return f"least(127, cast(CASE WHEN {v} < 0 THEN {v} - 0.5D ELSE {v} + 0.5D END AS int))"


def saturation_from_code(code: str) -> str:
    return f"({code} / 128.0D + 1.0D)"


def angle_to_code(angle: str) -> str:
    """Hundredths of a degree in 0..36000."""
    return f"cast(pmod({angle} + 360.0D, 360.0D) * 100.0D + 0.5D AS int)"


def angle_from_code(code: str) -> str:
    """Degrees; codes past a half turn decode to negative angles."""
    return f"CASE WHEN {code} > 18000 THEN {code} * 0.01D - 360.0D ELSE {code} * 0.01D END"


def pack_flags(columns: dict[str, str], rotation: str) -> Column:
    """Flag byte from boolean columns (flag name to SQL) and a quarter-turn angle."""
    bits = [f"IF({sql}, {FLAG_BITS[name]}, 0)" for name, sql in columns.items()]
    return F.expr(" | ".join([*bits, f"CASE {rotation} WHEN 90 THEN 8 WHEN 180 THEN 16 WHEN 270 THEN 24 ELSE 0 END"]))


def unpack_flags(code: str) -> dict[str, Column]:
    out = {name: F.expr(f"({code} & {bit}) <> 0") for name, bit in FLAG_BITS.items()}
    out["rotation"] = F.expr(f"shiftright({code} & 24, 3) * 90")
    return out

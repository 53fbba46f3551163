"""Integer pixel arithmetic as SQL expressions."""

from __future__ import annotations

GRAY = "shiftright(b * 128 + g * 640 + r * 256, 10)"


def clamp(expr: str, low: object = 0, high: object = 255) -> str:
    return f"greatest({low}, least({high}, {expr}))"


def trunc_int(expr: str) -> str:
    """C-style cast of a double: towards zero."""
    return f"cast({expr} AS int)"


def round_half_away(expr: str) -> str:
    """Round to the nearest integer, halves away from zero."""
    return f"cast(CASE WHEN {expr} < 0 THEN ({expr}) - 0.5D ELSE ({expr}) + 0.5D END AS int)"

"""Layered ``key=value`` settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LINE = r"^\s*([^\s=]+)[\s=]?\s*(.*)$"


def parse_lines(lines: DataFrame) -> DataFrame:
    """``profile, layer, key, value`` from raw lines; the last line of a key wins.

    A key ends at a blank or an equals sign. Lines without a key are dropped.
    """
    value = F.regexp_replace(F.regexp_extract("raw_line", _LINE, 2), r"^=\s*", "")
    parsed = lines.withColumn("key", F.regexp_extract("raw_line", _LINE, 1)).withColumn("value", value)
    return (
        parsed.filter("key <> ''").groupBy("profile", "layer", "key").agg(F.max_by("value", "line_no").alias("value"))
    )


def layered(parsed: DataFrame) -> DataFrame:
    """One value per profile and key: user over global over default. Both files are read."""
    rank = F.expr("CASE layer WHEN 'user' THEN 3 WHEN 'global' THEN 2 ELSE 1 END")
    return parsed.groupBy("profile", "key").agg(
        F.max_by("value", F.when(F.col("layer") != "default", rank)).alias("set_value"),
        F.max(F.when(F.col("layer") == "default", F.col("value"))).alias("default_value"),
    )


def _number(text: str) -> str:
    """Leading number of a text as C reads it; no number is zero."""
    return f"coalesce(try_cast(regexp_extract({text}, '^\\\\s*([+-]?[0-9]+\\\\.?[0-9]*([eE][+-]?[0-9]+)?)', 1) AS double), 0.0D)"


def as_double(default: float, low: float, high: float, text: str = "set_value") -> Column:
    return F.expr(f"CASE WHEN {text} IS NULL OR {text} = '' THEN {default!r}D ELSE greatest({low!r}D, least({high!r}D, {_number(text)})) END")


def as_int(default: int, low: int, high: int, text: str = "set_value") -> Column:
    return F.expr(f"CASE WHEN {text} IS NULL OR {text} = '' THEN {default} ELSE greatest({low}, least({high}, cast({_number(text)} AS int))) END")


def as_bool(default: bool, text: str = "set_value") -> Column:
    """True or false in any case; anything else is the default."""
    return F.expr(f"CASE lower({text}) WHEN 'true' THEN true WHEN 'false' THEN false ELSE {str(default).lower()} END")


def as_text(text: str = "set_value", default: str = "default_value") -> Column:
    return F.expr(f"coalesce({text}, {default})")


def _integers(text: str, count: int) -> str:
    """SQL of the first ``count`` integers of a text as an array, NULL if it doesn't begin with so many."""
    each = r"([+-]?\\d+)"
    pattern = r"^\\s*" + r"(?:\\s+|(?=[+-]))".join([each] * count)
    numbers = ", ".join(f"try_cast(regexp_extract({text}, '{pattern}', {i}) AS int)" for i in range(1, count + 1))
    return f"IF(exists(array({numbers}), v -> v IS NULL), NULL, array({numbers}))"


def as_rect(default: tuple[int, int, int, int], text: str = "set_value") -> Column:
    """``left top right bottom`` with the corners in order; anything else is the default."""
    found = f"coalesce({_integers(text, 4)}, array({', '.join(map(str, default))}))"
    return F.expr(f"transform(array({found}), r -> named_struct('left', least(r[0], r[2]), 'top', least(r[1], r[3]), 'right', greatest(r[0], r[2]), 'bottom', greatest(r[1], r[3])))[0]")


def as_size(default: tuple[int, int], text: str = "set_value") -> Column:
    """``width height``, one pixel each at least; anything else is the default."""
    found = f"coalesce(transform({_integers(text, 2)}, v -> greatest(1, v)), array({', '.join(map(str, default))}))"
    return F.expr(f"transform(array({found}), r -> named_struct('width', r[0], 'height', r[1]))[0]")


def as_color(default: tuple[int, int, int], text: str = "set_value") -> Column:
    """``red green blue``, the low byte of each; anything else is the default."""
    found = f"coalesce(transform({_integers(text, 3)}, v -> v & 255), array({', '.join(map(str, default))}))"
    return F.expr(f"transform(array({found}), r -> named_struct('red', r[0], 'green', r[1], 'blue', r[2]))[0]")

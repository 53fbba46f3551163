"""Keys that stand for rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_key(*columns) -> Column:
    """128 bits that stand for a row."""
    return F.concat(F.hex(F.xxhash64(*columns)), F.lit("-"), F.hex(F.xxhash64(F.lit("other"), *reversed(columns))))

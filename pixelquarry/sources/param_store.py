"""Binary parameter stores: fixed records behind a header of the same size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the two magic numbers, and the version of a store file
MAGIC = (0xE8D2862A, 0xB651E752)
VERSION = 2
RECORD, OLD_RECORD = 40, 32
NEUTRAL_COLOUR = 128

_BYTES = [
    "contrast", "gamma", "sharpen", "lighten_shadows", "darken_highlights", "lighten_steepness", "color_correction",
    "contrast_correction", "flags", "red", "green", "blue", "cyan", "magenta", "yellow",
]
_LAYOUT = [("hash", "<i8"), *[(n, "u1") for n in _BYTES], *[(f"zoom_{n}", "<i2") for n in ("left", "top", "right", "bottom")], ("cyan_red", "u1")]
_NEW = [("magenta_green", "u1"), ("yellow_blue", "u1"), ("saturation", "i1"), ("angle", "<u2"), ("reserved", "V3")]
V2, V1 = np.dtype([*_LAYOUT, *_NEW]), np.dtype(_LAYOUT)
FIELDS = [n for n, _ in [*_LAYOUT, *_NEW] if n != "reserved"]
STORE_SCHEMA = ", ".join(["hash bigint", *[f"{n} int" for n in FIELDS if n != "hash"], "seq bigint"])


def unpack(content: bytes) -> pd.DataFrame:
    """Used records of one store; an unknown header gives none. Version 1 records are upgraded."""
    empty = pd.DataFrame({n: pd.Series(dtype="int64" if n in ("hash", "seq") else "int32") for n in [*FIELDS, "seq"]})
    if len(content) < 20:
        return empty
    head = np.frombuffer(content, "<u4", 5)
    if head[0] or head[1] or (int(head[2]), int(head[3])) != MAGIC or head[4] not in (1, VERSION):
        return empty
    old = head[4] == 1
    kind, size = (V1, OLD_RECORD) if old else (V2, RECORD)
    rows = np.frombuffer(content, kind, max(0, len(content) // size - 1), size)
    table = pd.DataFrame({n: rows[n].astype("int64" if n == "hash" else "int32") if n in rows.dtype.names else np.zeros(len(rows), "int32") for n in FIELDS})
    if old:
        table["cyan_red"] = table["magenta_green"] = table["yellow_blue"] = np.int32(NEUTRAL_COLOUR)
    table["seq"] = np.arange(len(rows), dtype="int64")
    return table[table["hash"] != 0]


def unpack_stores(stores: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """All records of many store files (``content``); ``max_bytes`` leaves out larger files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield unpack(bytes(content))

    kept = stores.filter(F.length("content") <= max_bytes) if max_bytes is not None else stores
    return kept.select("content").mapInPandas(run, STORE_SCHEMA)


def read_stores(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Records of the store files at a path; files over ``max_bytes`` are left out before they are read."""
    files = spark.read.format("binaryFile").load(path)
    return unpack_stores(files.filter(F.col("length") <= max_bytes) if max_bytes is not None else files)


def write_store(params: DataFrame, folder: str) -> None:
    """The canonical store: Parquet, keyed rows only."""
    params.filter("hash <> 0").write.mode("overwrite").parquet(folder)

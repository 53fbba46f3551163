"""Folders and binary files as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquarry.functions import text
from pixelquarry.functions.formats import supported_endings
from pixelquarry.sources.listing import list_tree

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _as_catalog(files: DataFrame, endings: Iterable[str]) -> DataFrame:
    # Spark's file sources know no creation time
    named = files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    title = text.title_of(F.col("path"))
    return (
        named.withColumn("dir", text.folder_of(F.col("path")))
        .withColumn("title", title)
        .withColumn("ext", text.extension_of(title))
        .filter(F.lower("ext").isin(*[e.lower() for e in endings]))
        .withColumn("ctime", F.lit(None).cast("timestamp"))
    )


def scan_folder(spark: SparkSession, folder: str, endings: Iterable[str] | None = None, recursive: bool = False) -> DataFrame:
    """Catalog of the picture files in a folder; file contents are not read.

    A folder named by a URI that tasks can list (``*`` may stand in for names) is listed by them, so neither the driver nor its scheduler meets every file.
    Other folders are left to Spark's reader.
    """
    endings = list(endings or supported_endings())
    steps = folder.rstrip("/").split("/")
    plain = next((i for i, x in enumerate(steps) if any(c in x for c in "*?[]{}")), len(steps))
    if _listable("/".join(steps[:plain])) and not any(c in folder for c in "?[]{}"):
        found = list_tree(spark, "/".join(steps[:plain]), endings, None if recursive else len(steps) - plain + 1, steps[plain:], hidden=False)
        found = found.select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"), F.col("mtime").alias("modificationTime"), F.col("size").alias("length"))
        return _as_catalog(found, endings)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return _as_catalog(files, endings)


def _listable(folder: str) -> bool:
    if ":/" not in folder:
        return False
    try:
        fs, root = pafs.FileSystem.from_uri(folder)
        return fs.get_file_info(root).type == pafs.FileType.Directory
    except (pa.ArrowException, OSError):
        return False


def scan_tree(spark: SparkSession, folder: str, endings: Iterable[str] | None = None) -> DataFrame:
    """Same over all sub-folders, with the depth below ``folder``."""
    catalog = scan_folder(spark, folder, endings, recursive=True)
    base = F.regexp_replace(F.lit(folder.rstrip("/")), "^file:/*", "/")
    rest = F.regexp_replace(F.regexp_replace("dir", "^file:/*", "/"), F.concat(F.lit("^"), base), F.lit(""))
    return catalog.withColumn("depth", F.length(rest) - F.length(F.regexp_replace(rest, "/", "")))


def checksum_manifest(files: DataFrame, name: str = "name") -> DataFrame:
    """One manifest line ``<sha-256> *<name>`` per file."""
    return files.select(F.concat(F.sha2("content", 256), F.lit(" *"), F.col(name)).alias("line"))


def _explode_images(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import numpy as np

    for batch in batches:
        for row in batch.itertuples(index=False):
            plane = np.frombuffer(row.data, dtype=np.uint8).reshape(row.height, row.width, row.nChannels)
            if row.nChannels == 1:
                plane = np.repeat(plane, 3, axis=2)
            rows_per_chunk = max(1, (1 << 20) // max(1, row.width))
            for top in range(0, row.height, rows_per_chunk):
                part = plane[top:top + rows_per_chunk]
                ys, xs = np.mgrid[top:top + part.shape[0], 0:row.width]
                yield pd.DataFrame({
                    "image_id": row.image_id, "w": np.int32(row.width), "h": np.int32(row.height),
                    "x": xs.ravel().astype(np.int32), "y": ys.ravel().astype(np.int32),
                    "b": part[:, :, 0].ravel().astype(np.int32), "g": part[:, :, 1].ravel().astype(np.int32),
                    "r": part[:, :, 2].ravel().astype(np.int32),
                })


def read_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Pixel rows of the JPEG, PNG, GIF and BMP files below a folder.

    The image id is a hash of the file path, so it stays the same in every run.
    """
    images = _images(spark, folder).filter("image.nChannels > 0")
    flat = images.select(
        F.xxhash64("image.origin").alias("image_id"), "image.width", "image.height", "image.nChannels", "image.data"
    )
    return explode_pixels(flat)


def _images(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("image").option("recursiveFileLookup", "true").load(folder)


def undecodable(spark: SparkSession, folder: str) -> DataFrame:
    """``path, reason`` of the files that :func:`read_pixels` gives no pixels for."""
    return _images(spark, folder).filter("image.nChannels <= 0").select(F.col("image.origin").alias("path"), F.lit("not an image that can be decoded").alias("reason"))


def explode_pixels(images: DataFrame) -> DataFrame:
    """Decoded images (``image_id, width, height, nChannels, data``) to pixel rows, in chunks of about a million."""
    return images.select("image_id", "width", "height", "nChannels", "data").mapInPandas(
        _explode_images, "image_id bigint, w int, h int, x int, y int, b int, g int, r int"
    )

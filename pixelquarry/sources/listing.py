"""Folder trees listed level by level in tasks, and what changed between two listings.

Folders are rows: each level is dealt out to tasks, which list their folders and hand the next level on, so neither the driver nor one task meets the whole
tree. Known endings are tested where the folder is listed. A listing is a table like any other; two of them give the files that came, changed or went, and
files that were written to only just now wait for the next pair.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquarry.functions.formats import supported_endings
from pixelquarry.session import materialise

ENTRIES = "dir string, title string, is_dir boolean, size bigint, mtime timestamp, depth int"
_KIND = pa.schema([("dir", pa.string()), ("title", pa.string()), ("is_dir", pa.bool_()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("depth", pa.int32())])


def _listed(batches: Iterator[pa.RecordBatch], top: str, endings: frozenset[str], pattern: str | None, last: bool, hidden: bool) -> Iterator[pa.RecordBatch]:
    fs, base = pafs.FileSystem.from_uri(top)
    for batch in batches:
        for folder, depth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = []
            # names below the top are names, not parts of a URI
            for e in fs.get_file_info(pafs.FileSelector(base + folder[len(top) :], recursive=False, allow_not_found=True)):
                is_dir = e.type == pafs.FileType.Directory
                if not hidden and (e.base_name.startswith(".") or e.base_name.startswith("_") and "=" not in e.base_name):
                    continue
                if pattern is not None and not (fnmatch.fnmatchcase(e.base_name, pattern) and (is_dir or last)):
                    continue
                if is_dir or "." in e.base_name and e.base_name.rsplit(".", 1)[1].lower() in endings:
                    rows.append((folder, e.base_name, is_dir, None if is_dir else e.size, e.mtime, depth))
            for lo in range(0, len(rows), 10_000):
                columns = zip(*rows[lo : lo + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _KIND, strict=True)], schema=_KIND)


def list_tree(spark: SparkSession, folder: str, endings: Iterable[str] | None = None, levels: int | None = None, patterns: Sequence[str] = (), hidden: bool = True) -> DataFrame:
    """``path, dir, title, ext, size, mtime, depth`` of the files with known endings below a folder (a URI); ``levels`` 1: in the folder alone.

    A folder that is gone meanwhile counts as empty. ``patterns``: what names must look like on the first levels, as in ``lang=*/source=*``; files are
    taken from the level of the last one on. Without ``hidden``, names that begin with a dot or an underscore are passed over, as Spark's readers do.
    """
    known = frozenset(e.lower() for e in (endings or supported_endings()))
    top = folder.rstrip("/")
    level, parts, depth = spark.createDataFrame([(top, 0)], "dir string, depth int"), [], 0
    while True:
        own = (patterns[depth] if depth < len(patterns) else None, depth + 1 == len(patterns))
        dealt = level.repartition(spark.sparkContext.defaultParallelism, "dir")
        found = materialise(dealt.mapInArrow(lambda b, own=own: _listed(b, top, known, *own, hidden), ENTRIES))
        parts.append(found.filter("NOT is_dir"))
        below = found.filter("is_dir")
        depth += 1
        if depth == levels or below.isEmpty():
            break
        level = below.select(F.concat_ws("/", "dir", "title").alias("dir"), (F.col("depth") + 1).alias("depth"))
    files = parts[0]
    for part in parts[1:]:
        files = files.unionByName(part)
    return files.select(F.concat_ws("/", "dir", "title").alias("path"), "dir", "title", F.substring_index("title", ".", -1).alias("ext"), "size", "mtime", "depth")


def changes(before: DataFrame, now: DataFrame, listed_at, settle_ms: int = 250) -> DataFrame:
    """``path, kind (created, written, deleted), size, mtime`` between two listings (path, size, mtime).

    ``listed_at``: when ``now`` was made, a SQL expression or column. Files written to later than ``settle_ms`` before it are left out: they aren't part of
    :func:`settled` either, so the next pair brings them.
    """
    held = now.select("path", "size", "mtime")
    fresh = held.filter(_unsettled(listed_at, settle_ms)).select("path")
    old = before.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    both = old.join(held, "path", "full_outer").join(fresh, "path", "left_anti")
    kind = F.when(F.col("_size").isNull(), "created").when(F.col("size").isNull(), "deleted").otherwise("written")
    same = (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime"))
    return both.filter(~F.coalesce(same, F.lit(False))).select("path", kind.alias("kind"), "size", "mtime")


def settled(before: DataFrame, now: DataFrame, listed_at, settle_ms: int = 250) -> DataFrame:
    """The listing to compare the next one with: ``now``, but files that aren't settled stay as they were in ``before``, if they were."""
    fresh = _unsettled(listed_at, settle_ms)
    waiting = now.filter(fresh).select("path")
    return now.filter(~fresh).select("path", "size", "mtime").unionByName(before.join(waiting, "path", "left_semi").select("path", "size", "mtime"))


def _unsettled(listed_at, settle_ms: int):
    at = F.expr(listed_at) if isinstance(listed_at, str) else listed_at
    return F.col("mtime") > at - F.expr(f"INTERVAL {settle_ms} MILLISECONDS")

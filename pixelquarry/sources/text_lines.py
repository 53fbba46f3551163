"""Lines of text files in any of the usual encodings, and one section of a settings file.

Files are cut into byte ranges that tasks read on their own; a range has the lines that begin in it. The first bytes of the file tell its encoding: a byte
order mark, every other byte zero (UTF-16 without a mark), or else single bytes, where a line that isn't UTF-8 is read in ``ansi``. A byte range of a
file in UTF-16 is as good as any other, since ranges are even.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelquarry.operators.scaling import number_rows

RANGE_BYTES = 32 << 20
PROBE, LEAST_PROBE = 64, 16
_MORE = 1 << 16


def encoding_of(head: bytes) -> tuple[str, int]:
    """(encoding, bytes of the mark) from the first ``PROBE`` bytes; files under ``LEAST_PROBE`` bytes only count by their mark."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if head.startswith(mark):
            return name, len(mark)
    raw = np.frombuffer(head, np.uint8)
    odd = np.arange(len(raw)) % 2 == 1
    if len(raw) >= LEAST_PROBE and 3 * ((raw == 0) == odd).sum() > 2 * len(raw):
        return "utf-16-le", 0
    return "utf-8", 0


def _text(raw: bytes, encoding: str, ansi: str) -> str:
    if encoding != "utf-8":
        return raw.decode(encoding, "replace")
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode(ansi, "replace")


def _breaks(raw: bytes, encoding: str) -> np.ndarray:
    """Byte places behind the line ends."""
    if encoding == "utf-8":
        return np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    units = np.frombuffer(raw[: len(raw) // 2 * 2], "<u2" if encoding == "utf-16-le" else ">u2")
    return 2 * np.flatnonzero(units == 10) + 2


def lines_of_range(f: pa.NativeFile, start: int, stop: int, length: int, ansi: str) -> list[tuple[int, str]]:
    """(byte place, line without its end) of the lines that begin in [start, stop)."""
    encoding, mark = encoding_of(f.read_at(min(PROBE, length), 0))
    unit = 1 if encoding == "utf-8" else 2
    begin = max(mark, start - unit)  # the unit before tells whether a line begins right here
    if begin >= length:
        return []
    raw = f.read_at(max(0, stop - begin), begin)
    at = begin + _breaks(raw, encoding)
    places = at[(at >= start) & (at < min(stop, length))].tolist()
    if start <= mark < stop:
        places.insert(0, mark)
    if not places:
        return []
    while begin + len(raw) < length and not len(_breaks(raw[max(places[-1], stop - unit) - begin :], encoding)):
        raw += f.read_at(min(_MORE, length - begin - len(raw)), begin + len(raw))  # the last line goes on in the next range
    ends = begin + _breaks(raw, encoding)
    out = []
    for place in places:
        after = np.searchsorted(ends, place, "right")
        end = int(ends[after]) - unit if after < len(ends) else length
        out.append((place, _text(raw[place - begin : end - begin], encoding, ansi)))
    return out


def read_text(spark: SparkSession, path: str, ansi: str = "cp1252", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``list_id`` (the file), ``line_no`` from 1 and ``line`` of all text files at a path; empty files have no line."""
    step = max(2, range_bytes // 2 * 2)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").filter("length > 0")
    # a row stands for many bytes, so Spark's own number of tasks for so few rows would be too small
    total = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // RANGE_BYTES))
    ranges = files.withColumn("start", F.explode(F.expr(f"sequence(0L, length - 1, {step}L)"))).repartition(tasks, "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, length, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, name = pafs.FileSystem.from_uri(file)
                with fs.open_input_file(name) as f:
                    found = lines_of_range(f, start, start + step, length, ansi)
                for lo in range(0, len(found), 10_000):
                    at, lines = zip(*found[lo : lo + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(at)), pa.array(at, pa.int64()), pa.array(lines)], ["list_id", "at", "line"])

    lines = ranges.mapInArrow(read, "list_id string, at bigint, line string")
    return number_rows(lines, ["list_id"], [F.col("at")], pos="line_no").select("list_id", "line_no", "line")


def section(lines: DataFrame, name: str) -> DataFrame:
    """Lines between ``[name]`` (in any case) and the next heading of each file; a section that comes twice is read twice.

    Only headings are put in order; other lines meet the ranges of wanted ones.
    """
    heading = F.regexp_extract("line", r"^\s*\[([^\]]*)\]\s*$", 1)
    marked = lines.withColumn("_name", F.when(F.col("line").rlike(r"^\s*\[[^\]]*\]\s*$"), F.lower(F.trim(heading))))
    by_file = Window.partitionBy("list_id").orderBy("line_no")
    ranges = marked.filter("_name IS NOT NULL").withColumn("_to", F.lead("line_no").over(by_file)).filter(F.col("_name") == name.lower())
    ranges = ranges.select("list_id", F.col("line_no").alias("_from"), F.coalesce("_to", F.lit((1 << 63) - 1)).alias("_to"))
    return marked.filter("_name IS NULL").join(ranges, "list_id").filter("line_no > _from AND line_no < _to").select(lines.columns)

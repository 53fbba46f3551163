"""Text files that list pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelquarry.functions.formats import supported_endings
from pixelquarry.operators.scaling import number_rows

#: The usual limit where one is asked for: a list with a line of so many characters is refused.
LINE_LIMIT = 512


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of playlist files with their line number.

    Large files are split over tasks; the start of the split and the order of
    the rows in it give the place of a line in its file.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("list_id"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
        F.col("value").alias("line"),
    )
    return number_rows(lines, ["list_id"], [F.col("_block"), F.col("_row")], pos="line_no").drop("_block", "_row")


def first_kilobytes(lines: DataFrame, kilobytes: int = 200) -> DataFrame:
    """Lines (the last one cut) that lie in the first ``kilobytes`` of their list.

    Every line takes at least one byte, so a line whose place in the list is
    past the byte limit is out for certain. Those go first; the running sum of
    bytes then sees a bounded number of lines per list.
    """
    limit = kilobytes * 1024
    w = Window.partitionBy("list_id").orderBy("line_no")
    start = F.coalesce(F.sum(F.octet_length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = number_rows(lines, ["list_id"], [F.col("line_no")], pos="_place").filter(F.col("_place") <= limit).drop("_place")
    cut = F.expr(f"left(line, cast({limit} - _start AS int))")
    return (
        near.withColumn("_start", start)
        .filter(F.col("_start") < limit)
        .withColumn("line", F.when(F.octet_length("line") > limit - F.col("_start"), cut).otherwise(F.col("line")))
        .drop("_start")
    )


def refused_lists(lines: DataFrame, line_limit: int | None = None) -> DataFrame:
    """``list_id, reason`` of lists with a NUL in a line, or with a line of ``line_limit`` or more characters."""
    reason = F.when(F.col("line").contains("\0"), F.lit("NUL"))
    reason = reason.when(F.length("line") >= line_limit, F.lit("long line")) if line_limit is not None else reason
    return lines.withColumn("reason", reason).filter("reason IS NOT NULL").groupBy("list_id").agg(F.min("reason").alias("reason"))


def valid_lists(lines: DataFrame, line_limit: int | None = None) -> DataFrame:
    """Leaves out the lists that :func:`refused_lists` names."""
    return lines.join(refused_lists(lines, line_limit), "list_id", "left_anti")


def entry_of(line: Column, folder: str, endings: list[str] | None = None, sep: str = "\\") -> Column:
    """File named on a line: UNC path, else drive path, else a relative name with a known ending."""
    stop = r'([^\r\n"<]*)'
    twice = "\\" * 4
    unc = F.regexp_extract(line, r"(?s)^.*?(" + twice + stop[1:-1] + ")", 1)
    drive = F.regexp_extract(line, r"(?s)^.*?([\s\S]:" + "\\\\" + stop[1:-1] + ")", 1)
    lower = F.lower(line)
    marks = F.array(*[F.lit("." + e) for e in (endings or supported_endings())])
    # endings are tried in list order, not in the order they appear on the line
    at = F.coalesce(F.instr(lower, F.get(F.filter(marks, lambda m: F.instr(lower, m) > 0), 0)), F.lit(0))
    head = F.regexp_extract(F.substring(line, F.lit(1), at - 1), r'(?s)([^">]*)$', 1)
    tail = F.regexp_extract(F.substring(line, at, F.length(line)), "^" + stop, 1)
    # the name starts right after the last quote or bracket before the ending
    relative = F.regexp_extract(F.concat(head, tail), "^" + stop, 1)
    return (
        F.when(F.instr(line, "\\\\") > 0, unc)
        .when(drive != "", drive)
        .when(at > 0, F.concat(F.lit(folder + sep), relative))
    )


def playlist_entries(lines: DataFrame, folder: str, kilobytes: int | None = None, endings: list[str] | None = None, sep: str = "\\", line_limit: int | None = LINE_LIMIT) -> DataFrame:
    """``list_id, line_no, name`` of every usable line of every accepted list; ``kilobytes`` reads only the beginning of each list."""
    kept = valid_lists(first_kilobytes(lines, kilobytes) if kilobytes is not None else lines, line_limit)
    named = kept.withColumn("name", entry_of(F.col("line"), folder, endings, sep))
    return named.filter(F.col("name").isNotNull()).select("list_id", "line_no", "name")

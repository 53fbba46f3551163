"""File names, patterns and text templates as columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_text(value: str) -> str:
    """``value`` as a Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def folder_of(path: Column, sep: str = "/") -> Column:
    return F.regexp_extract(path, f"^(.*){re.escape(sep)}[^{re.escape(sep)}]*$", 1)


def title_of(path: Column, sep: str = "/") -> Column:
    return F.substring_index(path, sep, -1)


def extension_of(title: Column) -> Column:
    """Text after the last dot, empty without a dot."""
    return F.regexp_extract(title, r"\.([^.]*)$", 1)


def stem_of(title: Column) -> Column:
    return F.regexp_replace(title, r"\.[^.]*$", "")


def split_patterns(patterns: str) -> list[str]:
    """Alternatives of a ``a*b;c`` list; empty ones are skipped."""
    return [p for p in patterns.split(";") if p]


def glob_regex(pattern: str) -> str:
    """Regular expression of one alternative: anchored at the start, open at the end."""
    return "(?isu)^" + ".*?".join(re.escape(part) for part in pattern.split("*"))


def first_match(value: Column, patterns: Sequence[str]) -> Column:
    """The first pattern that matches ``value``, NULL if none does."""
    hits = [F.when(value.rlike(glob_regex(p)), F.lit(p)) for p in patterns]
    return F.coalesce(*hits, F.lit(None).cast("string"))


def more_specific(p1: str, p2: str) -> Column:
    """1 if pattern column ``p1`` is more specific, -1 if ``p2`` is, else 0."""
    common = (
        f"size(filter(sequence(0, least(length({p1}), length({p2}))), i -> i > 0 AND lower(left({p1}, i)) = lower(left({p2}, i))))"
    )
    c1, c2 = f"substr({p1}, {common} + 1, 1)", f"substr({p2}, {common} + 1, 1)"
    return F.expr(
        f"CASE WHEN {p1} IS NULL AND {p2} IS NULL THEN 0 WHEN {p1} IS NULL THEN -1 WHEN {p2} IS NULL THEN 1 "
        f"WHEN {c1} = '' AND {c2} = '' THEN 0 WHEN {c1} = '' THEN -1 WHEN {c2} = '' THEN 1 "
        f"WHEN {c1} = '*' THEN -1 WHEN {c2} = '*' THEN 1 ELSE 0 END"
    )


def position_ci(text: Column, part: Column) -> Column:
    """1-based position of ``part`` in ``text`` ignoring case, 0 if absent."""
    return F.call_function("locate", F.lower(part), F.lower(text))


def first_number(title: Column) -> Column:
    """First run of digits; a run that ends the text counts as none (kept behaviour)."""
    return F.regexp_extract(title, r"^\D*(\d+)\D", 1)


def natural_key(title: Column) -> Column:
    """Text that sorts like the name with every digit run compared by value.

    Runs of up to 20 significant digits are padded to 20 by two regular
    expressions. Names with a longer run take the general way, which puts the
    run's length before it behind a colon, past every padded run.
    """
    name = F.lower(title)
    padded = F.regexp_replace(F.regexp_replace(name, r"(\d+)", "0" * 20 + "$1"), r"\d+?(\d{20})(?!\d)", "$1")
    runs = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), 1)

    def one(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=.)", "")
        long = F.concat(F.lit(":"), F.lpad(F.length(digits).cast("string"), 4, "0"), digits)
        return F.when(~run.rlike(r"^\d"), run).when(F.length(digits) > 20, long).otherwise(F.lpad(digits, 20, "0"))

    return F.when(name.rlike(r"[1-9]\d{20}"), F.array_join(F.transform(runs, one), "")).otherwise(padded)


def rename_text(pattern: str, number: str = "number", title: str = "title", mtime: str = "mtime",
                time_zone: str = "UTC", pictures: str | None = None) -> Column:
    """Expand a rename pattern for each row, placeholder after placeholder in the fixed order.

    Inserted text can be expanded again by a later placeholder (kept behaviour).
    """
    local = f"from_utc_timestamp({mtime}, {sql_text(time_zone)})"
    num = f"cast({number} AS string)"
    text = F.lit(pattern)
    text = F.replace(text, F.lit("%x"), F.expr(num))
    text = F.replace(text, F.lit("%n"), first_number(F.col(title)))
    width = F.regexp_extract(text, r"(?s)%([2-9]).", 1)
    padded = F.lpad(F.expr(num), 9, "0")
    digits = F.greatest(F.when(width == "", F.lit(1)).otherwise(width.cast("int")), F.length(F.expr(num)))
    text = F.when(
        width != "",
        F.replace(text, F.concat(F.lit("%"), width, F.lit("x")),
                  F.when(F.length(F.expr(num)) >= 9, F.expr(num)).otherwise(F.right(padded, digits))),
    ).otherwise(text)
    text = F.replace(text, F.lit("%f"), F.col(title))
    text = F.replace(text, F.lit("%F"), stem_of(F.col(title)))
    text = F.when(F.col(title).contains("."), F.replace(text, F.lit("%e"), extension_of(F.col(title)))).otherwise(text)
    for mark, shape in [("%h", "HH"), ("%min", "mm"), ("%d", "dd"), ("%m", "MM"), ("%y", "yyyy"), ("%2y", "yy"), ("%M", "MMMM"), ("%3M", "MMM")]:
        text = F.replace(text, F.lit(mark), F.expr(f"date_format({local}, '{shape}')"))
    if pictures is not None:
        text = F.replace(text, F.lit("%pictures%"), F.lit(pictures))
    return text


def copy_needed(name: str, folder: str, sep: str = "/") -> Column:
    """False (rename) for a bare name or a target inside the current folder, else True (copy)."""
    s = sql_text(sep)
    head = f"length({name}) - length(substring_index({name}, {s}, -1)) - 1"
    return F.expr(
        f"CASE WHEN instr({name}, {s}) = 0 THEN false ELSE lower(left({name}, {head})) <> lower(left({folder}, {head})) END"
    )


def humanize_size(size: str) -> Column:
    return F.expr(
        f"CASE WHEN {size} >= 1048576 THEN concat(shiftright({size}, 20), ' MB') WHEN {size} >= 1024 THEN concat(shiftright({size}, 10), ' KB') "
        f"WHEN {size} > 0 THEN concat({size}, ' b') ELSE '' END"
    )


def info_line(template: str, title="title", path="path", pos="pos", total="n", zoom="zoom", width="width", height="height", size="size") -> Column:
    text = F.lit(template.replace("\\t", " " * 8))
    parts = {
        "<f>": F.col(title),
        "<p>": F.col(path),
        "<i>": F.expr(f"concat('[', {pos}, '/', {total}, ']')"),
        "<z>": F.expr(f"concat(cast({zoom} * 100 + 0.5D AS int), ' %')"),
        "<s>": F.expr(f"concat({width}, ' x ', {height})"),
        "<l>": humanize_size(size),
    }
    for mark, value in parts.items():
        if mark in template:
            text = F.replace(text, F.lit(mark), value)
    return F.trim(text)


def _smart_replace(text: Column, mark: str, value: Column, sep: str) -> Column:
    """Insert ``value`` in quotes unless the first mark touches a path separator."""
    s = re.escape(sep)
    first_only = F.regexp_extract(text, f"(?s)^(?:(?!{re.escape(mark)}).)*{re.escape(mark)}.?", 0)
    touches = first_only.rlike(f"{s}{re.escape(mark)}|{re.escape(mark)}{s}$")
    return F.when(touches, F.replace(text, F.lit(mark), value)).otherwise(
        F.replace(text, F.lit(mark), F.concat(F.lit('"'), value, F.lit('"')))
    )


def path_text(template: str, path: str = "path", selection: tuple[str, str, str, str] | None = None, sep: str = "/") -> Column:
    """Expand ``%filename% %filetitle% %directory%`` and the selection marks ``%w% %h% %x% %y%``.

    ``selection`` names the columns left, top, width, height.
    """
    text = F.lit(template)
    if selection is not None:
        left, top, width, height = selection
        for mark, col in (("%w%", width), ("%h%", height), ("%x%", left), ("%y%", top)):
            text = F.replace(text, F.lit(mark), F.col(col).cast("string"))
    text = F.replace(text, F.lit("%filename%"), F.concat(F.lit('"'), F.col(path), F.lit('"')))
    text = _smart_replace(text, "%filetitle%", title_of(F.col(path), sep), sep)
    if "%directory%" in template:
        folder = folder_of(F.col(path), sep)
        text = _smart_replace(text, "%directory%", F.when(folder == "", F.lit(".")).otherwise(folder), sep)
    return text


def placeholder_counts_match(key: str, value: str, marks: Sequence[str] = ("%d", "%s", "%filename%")) -> Column:
    """Does a translation hold every placeholder as often as its source text?"""
    same = [f"regexp_count({value}, {sql_text(re.escape(m))}) = regexp_count({key}, {sql_text(re.escape(m))})" for m in marks]
    return F.expr(f"{value} IS NULL OR {value} = '' OR ({' AND '.join(same)})")

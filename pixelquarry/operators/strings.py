"""Reconciling a reference list of texts with its translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelquarry.functions.text import placeholder_counts_match
from pixelquarry.session import materialise


def lookup(keys: DataFrame, translations: DataFrame) -> DataFrame:
    """Translation of each key per language, the key itself where there is none or an empty one.

    ``keys`` carries ``lang, key``; ``translations`` ``lang, key, value``.
    """
    known = translations.filter("value <> ''").select("lang", "key", "value")
    return keys.join(known.hint("merge"), ["lang", "key"], "left").withColumn("text", F.coalesce("value", "key")).drop("value")


def reconcile(reference: DataFrame, translations: DataFrame, langs: list[str] | None = None) -> DataFrame:
    """State of every key in every language: done, missing, same as the source, or out of date.

    Languages are the translation files at hand (``langs``, or those found).
    Each key fans out over that list in place, so one keyed full outer join is
    all that is needed.
    """
    if langs is None:
        langs = sorted(r["lang"] for r in translations.select("lang").distinct().collect())
    asked = reference.select("key").withColumn("lang", F.explode(F.array(*[F.lit(x) for x in langs]))).withColumn("_ref", F.lit(True))
    both = asked.join(translations.select("lang", "key", "value"), ["lang", "key"], "full")
    state = (
        F.when(F.col("_ref").isNull(), "out of date")
        .when(F.coalesce(F.col("value"), F.lit("")).rlike(r"^\t*$"), "missing")
        .when(F.col("value") == F.col("key"), "same")
        .otherwise("done")
    )
    return both.select("lang", "key", "value", state.alias("state"))


def placeholder_check(reference: DataFrame, translations: DataFrame) -> DataFrame:
    """Translated keys with a flag: is every placeholder kept as often as in the source?

    The reference list is as long as the texts are many, so both sides are shuffled and it is never broadcast.
    """
    pairs = reference.select("key").hint("merge").join(translations.filter("value <> ''"), "key")
    return pairs.select("lang", "key", placeholder_counts_match("key", "value").alias("fits"))


def progress(states: DataFrame) -> DataFrame:
    """Total, done, missing and percentages per language, and one overall row (``lang`` is ALL).

    A text equal to its source counts as done. Percentages round half to even.
    """
    rows = states.filter("state <> 'out of date'").rollup("lang").agg(
        F.count("*").alias("total"), F.sum(F.expr("IF(state = 'missing', 1L, 0L)")).alias("missing")
    )
    done = rows.withColumn("done", F.col("total") - F.col("missing"))
    percent = {n: F.expr(f"cast(bround(100.0D * {c} / total) AS bigint)") for n, c in (("percent", "done"), ("missing_percent", "missing"))}
    return done.withColumns(percent).withColumn("lang", F.coalesce("lang", F.lit("ALL")))


LITERAL = r'"([^"]*)"'


def literal_usage(texts: DataFrame, pattern: str = LITERAL) -> DataFrame:
    """``literal, doc_id, uses``: every literal with each file that holds it and how often.

    The files of a literal stay rows. A literal found in a third of all files
    would not fit one list; :func:`usage_counts` gives the totals.
    """
    found = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("literal"))
    return found.groupBy("literal", "doc_id").agg(F.count("*").alias("uses"))


def usage_counts(usage: DataFrame) -> DataFrame:
    return usage.groupBy("literal").agg(F.count("*").alias("files"), F.sum("uses").alias("uses"), F.min("doc_id").alias("first_file"))


def needs_no_translation(text: Column) -> Column:
    """Shapes that are never translated: blanks, endings, symbols, numbers, bracketed marks, switches, single letters."""
    return (
        (F.trim(text) == "")
        | text.rlike(r"^\.[a-z]{3}$")
        | text.rlike(r"^\*\.[a-z]{3,4}$")
        | text.rlike(r"^(?U)\W+$")
        | text.rlike(r"^[\d.]+$")
        | text.rlike(r"(?s)^<.*>$")
        | text.rlike(r"(?s)^%.*%$")
        | text.rlike(r"(?s)^\{.*\}$")
        | text.startswith("/")
        | ~text.rlike(r"[a-zA-Z]{2}")
    )


def untranslated(literals: DataFrame, translated: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """Harvested literals that are neither translated nor of a shape that needs none."""
    rest = literals.select("literal").distinct().join(translated.select(F.col("key").alias("literal")).distinct(), "literal", "left_anti")
    rest = rest.filter(~needs_no_translation(F.col("literal")))
    return rest.filter(~F.col("literal").isin(*excluded)) if excluded else rest


def except_keep_order(first: DataFrame, second: DataFrame) -> DataFrame:
    """Texts of ``first`` (``seq, text``) not in ``second``, each once at its first place."""
    left = first.groupBy("text").agg(F.min("seq").alias("seq"))
    return left.join(second.select("text").distinct(), "text", "left_anti")


def union_texts(*parts: DataFrame) -> DataFrame:
    out = parts[0].select("text")
    for p in parts[1:]:
        out = out.union(p.select("text"))
    return out.distinct()


def parse_catalog(lines: DataFrame) -> dict[str, DataFrame]:
    """Translation files as tables ``strings``, ``info``, ``comments`` and ``errors``.

    ``lines`` carries ``lang, line_no, line``. ``//: k: v`` is header
    information, ``//a<TAB>b`` a commented-out pair that still counts, other
    ``//`` lines are comments. A key given twice in active lines is an error;
    so is a commented pair that comes later with another value.
    """
    text = F.regexp_replace("line", "[\\r\\n]+$", "")
    rows = lines.withColumn("line", text).withColumn(
        "kind",
        F.when(F.col("line").startswith("//: "), "info")
        .when(F.col("line").startswith("//") & F.col("line").contains("\t"), "old")
        .when(F.col("line").startswith("//"), "comment")
        .when(F.length("line") > 0, "pair"),
    )
    old = F.col("kind") == "old"
    body = F.when(old, F.expr("substring(line, 3)")).otherwise(F.col("line"))
    rest = F.expr(r"IF(instr(t, '\t') > 0, substring(t, instr(t, '\t') + 1), '')")
    info = F.col("kind") == "info"
    key = F.when(info, F.regexp_extract("line", r"^//: ([^:]*):", 1)).when(F.col("kind").isin("pair", "old"), F.expr(r"trim(BOTH ' \t' FROM substring_index(t, '\t', 1))"))
    value = F.when(info, F.trim(F.regexp_extract("line", r"^//: [^:]*:(.*)$", 1))).when(F.col("kind") == "comment", F.col("line"))
    value = value.when(old, F.regexp_replace(rest, r"^\s+|\s+$", "")).when(F.col("kind") == "pair", F.regexp_replace(rest, r"\s+$", ""))
    # every line is taken apart once and written; the four tables read that
    rows = materialise(rows.withColumn("t", body).select("lang", "line_no", "kind", key.alias("key"), value.alias("value")))
    info = rows.filter("kind = 'info'").groupBy("lang", F.col("key").alias("k")).agg(F.max_by("value", "line_no").alias("v"))
    pairs = rows.filter("kind IN ('pair', 'old')")
    # the first line of a key gives its value; a commented repeat is only an error if it says something else
    first = pairs.groupBy("lang", "key").agg(
        F.min_by("value", "line_no").alias("value"), F.min("line_no").alias("_at"), F.count("*").alias("_n"),
        F.max(F.when(F.col("kind") == "pair", F.col("line_no"))).alias("_last_pair"), F.min("value").alias("_least"), F.max("value").alias("_most"),
    )
    # read twice, written once
    first = materialise(first.select("lang", "key", "value", F.when(F.expr("_n > 1 AND (_last_pair > _at OR _least <> _most)"), F.col("_n")).alias("_n")))
    clash = first.filter("_n IS NOT NULL").select("lang", "key", F.col("_n").alias("times"))
    return {
        "strings": first.select("lang", "key", "value"), "info": info,
        "comments": rows.filter("kind = 'comment'").select("lang", "line_no", F.col("value").alias("line")), "errors": clash,
    }

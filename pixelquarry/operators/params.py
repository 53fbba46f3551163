"""Keyed store of processing parameters: look up, change, merge, resolve.

A store is a table keyed by the 64-bit content key ``hash``; key 0 is reserved
and never matches. Newest-row choices are ``max_by`` aggregates, which combine
before the shuffle, so a key repeated in a third of all rows costs one row per
task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelquarry.functions.text import first_match, more_specific, split_patterns
from pixelquarry.operators.scaling import join_hot_keys


def lookup(files: DataFrame, params: DataFrame, defaults: dict[str, float], **kw) -> DataFrame:
    """Stored values by content key, else defaults; adds ``stored``."""
    found = params.filter("hash <> 0").select("hash", *[F.col(c).alias(f"_{c}") for c in defaults], F.lit(True).alias("_hit"))
    joined = join_hot_keys(files, found, ["hash"], "left", **kw)
    for c, value in defaults.items():
        joined = joined.withColumn(c, F.coalesce(f"_{c}", F.lit(value))).drop(f"_{c}")
    return joined.withColumn("stored", F.coalesce("_hit", F.lit(False))).drop("_hit")


def _newest(rows: DataFrame, rank: Column) -> DataFrame:
    values = [c for c in rows.columns if c not in ("hash", "_side")]
    picked = rows.groupBy("hash").agg(F.max_by(F.struct(*values), rank).alias("_v"))
    return picked.select("hash", *[F.col(f"_v.{c}").alias(c) for c in values])


def merge(store: DataFrame, imported: DataFrame, preserve: bool = True) -> DataFrame:
    """Add an imported store. Unknown keys are added; known keys follow the policy.

    A key repeated inside the import meets the same policy: preserve keeps the
    first row, overwrite the last. Key 0 is skipped.
    """
    rows = store.filter("hash <> 0").withColumn("_side", F.lit(0)).unionByName(
        imported.filter("hash <> 0").withColumn("_side", F.lit(1)))
    order = F.struct(F.col("_side"), F.col("seq"))
    if preserve:
        order = F.struct((-F.col("_side")).alias("a"), (-F.col("seq")).alias("b"))
    return _newest(rows, order)


def upsert(store: DataFrame, changes: DataFrame) -> DataFrame:
    """Add or replace rows by key; the last change of a key wins."""
    return merge(store, changes, preserve=False)


def delete(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select("hash").distinct(), "hash", "left_anti")


def store_within_limit(store: DataFrame, max_rows: int = 204_799) -> bool:
    """Does a store still fit the fixed-size file format? Reads at most one row past the limit."""
    return store.limit(max_rows + 1).count() <= max_rows


def rule_decision(path: Column, include: Sequence[str], exclude: Sequence[str]) -> dict[str, Column]:
    """First matching include and exclude pattern as columns."""
    return {"_inc": first_match(path, list(include)), "_exc": first_match(path, list(exclude))}


def resolve_rules(files: DataFrame, rules: dict[str, tuple[Sequence[str], Sequence[str]]], path: str = "path") -> DataFrame:
    """One nullable boolean per feature: True included, False excluded, NULL unchanged.

    If both sides match, the more specific pattern wins and a tie includes.
    The rule lists are configuration, so they compile into the projection and
    no join with the files is needed.
    """
    for feature, (include, exclude) in rules.items():
        matched = files.withColumns(rule_decision(F.col(path), include, exclude))
        files = matched.withColumn(
            feature,
            F.when(F.col("_inc").isNotNull() & F.col("_exc").isNotNull(), more_specific("_inc", "_exc") >= 0)
            .when(F.col("_inc").isNotNull(), F.lit(True))
            .when(F.col("_exc").isNotNull(), F.lit(False)),
        ).drop("_inc", "_exc")
    return files


def rules_from_text(include: str, exclude: str) -> tuple[list[str], list[str]]:
    return split_patterns(include), split_patterns(exclude)


#: fixed order of the numbers in a preset text (saturation is the twelfth)
PRESET_ORDER = [
    "contrast", "gamma", "sharpen", "color_correction", "contrast_correction", "lighten_shadows", "darken_highlights", "lighten_steepness",
    "cyan_red", "magenta_green", "yellow_blue", "saturation",
]


def apply_preset(params: DataFrame, preset: str, names: Sequence[str] = tuple(PRESET_ORDER)) -> DataFrame:
    """Override parameters by a preset text column of up to twelve numbers; -1 or a missing number keeps the value.

    Reading stops at the first token that is not a number.
    """
    tokens = f"split(trim({preset}), '\\\\s+')"
    for i, name in enumerate(PRESET_ORDER):
        if name not in names:
            continue
        all_numbers = f"forall(slice({tokens}, 1, {i + 1}), t -> try_cast(t AS double) IS NOT NULL)"
        value = f"CASE WHEN size({tokens}) > {i} AND {all_numbers} THEN nullif(try_cast(get({tokens}, {i}) AS double), -1.0D) END"
        params = params.withColumn(name, F.coalesce(F.expr(value), F.col(name)))
    return params


def effective(files: DataFrame, params: DataFrame, defaults: dict[str, float], rules: dict[str, tuple[Sequence[str], Sequence[str]]], **kw) -> DataFrame:
    """Final parameters of each file.

    A stored row wins unless ``keep`` is set. Otherwise defaults apply, folder
    rules (not under ``keep``) switch features, the orientation gives the
    rotation, and shadow lightening is reduced for night and sunset scenes.
    Files carry ``hash, path, keep, exif_rotation, night, sunset`` and one
    default flag per feature.
    """
    ruled = resolve_rules(files.withColumnsRenamed({f: f"_d_{f}" for f in rules}), rules)
    for f in rules:
        ruled = ruled.withColumn(f, F.expr(f"CASE WHEN keep THEN _d_{f} ELSE coalesce({f}, _d_{f}) END")).drop(f"_d_{f}")
    found = params.filter("hash <> 0").select(
        "hash", *[F.col(c).alias(f"_s_{c}") for c in defaults], F.col("flags").alias("_s_flags"), F.lit(True).alias("_hit")
    )
    joined = join_hot_keys(ruled, found, ["hash"], "left", **kw).withColumn("_use", F.expr("coalesce(_hit, false) AND NOT keep"))
    scene = "(1.0D - night) * (1.0D - sunset)"
    for c, value in defaults.items():
        base = f"{value!r}D * {scene}" if c == "lighten_shadows" else f"{value!r}D"
        # a stored row under "keep" leaves the kept values untouched
        own = f"CASE WHEN _hit THEN {value!r}D ELSE {base} END"
        joined = joined.withColumn(c, F.expr(f"CASE WHEN _use THEN _s_{c} ELSE {own} END"))
    bits = {"contrast_on": 1, "density_on": 2}
    for f, bit in zip(rules, bits.values()):
        joined = joined.withColumn(f, F.expr(f"CASE WHEN _use THEN (_s_flags & {bit}) <> 0 ELSE {f} END"))
    joined = joined.withColumn("rotation", F.expr("CASE WHEN _use THEN shiftright(_s_flags & 24, 3) * 90 WHEN _hit THEN 0 ELSE exif_rotation END"))
    return joined.withColumn("stored", F.expr("coalesce(_hit, false)")).drop("_use", "_hit", "_s_flags", *[f"_s_{c}" for c in defaults])

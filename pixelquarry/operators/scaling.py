"""Building blocks that keep hot groups from landing in one task.

Every helper is exact: rows are split over tasks, never dropped or sampled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelquarry.session import materialise

TILE_PIXELS = 1 << 18
HOT_ROWS = 1_000_000
HOT_KEYS = 10_000
CHUNK_ROWS = 1 << 16
TASK_ROWS = 500_000


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only if it is proven to hold at most ``max_rows`` rows.

    Past the bound the plain DataFrame comes back and Spark shuffles the join.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread_rows(df: DataFrame, times: int = 1, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` in so many tasks that none makes more than some ``task_rows`` rows where each row becomes ``times``.

    A small file is one task, whatever is made of its rows. Tables below the bound stay as they are.
    """
    tasks = -(-df.count() * times // task_rows)
    return df.repartition(tasks) if tasks > 1 else df


def _tile(x: str, tile_pixels: int) -> Column:
    return F.expr(f"cast(({x}) div {tile_pixels} AS int)")


def write_tiled(pixels: DataFrame, name: str, buckets: int, folder: str | None = None, tile_pixels: int = TILE_PIXELS) -> DataFrame:
    """Save pixels as a table bucketed by (image, tile) and return it.

    Later :func:`attach_per_image` calls read it without moving a pixel: only
    the small per-image side is shuffled. ``buckets`` fixes the read tasks, so
    choose it for the table's size (some 128 MB of Parquet per bucket).
    """
    tiled = pixels.withColumn("_tile", _tile("cast(y as bigint) * w + x", tile_pixels))
    writer = tiled.repartition(buckets, "image_id", "_tile").write.mode("overwrite").format("parquet")
    writer = writer.bucketBy(buckets, "image_id", "_tile").sortBy("image_id", "_tile")
    (writer.option("path", folder) if folder else writer).saveAsTable(name)
    return pixels.sparkSession.table(name)


def attach_per_image(pixels: DataFrame, per_image: DataFrame, tile_pixels: int = TILE_PIXELS, how: str = "inner") -> DataFrame:
    """Join one-row-per-image facts to pixel rows, tile by tile.

    ``per_image`` carries ``image_id, w, h``. An image is cut into runs of
    ``tile_pixels`` pixels and its facts are repeated once per run, so a giant
    image spreads over many tasks while small images are not repeated at all.
    Pixels of a :func:`write_tiled` table bring their tile along (the same
    ``tile_pixels`` applies) and keep it.
    """
    facts = per_image.withColumn("_tile", F.explode(F.sequence(F.lit(0), _tile("cast(w as bigint) * h - 1", tile_pixels)))).drop("w", "h")
    if "_tile" in pixels.columns:
        return pixels.join(facts, ["image_id", "_tile"], how)
    tiled = pixels.withColumn("_tile", _tile("cast(y as bigint) * w + x", tile_pixels))
    return tiled.join(facts, ["image_id", "_tile"], how).drop("_tile")


def join_hot_keys(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Equi join that spreads keys with more than ``hot_rows`` left rows, and left rows whose key is NULL.

    Hot keys come from one pre-aggregated count, which is run first; there are at most rows / ``hot_rows`` of them, and up to ``HOT_KEYS`` they are
    broadcast to both sides, so no row has to meet them by its bare key. Their right rows are repeated once per salt and their left rows take a salt
    from a hash of the whole row. A NULL key matches nothing, so its rows go anywhere. All other keys have the single salt 0.
    """
    on = list(on)
    hot = left.groupBy(*on).count().filter((F.col("count") > hot_rows) & ~_any_null(on))
    hot = hot.select(*on, F.ceil(F.col("count") / hot_rows).cast("int").alias("_salts"))
    found = hot.limit(HOT_KEYS + 1).collect()
    if len(found) <= HOT_KEYS:
        hot = F.broadcast(left.sparkSession.createDataFrame(found, hot.schema))
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    row_hash = F.xxhash64(*[F.col(c) for c in left.columns])
    salt = F.when(_any_null(on), F.pmod(row_hash, F.lit(1 << 20))).otherwise(F.pmod(row_hash, salts)).cast("int")
    marked = (lambda df: df.join(hot, on, "left")) if found else (lambda df: df.withColumn("_salts", F.lit(None).cast("int")))
    salted_left = marked(left).withColumn("_salt", salt).drop("_salts")
    salted_right = marked(right).withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")


def _any_null(columns: list[str]) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | F.col(c).isNull()
    return found


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    pos: str = "pos",
    total: str | None = None,
    ends: dict[str, tuple[str, str]] | None = None,
    helpers: Sequence[str] = (),
) -> DataFrame:
    """1-based position of each row inside its group, for groups of any size.

    The rows are range-partitioned by (group, order) and written once. Each
    written partition knows how many rows of a group lie before it from a small
    per-partition count table, so no task ever holds a whole group. ``order``
    must be a total order; columns that only serve it are named in ``helpers``
    and not written. ``ends`` maps an output column to
    ``("first" | "last", source column)`` and adds that group-wide value.
    """
    group = list(group)
    keys = [*group, *order]
    ranged = materialise(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_rid", F.monotonically_increasing_id()).drop(*helpers)
    ).withColumn("_chunk", F.shiftright("_rid", 33))
    aggs = [F.count("*").alias("_n"), F.min("_rid").alias("_start")]
    for name, (side, source) in (ends or {}).items():
        aggs.append((F.min_by if side == "first" else F.max_by)(source, "_rid").alias(f"_e_{name}"))
    chunks = ranged.groupBy(*group, "_chunk").agg(*aggs)
    # at most one row per (group, partition): a hot group has as many rows here as there are partitions
    scope = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    by_chunk = scope.orderBy("_chunk")
    before = F.coalesce(F.sum("_n").over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = chunks.withColumn("_before", before)
    if total:
        chunks = chunks.withColumn(total, F.sum("_n").over(scope))
    whole = by_chunk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for name, (side, _) in (ends or {}).items():
        pick = F.first if side == "first" else F.last
        chunks = chunks.withColumn(name, pick(f"_e_{name}").over(whole)).drop(f"_e_{name}")
    joined = ranged.join(chunks.drop("_n"), [*group, "_chunk"])
    return joined.withColumn(pos, F.col("_rid") - F.col("_start") + F.col("_before") + 1).drop(
        "_rid", "_chunk", "_start", "_before"
    )


def shifted(
    numbered: DataFrame,
    group: Sequence[str],
    columns: dict[str, tuple[str, int]],
    pos: str = "pos",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Values of rows at a fixed distance, over rows already numbered per group.

    ``columns`` maps an output name to ``(source, distance)``; positive looks
    ahead. The group is cut into chunks of ``chunk_rows`` positions and only the
    few rows next to a cut are repeated in the neighbouring chunk.
    """
    reach = max(abs(d) for _, d in columns.values())
    if reach > chunk_rows:
        chunk_rows = reach
    home = F.expr(f"({pos} - 1) div {chunk_rows}")
    ahead = F.expr(f"({pos} - 1 + {reach}) div {chunk_rows}")
    behind = F.expr(f"greatest({pos} - 1 - {reach}, 0) div {chunk_rows}")
    spread = numbered.withColumn("_home", home).withColumn(
        "_chunk", F.explode(F.array_distinct(F.array(home, ahead, behind)))
    )
    w = Window.partitionBy(*group, "_chunk").orderBy(pos)
    for name, (source, distance) in columns.items():
        spread = spread.withColumn(name, F.lead(source, distance).over(w) if distance > 0 else F.lag(source, -distance).over(w))
    return spread.filter("_chunk = _home").drop("_chunk", "_home")

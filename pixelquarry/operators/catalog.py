"""Ordering, walking, renaming and checking a catalog of files.

A catalog row has ``path, dir, title, ext, size, mtime, ctime``. A "list" is
one folder. Positions come from :func:`number_rows`, which never gathers a
folder in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelquarry.functions import text
from pixelquarry.operators.scaling import join_hot_keys, number_rows, shifted
from pixelquarry.session import materialise

SORT_KEYS = ("mtime", "ctime", "name", "size", "random")


def sort_key(key: str, natural: bool = True, seed: int = 0) -> Column:
    if key not in SORT_KEYS:
        raise ValueError(f"sort key must be one of {SORT_KEYS}")
    if key == "name":
        return text.natural_key(F.col("title")) if natural else F.col("title")
    if key == "random":
        return F.xxhash64(F.col("path"), F.lit(seed))
    return F.col(key)


def sort_catalog(catalog: DataFrame, key: str, descending: bool = False, **kw) -> DataFrame:
    """Whole catalog in order; the path breaks ties so the order is total."""
    main = sort_key(key, **kw)
    return catalog.orderBy(main.desc() if descending else main.asc(), "path")


def positions(catalog: DataFrame, key: str = "name", descending: bool = False, group=("dir",), total: str = "n", ends=None, **kw) -> DataFrame:
    """Adds ``pos`` (from 1) and the list length to every file of a list."""
    keyed = catalog.withColumn("_key", sort_key(key, **kw))
    order = [F.desc("_key") if descending else F.asc("_key"), F.asc("path")]
    return number_rows(keyed, list(group), order, total=total, ends=ends, helpers=["_key"])


def next_prev(catalog: DataFrame, key: str = "name", wrap: bool = True) -> DataFrame:
    """Following and preceding file of each file; past an end either wraps or stays on the file itself."""
    ends = {"_first": ("first", "path"), "_last": ("last", "path")}
    near = shifted(positions(catalog, key, ends=ends), ["dir"], {"next": ("path", 1), "prev": ("path", -1)})
    after, before = (F.col("_first"), F.col("_last")) if wrap else (F.col("path"), F.col("path"))
    return near.withColumn("next", F.coalesce("next", after)).withColumn("prev", F.coalesce("prev", before)).drop("_first", "_last")


def first_last(catalog: DataFrame, key: str = "name") -> DataFrame:
    """First and last file of each list from one aggregation, no sort."""
    rank = F.struct(sort_key(key).alias("k"), F.col("path"))
    return catalog.groupBy("dir").agg(F.min(rank)["path"].alias("first"), F.max(rank)["path"].alias("last"), F.count("*").alias("n"))


def peek(catalog: DataFrame, k: int, key: str = "name") -> DataFrame:
    """The k-th following and the k-th preceding file, used for read-ahead."""
    return shifted(positions(catalog, key), ["dir"], {"ahead": ("path", k), "behind": ("path", -k)})


def sibling_folders(catalog: DataFrame) -> DataFrame:
    """Next folder with images under the same parent, in name order, wrapping once."""
    folders = catalog.select("dir").distinct().withColumn("parent", text.folder_of(F.col("dir")))
    numbered = number_rows(folders, ["parent"], [F.col("dir")], total="n", ends={"_first": ("first", "dir")})
    near = shifted(numbered, ["parent"], {"next_dir": ("dir", 1)})
    return near.select(
        "parent", "dir", F.when(F.col("n") > 1, F.coalesce("next_dir", "_first")).alias("next_dir")
    )


def walk_subtree(catalog: DataFrame, root: str, key: str = "name", sep: str = "/") -> DataFrame:
    """Depth-first order of all files below ``root``: own files first, then child folders by name."""
    below = catalog.filter((F.col("dir") == root) | F.col("dir").startswith(root.rstrip(sep) + sep))
    keyed = below.withColumn("_dirs", F.split("dir", sep)).withColumn("_key", sort_key(key))
    return number_rows(keyed, [], [F.col("_dirs"), F.col("_key"), F.col("path")], helpers=["_dirs", "_key"])


def number_selected(catalog: DataFrame, key: str = "name") -> DataFrame:
    """Consecutive ``number`` over the selected rows of each list."""
    return positions(catalog.filter("selected"), key).withColumnRenamed("pos", "number")


def rename_plan(catalog: DataFrame, pattern: str, pictures: str = "/pictures", time_zone: str = "UTC", sep: str = "/") -> DataFrame:
    """What a batch rename would do: new name, copy or rename, target folder."""
    named = number_selected(catalog).withColumn("new_name", text.rename_text(pattern, time_zone=time_zone, pictures=pictures))
    has_folder = F.instr("new_name", sep) > 0
    return named.withColumn("copy", text.copy_needed("new_name", "dir", sep)).withColumn(
        "target_dir", F.when(has_folder, text.folder_of(F.col("new_name"), sep)).otherwise(F.col("dir"))
    )


def rename_steps(plan: DataFrame, existing: DataFrame, path: str = "path", target: str = "target") -> DataFrame:
    """A plan that can be carried out row by row, by ascending ``step``, without ever overwriting a file.

    ``plan`` has ``path, target, copy``, each path once; ``existing`` the paths that exist. The result adds ``state`` (done, same, collision, exists),
    ``step`` and ``via``: a file of a circle goes to its temporary name ``via`` in step 0 and from there to its target in its own step. Names are
    compared without case.

    Of several files with one target the one with the smallest path goes there. A file in the way is none if it is renamed itself, so plans are chains
    that begin at a free name, chains that end at a file that stays (refused as a whole), and circles. Places in them come from doubling pointers: as many
    rounds as the logarithm of the longest chain. Copies come first; their targets must be free from the start.
    """
    rows = plan.select(F.col(path).alias("path"), F.col(target).alias("target"), "copy", F.lower(path).alias("_from"), F.lower(target).alias("_to"))
    best = rows.groupBy("_to").agg(F.min("path").alias("_first"))
    there = existing.select(F.lower("path").alias("_to")).distinct().withColumn("_there", F.lit(True))
    rows = rows.join(best, "_to").join(there, "_to", "left")
    same = (F.col("_from") == F.col("_to")) & (F.col("path") == F.col("target"))
    state = F.when(same, "same").when(F.col("path") != F.col("_first"), "collision")
    state = state.when(F.col("copy") & F.col("_there"), "exists")
    rows = materialise(rows.withColumn("state", state).drop("_first"))
    moves = rows.filter("state IS NULL AND NOT copy")
    # ends: -1 at a free name (or its own, spelled otherwise), -2 at a file that stays
    after = moves.select(F.col("_from").alias("_to"), F.col("path").alias("_next"))
    own = F.col("_from") == F.col("_to")
    linked = moves.join(after, "_to", "left").select(
        "path", F.when(own, None).otherwise(F.col("_next")).alias("to"), F.lit(1).cast("bigint").alias("hops"),
        F.when(own | (F.col("_next").isNull() & F.col("_there").isNull()), -1).when(F.col("_next").isNull(), -2).alias("end"), F.col("path").alias("least"),
    )
    walked, before = materialise(linked), None
    while True:
        ahead = walked.filter("to IS NOT NULL")
        now = ahead.agg(F.count("*"), F.bit_xor(F.xxhash64("path", "least"))).first()
        if not now[0] or now == before:  # nobody came to an end and no circle saw a smaller path: only circles are left
            break
        before = now
        further = walked.select(F.col("path").alias("to"), F.col("to").alias("_to2"), F.col("hops").alias("_hops2"), F.col("end").alias("_end2"), F.col("least").alias("_least2"))
        walked = materialise(walked.join(further, "to", "left").select(
            "path", F.col("_to2").alias("to"), (F.col("hops") + F.coalesce("_hops2", F.lit(0))).alias("hops"), F.coalesce("end", "_end2").alias("end"), F.least("least", "_least2").alias("least")))
    # who still has someone ahead goes round: the circle is cut at its smallest path
    circle = walked.filter("to IS NOT NULL").select("path", F.col("least").alias("_cut")).join(moves.select("path", "_from", "_to"), "path")
    cut = circle.join(circle.select(F.col("_from").alias("_to"), F.col("path").alias("_next")), "_to")
    cut = cut.select("path", F.when(F.col("_next") == F.col("_cut"), None).otherwise(F.col("_next")).alias("to"), F.lit(1).cast("bigint").alias("hops"), (F.col("path") == F.col("_cut")).alias("first"))
    cut = materialise(cut)
    while not cut.filter("to IS NOT NULL").isEmpty():
        ahead = cut.select(F.col("path").alias("to"), F.col("to").alias("_to2"), F.col("hops").alias("_hops2"))
        cut = materialise(cut.join(ahead, "to", "left").select("path", F.col("_to2").alias("to"), (F.col("hops") + F.coalesce("_hops2", F.lit(0))).alias("hops"), "first"))
    placed = walked.filter("to IS NULL").select("path", "hops", F.when(F.col("end") == -1, "done").otherwise("exists").alias("_state"), F.lit(False).alias("first"))
    placed = placed.unionByName(cut.select("path", "hops", F.lit("done").alias("_state"), "first"))
    out = rows.join(placed, "path", "left").withColumn("state", F.coalesce("state", "_state", F.lit("done")))
    done = F.col("state") == "done"
    step = F.when(done, F.when(F.col("copy"), 0).otherwise(F.col("hops"))).cast("bigint")
    return out.select("path", "target", "copy", "state", step.alias("step"), F.when(done & F.col("first"), F.concat("path", F.lit(".~moving"))).alias("via"))


def plan_summary(plan: DataFrame, existing_dirs: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """Counts of renamed and copied files and of folders that have to be made; with the ``steps`` of the plan only of files that go through, and of failures."""
    failed = None
    if steps is not None:
        plan = plan.join(steps.select("path", "state"), "path")
        failed = plan.filter("state IN ('collision', 'exists')").selectExpr("IF(copy, 'copies failed', 'renames failed') AS what")
        plan = plan.filter("state = 'done'")
    new_dirs = (
        plan.select(F.col("target_dir").alias("dir")).distinct().join(existing_dirs.select("dir").distinct(), "dir", "left_anti")
    )
    what = plan.selectExpr("IF(copy, 'copied', 'renamed') AS what").unionByName(new_dirs.selectExpr("'folders created' AS what"))
    return (what if failed is None else what.unionByName(failed)).groupBy("what").agg(F.count("*").alias("n"))


def verify(catalog: DataFrame, existing: DataFrame) -> DataFrame:
    """Marks each entry as kept or lost against a listing; every entry is tested."""
    found = existing.select("path").distinct().withColumn("_found", F.lit(True))
    return catalog.join(found, "path", "left").withColumn("state", F.when(F.col("_found"), "kept").otherwise("lost")).drop("_found")


def union_hits(catalog: DataFrame, patterns: list[str], distinct: bool = True) -> DataFrame:
    """Files that match any pattern; without ``distinct`` one row per hit.

    One pass over the catalog whatever the number of patterns.
    """
    hits = F.array_compact(F.array(*[F.when(F.col("title").rlike(text.glob_regex(p)), F.lit(p)) for p in patterns]))
    if distinct:
        return catalog.filter(F.size(hits) > 0).dropDuplicates(["path"])
    return catalog.withColumn("pattern", F.explode(hits))


def duplicate_content(files: DataFrame, key: str = "hash", **kw) -> DataFrame:
    """Files that share their content key with another path, with the number of copies.

    No pairs are built: each file gets one row, and a key held by a large part
    of all files is spread by :func:`join_hot_keys`.
    """
    copies = files.filter(F.col(key) != 0).groupBy(key).agg(F.count("*").alias("copies"), F.min("path").alias("first_path")).filter("copies > 1")
    return join_hot_keys(files, copies, [key], "inner", **kw)


def resolve_playlist(lines: DataFrame, catalog: DataFrame, **kw) -> DataFrame:
    """Playlist entries that exist in the catalog; order and repeats are kept, missing files dropped.

    The parsed lines are written once, because counting the hot keys and the
    join itself both read them.
    """
    known = catalog.withColumn("_path", F.lower("path")).select("_path", F.col("path"), "size", "mtime")
    asked = materialise(lines.withColumn("_path", F.lower("name")).select("list_id", "line_no", "_path"))
    return join_hot_keys(asked, known, ["_path"], "inner", **kw).drop("_path")


# fixed values: largest accepted file per format in MiB, largest side and pixel count
MAX_MIB = {"JPEG": 300, "PNG": 300, "WEBP": 150, "JXL": 150, "HEIF": 150, "AVIF": 150, "PSD": 500, "BMP": 500}
MAX_SIDE = 65535
MAX_PIXELS = 65535 * 65535


def size_guard(files: DataFrame, max_bytes: dict[str, int] | None = None, max_pixels: int = MAX_PIXELS, max_side: int = MAX_SIDE) -> DataFrame:
    """Adds ``status``: ok, or why a file counts as too large. Formats without a byte limit have none.

    Files carry ``format, size, width, height``; nothing is read from them.
    """
    limits = max_bytes if max_bytes is not None else {f: m << 20 for f, m in MAX_MIB.items()}
    over = F.lit(False)
    for name, limit in limits.items():
        over = over | ((F.col("format") == name) & (F.col("size") > limit))
    return files.withColumn(
        "status",
        F.when(over, "too many bytes")
        .when((F.col("width") > max_side) | (F.col("height") > max_side), "side too long")
        .when(F.col("width").cast("bigint") * F.col("height") > max_pixels, "too many pixels")
        .otherwise("ok"),
    )


def quarantine(guarded: DataFrame, folder: str) -> DataFrame:
    """Write refused files to a table of their own and go on with the rest."""
    guarded.filter("status <> 'ok'").write.mode("overwrite").partitionBy("status").parquet(folder)
    return guarded.filter("status = 'ok'").drop("status")

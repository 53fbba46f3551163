"""Watching folders: batch forms of the change operators, and streams of new files.

The stream forms, with Spark's keyed state and timers, are in :mod:`pixelquarry.streaming.state`. The batch forms give the same events and spread even a
single busy folder or path over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelquarry.functions import text
from pixelquarry.functions.formats import supported_endings
from pixelquarry.operators.scaling import CHUNK_ROWS, number_rows, shifted
from pixelquarry.session import materialise
from pixelquarry.sources.files import FILE_SCHEMA
from pixelquarry.streaming.state import micros

THROTTLE_MS = 500
SETTLE_MS = 250
#: Chunk tables that one task chains at a time.
FAN = 32


def watch_folder(spark: SparkSession, folder: str, endings: Iterable[str] | None = None) -> DataFrame:
    """Stream of new picture files in a folder (not below it); contents are not kept. :func:`take_settled` waits for files still being written."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "false").load(folder).drop("content")
    known = [e.lower() for e in (endings or supported_endings())]
    return files.filter(F.lower(text.extension_of(text.title_of(F.col("path")))).isin(*known))


def settled(files: DataFrame, delay_ms: int = SETTLE_MS, mtime: str = "modificationTime") -> DataFrame:
    """Only files last written at least ``delay_ms`` ago."""
    return files.filter(F.expr(f"{mtime} <= current_timestamp() - INTERVAL {delay_ms} MILLISECONDS"))


def take_settled(
    spark: SparkSession, folder: str, seen: str, sink: Callable[[DataFrame], None], endings: Iterable[str] | None = None, delay_ms: int = SETTLE_MS,
) -> int:
    """Hand picture files of a folder that are at least ``delay_ms`` old and were not handed out before to ``sink``; returns their number.

    Call it again and again: the file source of a stream lists a file once and never comes back to one that was too fresh, so each call lists the
    folder anew and leaves out the paths in the table at ``seen``, to which it appends after ``sink`` has returned (a run that fails in between hands
    the same files out again).
    """
    files = spark.read.format("binaryFile").load(folder).drop("content")
    known = [e.lower() for e in (endings or supported_endings())]
    named = files.filter(F.lower(text.extension_of(text.title_of(F.col("path")))).isin(*known))
    spark.createDataFrame([], "path string").write.mode("append").parquet(seen)  # so that the first run finds a table
    before = spark.read.schema("path string").parquet(seen)
    fresh = materialise(settled(named, delay_ms).join(before, "path", "left_anti"))
    taken = fresh.count()
    if taken:
        sink(fresh)
        fresh.select("path").write.mode("append").parquet(seen)
    return taken


# --- real changes ----------------------------------------------------------------------------

def changed_events(events: DataFrame, last_seen: DataFrame | None = None) -> DataFrame:
    """Events whose file time differs from the one last seen for the path.

    ``events`` carries ``path, ts, event_id, mtime``. A path never seen counts
    as changed. A busy path is cut into chunks, so no task holds all its events.
    """
    numbered = number_rows(events, ["path"], [F.col("ts"), F.col("event_id")])
    near = shifted(numbered, ["path"], {"_before": ("mtime", -1)})
    if last_seen is not None:
        # only the first event of a path in this batch asks the stored state
        known = last_seen.select("path", F.col("mtime").alias("_seen"), F.lit(1).cast("bigint").alias("pos"))
        near = near.join(known, ["path", "pos"], "left").withColumn("_before", F.coalesce("_before", "_seen")).drop("_seen")
    return near.filter("_before IS NULL OR _before <> mtime").drop("_before", "pos")


# --- throttle --------------------------------------------------------------------------------

def _jumps(times: np.ndarray, wait: int) -> np.ndarray:
    """Index of the next event that may pass after each event passed (length = none here)."""
    return np.searchsorted(times, times + wait, side="left")


def _runs(keys: np.ndarray) -> zip:
    """(start, stop) of the runs of equal keys."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return zip(starts.tolist(), np.append(starts[1:], len(keys)).tolist(), strict=True)


def _table(pdf: pd.DataFrame, parts: list[tuple]) -> pd.DataFrame:
    """Rows (dir, chunk, start, exit) of the tables of a folder's chunks."""
    sizes = [len(starts) for _, starts, _ in parts]
    out = pd.DataFrame({"start": np.concatenate([p[1] for p in parts]), "exit": np.concatenate([p[2] for p in parts])})
    return out.assign(dir=pdf["dir"].iloc[0], chunk=np.repeat([p[0] for p in parts], sizes))[["dir", "chunk", "start", "exit"]]


def _exits(times: np.ndarray, wait: int) -> tuple[np.ndarray, np.ndarray]:
    """For every event a chunk could start with: until when the chunk blocks what follows it."""
    nxt = _jumps(times, wait)
    last = times.copy()
    for i in range(len(times) - 1, -1, -1):
        if nxt[i] < len(times):
            last[i] = last[nxt[i]]
    # what came before blocks at most until the first event plus the wait, so a
    # chunk starts with an event up to then or with the next one after it
    upto = min(len(times), int(np.searchsorted(times, times[0] + wait, side="left")) + 1)
    starts, exits = times[:upto], last[:upto] + wait
    keep = np.append(exits[1:] != exits[:-1], True)
    return starts[keep], exits[keep]


def _chunk_exits(pdf: pd.DataFrame, wait: int) -> pd.DataFrame:
    """The tables of a bundle of chunks."""
    pdf = pdf.sort_values("pos")
    chunk, times = pdf["chunk"].to_numpy(), pdf["t"].to_numpy()
    return _table(pdf, [(chunk[lo], *_exits(times[lo:hi], wait)) for lo, hi in _runs(chunk)])


def _composed(tables: list[tuple[np.ndarray, np.ndarray]], wait: int) -> tuple[np.ndarray, np.ndarray]:
    """One table for neighbouring chunks: the exit that follows from each entry through all of them."""
    starts, exits = tables[0]
    for later, after in tables[1:]:
        at = np.searchsorted(later, exits, side="left")
        # a block that outlasts a chunk passes nothing in it and stays as it is
        through = np.where(at < len(later), after[np.minimum(at, len(later) - 1)], exits)
        rest = later > starts[-1]  # entries that no event of the chunks before takes
        starts, exits = np.append(starts, later[rest]), np.append(through, after[rest])
        upto = int(np.searchsorted(starts, starts[0] + wait, side="left")) + 1  # no entry comes later, as in a chunk
        starts, exits = starts[:upto], exits[:upto]
        keep = np.append(exits[1:] != exits[:-1], True)
        starts, exits = starts[keep], exits[keep]
    return starts, exits


def _compose(pdf: pd.DataFrame, wait: int) -> pd.DataFrame:
    """The tables of a bundle of chunks of the next level, each from its neighbours of the level below."""
    pdf = pdf.sort_values(["chunk", "start"])
    up, chunk, starts, exits = (pdf[c].to_numpy() for c in ("up", "chunk", "start", "exit"))
    parts = []
    for lo, hi in _runs(up):
        parts.append((up[lo], *_composed([(starts[lo + x : lo + y], exits[lo + x : lo + y]) for x, y in _runs(chunk[lo:hi])], wait)))
    return _table(pdf, parts)


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """The time until which each of a few neighbouring chunks is blocked on entry, from that of the first."""
    pdf = pdf.sort_values(["chunk", "start"])
    up, chunk, starts, exits, given = (pdf[c].to_numpy() for c in ("up", "chunk", "start", "exit", "free"))
    rows = []
    for lo, hi in _runs(up):
        free = int(given[lo])
        for x, y in _runs(chunk[lo:hi]):
            rows.append((chunk[lo + x], free))
            at = lo + x + int(np.searchsorted(starts[lo + x : lo + y], free, side="left"))
            free = int(exits[at]) if at < lo + y else free
    return pd.DataFrame(rows, columns=["chunk", "free"]).assign(dir=pdf["dir"].iloc[0])[["dir", "chunk", "free"]]


def _accepted(pdf: pd.DataFrame, wait: int) -> pd.DataFrame:
    pdf = pdf.sort_values("pos")
    chunk, times, free = (pdf[c].to_numpy() for c in ("chunk", "t", "free"))
    picks = []
    for lo, hi in _runs(chunk):
        own = times[lo:hi]
        nxt = _jumps(own, wait)
        i = int(np.searchsorted(own, free[lo], side="left"))
        while i < len(own):
            picks.append(lo + i)
            i = int(nxt[i])
    return pdf.iloc[picks][["event_id"]]


def throttle(events: DataFrame, wait_ms: int = THROTTLE_MS, last_passed: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS, fan: int = FAN) -> DataFrame:
    """Per folder, pass an event and then stay silent for ``wait_ms``. Returns the passed events.

    Whether an event passes depends on the one that passed before it, but only
    through the time until which that one blocks. A folder is cut into chunks
    of bounded size; each chunk tabulates which exit time follows from which
    entry. These step functions are composed as a tree, ``fan`` neighbours at a
    time, and entry times go down the same tree (a parallel prefix), so no task
    meets more than ``fan`` short tables however many chunks a folder has. Each
    chunk then picks its events. Python is handed bundles of neighbouring
    chunks, up to ``CHUNK_ROWS`` rows at once. ``last_passed`` (``dir, ts``) carries state
    between batches.
    """
    wait = wait_ms * 1000
    rows = events.select("event_id", "dir", "ts", micros(events).alias("t"))
    if last_passed is not None:
        known = last_passed.select("dir", (micros(last_passed) + wait).alias("free"))
        rows = rows.join(known, "dir", "left").filter("free IS NULL OR t >= free").drop("free")
    numbered = number_rows(rows, ["dir"], [F.col("ts"), F.col("event_id")])
    bundle, bundle_up = max(1, CHUNK_ROWS // chunk_rows), max(1, CHUNK_ROWS // (chunk_rows * fan))
    chunks = numbered.selectExpr("dir", "event_id", "pos", "t", f"(pos - 1) div {chunk_rows} AS chunk").withColumn("bundle", F.expr(f"chunk div {bundle}"))
    grouped = lambda level: level.withColumn("up", F.expr(f"chunk div {fan}")).withColumn("bundle", F.expr(f"up div {bundle_up}"))
    table, entry = "dir string, chunk bigint, start bigint, exit bigint", "dir string, chunk bigint, free bigint"
    levels = [materialise(chunks.groupBy("dir", "bundle").applyInPandas(lambda p: _chunk_exits(p, wait), table))]
    tasks = events.sparkSession.sparkContext.defaultParallelism  # tables are short, but take long
    last = levels[0].agg(F.coalesce(F.max("chunk"), F.lit(0))).first()[0]
    while last > 0:
        levels.append(materialise(grouped(levels[-1]).repartition(tasks, "dir", "bundle").groupBy("dir", "bundle").applyInPandas(lambda p: _compose(p, wait), table)))
        last //= fan
    blocked = levels.pop().select("dir", "chunk").distinct().withColumn("free", F.lit(-(1 << 62)).cast("bigint"))
    for level in reversed(levels):
        above = blocked.withColumnRenamed("chunk", "up")
        blocked = grouped(level).join(above, ["dir", "up"]).groupBy("dir", "bundle").applyInPandas(_entries, entry)
    picked = chunks.join(blocked, ["dir", "chunk"]).groupBy("dir", "bundle").applyInPandas(lambda p: _accepted(p, wait), "event_id bigint")
    return events.join(picked, "event_id", "left_semi")


# --- renames ---------------------------------------------------------------------------------

RENAME_MS = 250
#: Window of time, in multiples of the wait, in which files of one identity meet.
_REACH = 64


def renames(events: DataFrame, within_ms: int = RENAME_MS, identity: Sequence[str] = ("length", "mtime")) -> DataFrame:
    """Deletions and creations of the same file within ``within_ms``, paired as renames: old_path, new_path, deleted_id, created_id.

    A deletion goes with the nearest creation of its ``identity`` before or after it, if that one's nearest deletion is this (of equally near ones the
    earlier, then the smaller id). Identities meet in windows of time that overlap by the wait, so a common one (empty files, say) is spread over its span.
    """
    wait = within_ms * 1000
    rows = events.filter("kind IN ('deleted', 'created')").select("path", "event_id", F.col("kind").alias("kind"), micros(events).alias("t"), *[F.col(c).alias(f"_i{n}") for n, c in enumerate(identity)])
    span = wait * _REACH
    home = F.expr(f"floor(t / {span})")
    near = F.array_distinct(F.array(home, F.expr(f"floor((t - {wait}) / {span})"), F.expr(f"floor((t + {wait}) / {span})")))
    spread = rows.withColumn("_home", home).withColumn("_part", F.explode(near))
    key = [f"_i{n}" for n in range(len(identity))]
    before = Window.partitionBy(*key, "_part").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    # what follows, seen backwards: a frame up to the end would be gone through again for every row
    after = Window.partitionBy(*key, "_part").orderBy(F.desc("t"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    other = F.struct("t", "event_id", "path")
    for kind in ("deleted", "created"):
        # of several at one time the smallest id: the next that follows, and before the row the first of the last time
        spread = spread.withColumn(f"_{kind}_after", F.last(F.when(F.col("kind") == kind, other), ignorenulls=True).over(after))
        latest = F.max(F.when(F.col("kind") == kind, F.struct("t", (-F.col("event_id")).alias("n"), "path"))).over(before)
        spread = spread.withColumn(f"_{kind}_before", latest)

    def nearest(kind: str) -> Column:
        early, late = F.col(f"_{kind}_before"), F.col(f"_{kind}_after")
        options = F.array(
            F.when(F.col("t") - early["t"] <= wait, F.struct((F.col("t") - early["t"]).alias("d"), early["t"].alias("t"), (-early["n"]).alias("id"), early["path"].alias("path"))),
            F.when(late["t"] - F.col("t") <= wait, F.struct((late["t"] - F.col("t")).alias("d"), late["t"].alias("t"), late["event_id"].alias("id"), late["path"].alias("path"))),
        )
        return F.array_min(F.filter(options, lambda o: o.isNotNull()))

    met = spread.filter("_home = _part")
    gone = met.filter("kind = 'deleted'").select(F.col("path").alias("old_path"), F.col("event_id").alias("deleted_id"), nearest("created").alias("c"))
    made = met.filter("kind = 'created'").select(F.col("event_id").alias("created_id"), nearest("deleted")["id"].alias("_best"))
    gone = gone.select("old_path", "deleted_id", F.col("c.path").alias("new_path"), F.col("c.id").alias("created_id")).filter("created_id IS NOT NULL")
    paired = gone.join(made, "created_id").filter("_best = deleted_id AND old_path <> new_path")
    return paired.select("old_path", "new_path", "deleted_id", "created_id")


def entries(events: DataFrame, within_ms: int = RENAME_MS, identity: Sequence[str] = ("length", "mtime")) -> DataFrame:
    """Files that exist after all events, each with the entry it has been since its first creation: entry_id, path, length, renamed.

    A path's life runs from a creation to its next deletion; a rename joins the life it ends to the one it begins. The first life's creation names the
    entry. Chains of renames are followed by doubling pointers, in as many rounds as the logarithm of the longest.
    """
    ordered = Window.partitionBy("path").orderBy("t", "event_id")
    rows = events.withColumn("t", micros(events)).withColumn("life", F.last(F.when(F.col("kind") == "created", F.col("event_id")), ignorenulls=True).over(ordered))
    moved = renames(events, within_ms, identity)
    ended = rows.filter("kind = 'deleted'").select(F.col("event_id").alias("deleted_id"), F.col("life").alias("to"))
    links = materialise(moved.join(ended, "deleted_id").select(F.col("created_id").alias("life"), "to").filter("to IS NOT NULL AND to <> life"))
    hops = links.withColumn("hops", F.lit(1).cast("bigint"))
    while True:
        further = hops.select(F.col("life").alias("to"), F.col("to").alias("_next"), F.col("hops").alias("_more"))
        hops = materialise(hops.join(further, "to", "left").select("life", F.coalesce("_next", "to").alias("to"), (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"), F.col("_next").isNotNull().alias("_moved")))
        if hops.filter("_moved").isEmpty():
            break
        hops = hops.drop("_moved")
    newest = rows.groupBy("path").agg(F.max_by(F.struct("kind", "length", "life", "event_id"), F.struct("t", "event_id")).alias("v"))
    alive = newest.filter("v.kind <> 'deleted'").select("path", "v.length", F.coalesce("v.life", "v.event_id").alias("life"))
    named = alive.join(hops.select("life", "to", "hops"), "life", "left")
    return named.select(F.coalesce("to", "life").alias("entry_id"), "path", "length", F.coalesce("hops", F.lit(0)).cast("bigint").alias("renamed"))

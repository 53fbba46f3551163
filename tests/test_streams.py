"""Streams: shuffled arrival, restart, state that goes, settle delay; renames."""

import os
import time

import numpy as np

from pixelquarry.streaming import state, watch


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id bigint, path string, dir string, kind string, s bigint, m bigint, length bigint").selectExpr(
        "event_id", "path", "dir", "kind", "timestamp_seconds(s + 1000000)::timestamp_ntz AS ts", "timestamp_seconds(m)::timestamp_ntz AS mtime", "length")


def fed(spark, tmp_path, make, parts, name="out"):
    """Rows of a stream that is stopped after each part of its input and started again from its checkpoint."""
    for part in parts:
        part.repartition(3).write.mode("append").parquet(f"{tmp_path}/{name}-in")
        rows = make(spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 4).parquet(f"{tmp_path}/{name}-in"))
        writer = rows.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-cp")
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{tmp_path}/{name}").filter("event_id >= 0")


def end(spark, second):
    return events(spark, [(-1, "", "", "", second, 0, 0)])


def test_ordered_changes_of_a_stopped_stream(spark, tmp_path):
    rows = [(i, f"/f{i % 3}", "/", "written", 10 * i, (i // 4) % 3, i) for i in range(48)]
    shuffled = [rows[i] for i in np.random.default_rng(1).permutation(24)], [rows[24 + i] for i in np.random.default_rng(2).permutation(24)]
    parts = [events(spark, shuffled[0]), events(spark, shuffled[1]), end(spark, 10**6)]
    got = fed(spark, tmp_path, lambda s: state.modified_stream(s, "1000 seconds"), parts)
    want = sorted((r.event_id, r.path) for r in watch.changed_events(events(spark, rows)).collect())
    assert sorted((r.event_id, r.path) for r in got.collect()) == want and 10 < len(want) < 48


def test_an_idle_path_is_forgotten(spark, tmp_path):
    rows = [(1, "/a", "/", "written", 0, 5, 1), (2, "/a", "/", "written", 10, 5, 1), (3, "/b", "/", "written", 10, 5, 1), (4, "/a", "/", "written", 500, 5, 1)]
    parts = [events(spark, rows[:3]), end(spark, 200), events(spark, rows[3:]), end(spark, 10**6)]
    got = fed(spark, tmp_path, lambda s: state.modified_stream(s, "20 seconds", keep_ms=60_000), parts)
    assert sorted(r.event_id for r in got.collect()) == [1, 3, 4]
    held = spark.read.format("statestore").option("path", f"{tmp_path}/out-cp").option("stateVarName", "last").load()
    assert [r.path for r in held.select("key.path").collect()] in ([], ["/a"])


def test_throttle_of_a_stopped_stream(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, "/x", f"/d{i % 2}", "written", int(s), 0, 0) for i, s in enumerate(rng.integers(0, 400, 120))]
    parts = [events(spark, rows[:40]), events(spark, rows[40:80]), events(spark, rows[80:]), end(spark, 10**6)]
    got = fed(spark, tmp_path, lambda s: state.throttled_stream(s, 20_000, "500 seconds"), parts)
    want = sorted(r.event_id for r in watch.throttle(events(spark, rows), 20_000).collect())
    assert sorted(r.event_id for r in got.collect()) == want and 20 < len(want) < 60


def test_catalog_in_the_state(spark, tmp_path):
    make = lambda s: state.catalog_stream(s, "100 seconds")
    current = lambda: sorted((r.path, r.length) for r in state.read_catalog(spark, f"{tmp_path}/out-cp").collect() if r.path)
    first = events(spark, [(2, "/a", "/", "written", 9, 9, 7), (3, "/b", "/", "deleted", 9, 9, 0), (4, "/c", "/", "created", 9, 9, None)])
    fed(spark, tmp_path, make, [first])
    assert current() == [("/a", 7), ("/c", None)]
    older = events(spark, [(1, "/a", "/", "created", 1, 1, 5), (1, "/b", "/", "created", 1, 1, 5), (5, "/c", "/", "written", 20, 20, 8)])
    fed(spark, tmp_path, make, [older])
    assert current() == [("/a", 7), ("/c", 8)]
    feed = fed(spark, tmp_path, make, [events(spark, [(6, "/a", "/", "deleted", 30, 9, 0)]), end(spark, 10**6)])
    assert current() == [("/c", 8)]
    marks = spark.read.format("statestore").option("path", f"{tmp_path}/out-cp").option("stateVarName", "entry").load()
    assert sorted(r.path for r in marks.select("key.path").collect()) == ["", "/c"]  # marks of deletions went with the watermark
    assert sorted((r.path, r.event_id) for r in feed.collect()) == [("/a", 2), ("/a", 6), ("/b", 3), ("/c", 4), ("/c", 5)]


def test_renames_pair_nearest(spark):
    at = "event_id bigint, path string, dir string, kind string, ms bigint, m bigint, length bigint"
    rows = [
        (1, "/a", "", "created", 0, 1, 5), (2, "/a", "", "deleted", 1000, 1, 5), (3, "/b", "", "created", 1100, 1, 5), (4, "/c", "", "created", 1200, 1, 5),
        (5, "/b", "", "deleted", 3000, 1, 5), (6, "/d", "", "created", 2800, 1, 5), (7, "/x", "", "deleted", 3000, 1, 6), (8, "/y", "", "created", 3251, 1, 6),
        (9, "/d", "", "deleted", 9000, 1, 5), (10, "/d", "", "created", 9001, 1, 5), (11, "/e", "", "written", 0, 1, 9), (12, "/p", "", "deleted", 64 * 250, 2, 2),
        (13, "/q", "", "created", 64 * 250 - 1, 2, 2),
    ]
    df = spark.createDataFrame(rows, at).selectExpr("event_id", "path", "dir", "kind", "timestamp_millis(ms)::timestamp_ntz AS ts", "m AS mtime", "length").repartition(4)
    pairs = {(r.old_path, r.new_path, r.deleted_id, r.created_id) for r in watch.renames(df).collect()}
    assert pairs == {("/a", "/b", 2, 3), ("/b", "/d", 5, 6), ("/p", "/q", 12, 13)}
    got = {(r.entry_id, r.path, r.renamed) for r in watch.entries(df).collect()}
    assert got == {(1, "/d", 2), (4, "/c", 0), (8, "/y", 0), (11, "/e", 0), (13, "/q", 0)} or got == {(10, "/d", 0), (4, "/c", 0), (8, "/y", 0), (11, "/e", 0), (13, "/q", 0)}
    assert watch.entries(df.limit(0)).count() == 0


def test_watch_folder_sees_new_pictures_only(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        stream = watch.watch_folder(spark, str(folder), ["jpg"])
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r["path"].rsplit("/", 1)[1] for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect())

    (folder / "a.jpg").write_bytes(b"1")
    (folder / "b.txt").write_bytes(b"2")
    assert run() == ["a.jpg"]
    (folder / "c.JPG").write_bytes(b"3")
    assert run() == ["a.jpg", "c.JPG"]


def test_a_fresh_file_arrives_in_a_later_run(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    got = []

    def run():
        watch.take_settled(spark, str(folder), str(tmp_path / "seen"), lambda df: got.extend(r["path"].rsplit("/", 1)[1] for r in df.collect()), ["jpg"], 1000)
        return sorted(got)

    (folder / "old.jpg").write_bytes(b"1")
    os.utime(folder / "old.jpg", (time.time() - 60, time.time() - 60))
    (folder / "fresh.jpg").write_bytes(b"2")
    os.utime(folder / "fresh.jpg", (time.time() + 6, time.time() + 6))
    assert run() == ["old.jpg"]
    time.sleep(max(0, os.path.getmtime(folder / "fresh.jpg") + 2 - time.time()))
    assert run() == ["fresh.jpg", "old.jpg"]
    assert run() == ["fresh.jpg", "old.jpg"]


def test_settle_delay_holds_back_fresh_files(spark, tmp_path):
    (tmp_path / "old.jpg").write_bytes(b"1")
    os.utime(tmp_path / "old.jpg", (time.time() - 60, time.time() - 60))
    (tmp_path / "new.jpg").write_bytes(b"2")
    os.utime(tmp_path / "new.jpg", (time.time() + 60, time.time() + 60))
    df = spark.read.format("binaryFile").load(str(tmp_path))
    assert [r["path"].rsplit("/", 1)[1] for r in watch.settled(df).collect()] == ["old.jpg"]

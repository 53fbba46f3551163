"""Hot groups: a third or more of all rows in one group, results whole and exact."""

from pyspark.sql import Window
from pyspark.sql import functions as F

import pytest

from pixelquarry import session
from pixelquarry.operators import catalog as cat
from pixelquarry.operators import params as par
from pixelquarry.operators import scaling
from pixelquarry.operators.scaling import attach_per_image, broadcast_if_small, join_hot_keys, number_rows, shifted, write_tiled
from pixelquarry.streaming import watch


def skewed(spark, n=6000):
    return spark.range(n).selectExpr("id", "IF(id % 3 < 2, 'hot', concat('g', id % 50)) AS g", "(id * 7919) % 1009 AS k")


def test_number_rows_equals_a_plain_window(spark):
    df = skewed(spark)
    ours = number_rows(df, ["g"], [F.col("k").desc(), F.col("id")], total="n", ends={"first": ("first", "id"), "last": ("last", "id")})
    w = Window.partitionBy("g").orderBy(F.col("k").desc(), F.col("id"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    plain = df.withColumns({"pos": F.row_number().over(w).cast("bigint"), "n": F.count("*").over(Window.partitionBy("g")), "first": F.first("id").over(whole), "last": F.last("id").over(whole)})
    columns = ["id", "g", "k", "pos", "n", "first", "last"]
    assert sorted(map(tuple, ours.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))


def test_number_rows_spreads_a_hot_group(spark):
    df = skewed(spark, 40_000)
    numbered = number_rows(df, ["g"], [F.col("k"), F.col("id")])
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    # the only windows left run over the per-partition counts
    assert "row_number" not in plan


def test_number_rows_of_an_empty_table(spark):
    assert number_rows(skewed(spark).filter("id < 0"), ["g"], [F.col("id")]).count() == 0


def test_shifted_crosses_chunks(spark):
    df = skewed(spark, 1000)
    numbered = number_rows(df, ["g"], [F.col("id")])
    ours = shifted(numbered, ["g"], {"a": ("id", 3), "b": ("id", -2)}, chunk_rows=7)
    w = Window.partitionBy("g").orderBy("id")
    plain = df.withColumns({"a": F.lead("id", 3).over(w), "b": F.lag("id", 2).over(w)})
    assert sorted(map(str, ours.select("id", "a", "b").collect())) == sorted(map(str, plain.select("id", "a", "b").collect()))
    # a distance larger than the chunk widens the chunk
    far = shifted(numbered, ["g"], {"a": ("id", 50)}, chunk_rows=7)
    assert sorted(map(str, far.select("id", "a").collect())) == sorted(map(str, df.select("id", F.lead("id", 50).over(w).alias("a")).collect()))


def test_join_hot_keys_equals_a_plain_join(spark):
    left = skewed(spark).withColumnRenamed("g", "key")
    right = spark.createDataFrame([("hot", 1), ("g1", 2), ("g7", 3), ("unused", 4)], "key string, v int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        ours = join_hot_keys(left, right, ["key"], how, hot_rows=100)
        plain = left.join(right, ["key"], how)
        assert ours.columns == plain.columns
        assert sorted(map(str, ours.collect())) == sorted(map(str, plain.collect()))


def test_join_hot_keys_splits_the_hot_key(spark):
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        left = skewed(spark).withColumnRenamed("g", "key")
        right = spark.createDataFrame([("hot", 1)], "key string, v int")
        joined = join_hot_keys(left, right, ["key"], "inner", hot_rows=100)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 4000 and len(sizes) == 8 and max(sizes) < 1600
    finally:
        for key in ("spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled"):
            spark.conf.unset(key)


def test_attach_per_image_tiles_a_large_image(spark):
    big = spark.range(100 * 90).selectExpr("1L AS image_id", "100 AS w", "90 AS h", "cast(id % 100 AS int) AS x", "cast(id div 100 AS int) AS y")
    small = spark.range(4).selectExpr("2L AS image_id", "2 AS w", "2 AS h", "cast(id % 2 AS int) AS x", "cast(id div 2 AS int) AS y")
    facts = spark.createDataFrame([(1, 100, 90, "a"), (2, 2, 2, "b")], "image_id bigint, w int, h int, v string")
    out = attach_per_image(big.unionByName(small), facts, tile_pixels=1000)
    assert out.columns == ["image_id", "w", "h", "x", "y", "v"]
    assert {(r["image_id"], r["v"], r["count"]) for r in out.groupBy("image_id", "v").count().collect()} == {(1, "a", 9000), (2, "b", 4)}


def test_tiled_tables_join_without_moving_pixels(spark, tmp_path):
    px = spark.range(5000).selectExpr("id div 2500 AS image_id", "50 AS w", "50 AS h", "cast(id % 50 AS int) AS x", "cast(id % 2500 div 50 AS int) AS y")
    table = write_tiled(px, "tiled_pixels", 4, str(tmp_path / "t"), tile_pixels=500)
    facts = spark.createDataFrame([(0, 50, 50, "a"), (1, 50, 50, "b")], "image_id bigint, w int, h int, v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        out = attach_per_image(table, facts, tile_pixels=500)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1
        assert {(r["image_id"], r["v"], r["count"]) for r in out.groupBy("image_id", "v").count().collect()} == {(0, "a", 2500), (1, "b", 2500)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE tiled_pixels")


def test_broadcast_only_within_the_bound(spark):
    df = spark.range(10)
    assert broadcast_if_small(df, 9) is df
    assert broadcast_if_small(df, 10) is not df


def test_merge_keeps_one_row_per_key_with_hot_keys(spark):
    store = spark.createDataFrame([(1, 0, "old"), (0, 1, "reserved")], "hash bigint, seq bigint, v string")
    extra = spark.range(1000).selectExpr("IF(id % 2 = 0, 1L, id) AS hash", "id + 10 AS seq", "cast(id AS string) AS v")
    keep = {r["hash"]: r["v"] for r in par.merge(store, extra, True).collect()}
    over = {r["hash"]: r["v"] for r in par.merge(store, extra, False).collect()}
    # hash 1 is also id 1 of the import (first), the last even id is 998
    assert keep[1] == "old" and over[1] == "998" and 0 not in keep and 0 not in over
    assert len(keep) == len(over) == 500
    again = par.upsert(par.upsert(store, extra), extra)
    assert {r["hash"]: r["v"] for r in again.collect()} == over


def test_duplicates_in_a_third_of_all_files(spark):
    files = spark.range(3000).selectExpr("concat('/p/', id) AS path", "IF(id % 3 = 0, 9L, id + 100) AS hash")
    out = cat.duplicate_content(files, hot_rows=50)
    assert out.count() == 1000 and out.select("copies").distinct().first()[0] == 1000


def test_throttle_matches_a_plain_walk(spark):
    import random

    rng = random.Random(3)
    rows, t = [], {"hot": 0, "b": 0}
    for i in range(3000):
        d = "hot" if rng.random() < 0.9 else "b"
        t[d] += rng.choice([0, 1, 7, 90, 300, 700, 2000])
        rows.append((i, d, t[d]))
    df = spark.createDataFrame(rows, "event_id bigint, dir string, ms bigint").selectExpr("event_id", "dir", "timestamp_millis(ms) AS ts")

    def walk(rows, free):
        passed = []
        for i, d, ms in sorted(rows, key=lambda r: (r[2], r[0])):
            if ms >= free.get(d, -1):
                passed.append(i)
                free[d] = ms + 500
        return passed

    for chunk in (5, 64, 10_000):
        got = sorted(r["event_id"] for r in watch.throttle(df, 500, chunk_rows=chunk).select("event_id").collect())
        assert got == sorted(walk(rows, {}))
    # state from an earlier batch
    last = df.filter("event_id < 0").select("dir", "ts").union(spark.sql("SELECT 'hot' AS dir, timestamp_millis(40) AS ts"))
    got = sorted(r["event_id"] for r in watch.throttle(df, 500, last, chunk_rows=5).select("event_id").collect())
    assert got == sorted(walk(rows, {"hot": 540}))


def test_walks_and_neighbours_of_a_hot_folder(spark):
    files = spark.range(2000).selectExpr("IF(id % 3 < 2, '/a/hot', concat('/a/d', id % 7)) AS dir", "concat('File', id, '.jpg') AS title").withColumn(
        "path", F.concat("dir", F.lit("/"), "title"))
    near = cat.next_prev(files)
    hot = {r["title"]: r for r in near.filter("dir = '/a/hot'").collect()}
    # File9 comes before File10, and the ends wrap
    assert hot["File9"  ".jpg"]["next"] == "/a/hot/File10.jpg"
    assert hot["File0.jpg"]["prev"] == "/a/hot/File1999.jpg" and hot["File1999.jpg"]["next"] == "/a/hot/File0.jpg"
    stay = {r["title"]: r for r in cat.next_prev(files, wrap=False).filter("dir = '/a/hot'").collect()}
    assert stay["File0.jpg"]["prev"] == "/a/hot/File0.jpg"


def test_hot_and_null_keys_are_spread_and_nothing_is_lost(spark):
    left = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 THEN NULL ELSE id END AS k", "id")
    right = spark.createDataFrame([(1, "hot"), (2, "two"), (None, "none")], "k bigint, v string")
    joined = scaling.join_hot_keys(left, right, ["k"], "left", hot_rows=100)
    assert joined.count() == 6000 and joined.filter("v = 'hot'").count() == 2000 and joined.filter("v = 'none'").count() == 0
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], "-1")
        spark.conf.set(names[1], "false")
        sizes = [r["n"] for r in scaling.join_hot_keys(left, right, ["k"], "left", hot_rows=100).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert len(sizes) >= 4 and max(sizes) <= 2 * 6000 / len(sizes)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.shared_folder(Session())

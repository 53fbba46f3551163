"""Steps whose plan must not gather what grows with the tables: in the driver, in one task, or row by row."""

import pytest

from pixelquarry.plans import params_queries, pixel_queries, strings_queries, views

NATION, PART = "n_nationkey bigint, n_name string", "p_partkey bigint, p_name string, p_size int"


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame([(0, "AA"), (1, "BB")], NATION).coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(i, f"part {i}", i % 50) for i in range(400)], PART).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i, "M") for i in range(30)], "c_custkey bigint, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["placeholder_check", "strings_reconcile", "translate_lookup", "translation_progress"])
def test_lists_of_texts_are_not_broadcast(spark, tables, name):
    df = strings_queries.R.queries[name](spark, tables)
    before = plan(df)
    assert "SortMergeJoin" in before
    assert "key" not in "".join(line for line in before.splitlines() if "BroadcastExchange" in line)
    for line_no, line in enumerate(lines := before.splitlines()):
        if "BroadcastExchange" in line:
            assert not any("p_partkey" in below for below in lines[line_no + 1 : line_no + 4]), before
    assert df.count() > 0


def test_curves_are_made_once_a_pair(spark, tables):
    df = pixel_queries.R.queries["lut_contrast_gamma"](spark, tables)
    below = plan(df).split("HashAggregate", 1)[1]
    assert "lambda" not in below, below[:3000]
    assert df.count() == 256 * df.select("contrast", "gamma").distinct().count()


def test_rows_made_of_a_small_file_are_spread(spark, tables, monkeypatch):
    assert views.settings(spark, tables).rdd.getNumPartitions() == 1
    monkeypatch.setattr(views.spread_rows, "__defaults__", (1, 50))
    assert views.settings(spark, tables).rdd.getNumPartitions() == 6
    assert strings_queries.catalog_lines(spark, tables).rdd.getNumPartitions() > 6
    assert params_queries.R.queries["settings_source"](spark, tables).count() > 30


def test_files_of_documents_are_named_as_spark_names_them(spark, tmp_path):
    from pixelquarry.plans import catalog_queries

    rows = [(1, "en", "a b", "one"), (1, "en", "a b", "one"), (2, None, "x/y:z", "two\nlines"), (3, "", "50%", None)]
    spark.createDataFrame(rows, "doc_id bigint, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted([("txt", 6, "source=a b"), ("txt", 6, "source=a b"), ("txt", 12, "source=x%2Fy%3Az"), ("txt", 2, "source=50%25")])
    assert sorted(map(tuple, catalog_queries.catalog_scan(spark, str(tmp_path)).collect())) == want
    assert sorted((e, s, f) for e, s, _, f in map(tuple, catalog_queries.catalog_scan_recursive(spark, str(tmp_path)).collect())) == want


def test_folder_listed_by_tasks_gives_what_the_reader_gives(spark, tmp_path):
    from pixelquarry.sources import files

    for name in ("a=1/x.jpg", "a=1/.x.jpg.crc", "a=1/_tmp.jpg", "a=1/sub/y.jpg", "b=2/z.JPG", "top.jpg", "_gone/w.jpg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    for glob, deep in (("/*=*", False), ("/*=*", True), ("", True), ("/*.jpg", False)):
        got = files.scan_folder(spark, tmp_path.as_uri() + glob, ["jpg"], deep)
        want = files.scan_folder(spark, str(tmp_path) + glob, ["jpg"], deep)  # no URI: Spark's reader
        assert got.dtypes == want.dtypes
        by_ms = lambda df: sorted((r.path, r.size, r.title, r.ext, r.mtime.replace(microsecond=0)) for r in df.collect())
        assert by_ms(got) == by_ms(want), glob


def test_lists_are_not_gathered(spark, tmp_path, monkeypatch):
    from pixelquarry.plans import catalog_queries

    orders = [(i, i % 12, "1-HIGH") for i in range(300)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderpriority string").selectExpr(
        "*", "CAST(100 AS double) AS o_totalprice", "TIMESTAMP_NTZ'1995-01-01 00:00:00' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    seen = []
    real = catalog_queries.materialise
    monkeypatch.setattr(catalog_queries, "materialise", lambda df: seen.append(plan(df)) or real(df))
    got = [tuple(r) for r in catalog_queries.playlist_files(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) >= 300
    assert all("line" not in p.split("FlatMapGroupsInPandas", 1)[1].splitlines()[0] for p in seen if "FlatMapGroupsInPandas" in p)
    assert any("rangepartitioning(list_id" in p for p in seen)


def test_watched_files_stay_small(spark, tmp_path, monkeypatch):
    from pixelquarry.plans import source_queries

    spark.createDataFrame([(i, "x" * 100) for i in range(100)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert source_queries._watched(spark, str(tmp_path)).count() == 4
    monkeypatch.setattr(source_queries, "WATCHED_BYTES", 1000)
    sizes = [r.length for r in source_queries._watched(spark, str(tmp_path)).collect()]
    assert len(sizes) == 11 and max(sizes) < 2000


def test_small_chunks_reach_python_in_bundles(spark, monkeypatch):
    import datetime

    from pixelquarry.streaming import watch

    start = datetime.datetime(2024, 1, 1)
    rows = [(i, f"/d{i % 2}", start + datetime.timedelta(milliseconds=i * i % 9001)) for i in range(600)]
    events = spark.createDataFrame(rows, "event_id bigint, dir string, ts timestamp_ntz")
    want, free = [], {}
    for i, d, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        if d not in free or ts >= free[d]:
            want.append(i)
            free[d] = ts + datetime.timedelta(milliseconds=70)
    seen = []
    real = watch.materialise
    monkeypatch.setattr(watch, "materialise", lambda df: seen.append(plan(df)) or real(df))
    for rows_each, fan, limit in ((1, 2, 8), (3, 2, 8), (3, 32, 1 << 16), (16, 32, 64)):
        monkeypatch.setattr(watch, "CHUNK_ROWS", limit)
        assert sorted(r.event_id for r in watch.throttle(events, 70, chunk_rows=rows_each, fan=fan).collect()) == sorted(want)
    assert all("bundle" in p for p in seen)


def test_near_duplicates_meet_by_fingerprints_first(spark, monkeypatch):
    from pixelquarry.llm import simhash

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join([*words[:i], f"new{i}", *words[i + 1 :]]) for i in range(3, 43)] + [f"other text number {i} alone" for i in range(9)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    met, real = [], simhash.fingerprint_pairs
    monkeypatch.setattr(simhash, "fingerprint_pairs", lambda *a: met.append(real(*a)) or met[0])
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == [0, *range(40, 49)]
    assert 0 < met[0].count() < len(texts)


def test_what_follows_is_not_gone_through_for_every_row(spark):
    import datetime

    from pixelquarry.streaming import watch

    start = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(120):  # one identity, many copies at the same time
        at = start + datetime.timedelta(milliseconds=1000 * (i // 40))
        rows += [(4 * i, f"/a{i}", "deleted", at, 7), (4 * i + 1, f"/b{i}", "created", at + datetime.timedelta(milliseconds=i % 40), 7)]
    events = spark.createDataFrame(rows, "event_id bigint, path string, kind string, ts timestamp_ntz, length bigint").withColumn("mtime", watch.F.col("ts").cast("date"))
    found = watch.renames(events)
    assert "unboundedfollowing" not in plan(found).lower()
    got = sorted((r.deleted_id, r.created_id) for r in found.collect())
    made, gone = [r for r in rows if r[2] == "created"], [r for r in rows if r[2] == "deleted"]
    near = lambda r, others: min(((abs(r[3] - o[3]), o[3], o[0]) for o in others if abs(r[3] - o[3]) <= datetime.timedelta(milliseconds=250)), default=None)
    best = {r[0]: near(r, made) for r in gone}
    back = {r[0]: near(r, gone) for r in made}
    assert got == sorted((d, b[2]) for d, b in best.items() if b and back[b[2]][2] == d) and got

"""Photo-shaped views over the shared tables, for Spark and for DuckDB.

There are no image files among the shared tables, so each view computes rows of
one data format (file list, pixels, stored parameters, ...) from them. Both
texts of a view give the same rows; every size grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquarry.operators.scaling import spread_rows

FOLDERS = 20
LANGUAGES = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .selectExpr(
            "o_orderkey AS file_id",
            "o_custkey",
            "concat('/photos/', year(o_orderdate), '/', substr(o_orderpriority, 1, 1)) AS dir",
            "element_at(array('jpg','JPEG','png','tif','tiff','gif','nef','txt'), cast(o_orderkey % 8 AS int) + 1) AS ext",
            "cast(floor(o_totalprice * o_totalprice / 100) AS bigint) AS size",
            "o_orderdate AS mtime",
            "o_orderdate - make_dt_interval(cast(o_orderkey % 30 AS int), cast(o_orderkey % 24 AS int), cast(o_custkey % 60 AS int)) AS ctime",
            "o_orderkey % 3 <> 0 AS selected",
        )
        .withColumn("title", F.expr("concat('IMG', file_id, '.', ext)"))
        .withColumn("path", F.expr("concat(dir, '/', title)"))
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 images, one per embedding vector."""
    return (
        table(spark, sf_dir, "embeddings")
        .selectExpr("vec_id AS image_id", "label", "posexplode(embedding) AS (p, e)")
        .selectExpr("image_id", "label", "p", "cast(floor(cast(e AS double) * 1000) AS int) AS v")
        .selectExpr(
            "image_id", "label", "8 AS w", "8 AS h", "p % 8 AS x", "cast(p div 8 AS int) AS y",
            "pmod(v, 256) AS b", "pmod(v * 7 + 31 * p, 256) AS g", "pmod(v * 13 + 17 * p, 256) AS r",
        )
    )


def pixels32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32x32 images, sixteen consecutive vectors per image; the last one is filled up with vectors of zeros."""
    src = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "embedding")
    last = src.agg(F.max("vec_id").alias("m")).filter("m % 16 <> 15")
    rest = last.select(F.explode(F.expr("sequence(m + 1, m div 16 * 16 + 15)")).alias("vec_id")).withColumn("embedding", F.expr("array_repeat(cast(0 AS float), 64)"))
    return (
        src.withColumn("embedding", F.col("embedding").cast("array<float>")).unionByName(rest)
        .selectExpr("vec_id", "posexplode(embedding) AS (p, e)")
        .selectExpr("vec_id", "p", "cast(floor(cast(e AS double) * 1000) AS int) AS v", "cast(vec_id % 16 AS int) AS t")
        .selectExpr(
            "vec_id div 16 AS image_id", "32 AS w", "32 AS h",
            "(t % 4) * 8 + p % 8 AS x", "cast((t div 4) * 8 + p div 8 AS int) AS y",
            "pmod(v, 256) AS b", "pmod(v * 7 + 31 * p, 256) AS g", "pmod(v * 13 + 17 * p, 256) AS r",
        )
    )


def pixel_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels without coordinates, for statistics at table scale."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS image_id",
        "cast(l_partkey % 256 AS int) AS b",
        "cast(l_orderkey % 256 AS int) AS g",
        "cast(floor(l_quantity) * 5 % 256 AS int) AS r",
    )


_PARAM_VALUES = [
    "(p_size % 21) / 20.0D - 0.5D AS contrast",
    "0.1D + (p_size % 50) * 0.06D AS gamma",
    "(p_partkey % 41) / 20.0D AS saturation",
    "(p_size % 11) / 20.0D AS sharpen",
    "(p_partkey % 17) / 16.0D AS lighten_shadows",
    "(p_partkey % 13) / 12.0D AS darken_highlights",
    "cast(p_partkey % 256 AS int) AS flags",
    "cast((p_partkey * 37) % 36000 AS int) AS rot100",
]


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS hash", "p_partkey * 2 AS seq", *_PARAM_VALUES)


def params_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second store: shifted keys, every fifth row twice with another contrast, one key 0 row."""
    return (
        table(spark, sf_dir, "part")
        .withColumn("copy", F.explode(F.expr("IF(p_partkey % 5 = 0, array(0, 1), array(0))")))
        .selectExpr(
            "IF(p_partkey = 3, 0L, p_partkey + 100) AS hash",
            "p_partkey * 2 + copy AS seq",
            *[v.replace("(p_size % 21)", "((p_size + 3 + copy) % 21)") for v in _PARAM_VALUES],
        )
    )


def exif(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).selectExpr(
        "o_orderkey AS image_id",
        "o_orderdate AS mtime",
        "IF(o_custkey % 9 = 8, '', concat('Maker', o_custkey % 5, ' Corp')) AS make",
        "IF(o_custkey % 2 = 0, concat('Maker', o_custkey % 5, ' X'), 'X1') AS model",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '0000:00:00 00:00:00' "
        "WHEN o_orderkey % 13 = 0 THEN concat(year(o_orderdate), ':', month(o_orderdate), ':', day(o_orderdate)) "
        "WHEN o_orderkey % 5 = 0 THEN concat(year(o_orderdate), ':', month(o_orderdate), ':', day(o_orderdate), ' ', o_orderkey % 24, ':', o_custkey % 60, ':', o_orderkey % 60) "
        "ELSE concat(year(o_orderdate), ':', lpad(cast(month(o_orderdate) AS string), 2, '0'), ':', lpad(cast(day(o_orderdate) AS string), 2, '0'), ' 10:20:30') END AS date_raw",
        "o_orderkey % 50 AS exposure_num",
        "(o_custkey % 6) * 10 AS exposure_den",
        "cast(o_orderkey % 9 AS int) AS orientation",
        "cast(100 + o_orderkey % 400 AS int) AS width",
        "cast(100 + o_custkey % 300 AS int) AS height",
        "IF(o_orderkey % 4 = 0, -1, cast(10 + o_orderkey % 160 AS int)) AS thumb_w",
        "IF(o_orderkey % 4 = 0, -1, cast(10 + o_custkey % 120 AS int)) AS thumb_h",
        "IF(o_orderkey % 2 = 0, 'N', 'S') AS lat_ref",
        "IF(o_orderkey % 3 = 0, cast((o_orderkey * 37) % 90000 AS double) / 1000, cast(o_orderkey % 90 AS double)) AS lat_deg",
        "IF(o_orderkey % 3 = 0, 0D, cast(o_custkey % 60 AS double) + IF(o_orderkey % 3 = 1, 0.5D, 0D)) AS lat_min",
        "IF(o_orderkey % 3 = 2, cast(o_orderkey % 60 AS double), 0D) AS lat_sec",
        "IF(o_custkey % 2 = 0, 'E', 'W') AS lon_ref",
        "IF(o_orderkey % 3 = 0, cast((o_orderkey * 53) % 180000 AS double) / 1000, cast(o_custkey % 180 AS double)) AS lon_deg",
        "IF(o_orderkey % 3 = 0, 0D, cast(o_orderkey % 60 AS double) + IF(o_orderkey % 3 = 1, 0.25D, 0D)) AS lon_min",
        "IF(o_orderkey % 3 = 2, cast(o_custkey % 60 AS double), 0D) AS lon_sec",
        "o_custkey AS alt_num",
        "o_orderkey % 5 AS alt_den",
        "cast(o_orderkey % 2 AS int) AS alt_ref",
        "cast(o_orderkey % 32 AS int) AS flash",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'User comments' WHEN o_orderkey % 3 = 1 THEN '   ' ELSE concat('uc ', c_mktsegment) END AS user_comment",
        "IF(o_orderkey % 5 < 2, '', concat('desc ', c_mktsegment)) AS description",
        "IF(o_orderkey % 2 = 0, NULL, concat('jc ', c_mktsegment)) AS jpeg_comment",
    )


#: fixed values: file signatures as hex, by doc_id % 14 (the last entry is no signature)
MAGIC_HEX = [
    "FFD8", "89504E470D0A1A0A", "474946383961", "424D", "52494646000000005745425056503820", "FF0A",
    "00000018667479706176696600000000", "00000018667479706865696300000000", "00000018667479706372782000000000",
    "000000186674797031706963", "716F6966", "38425053", "49492A00", "",
]
BLOB_EXTENSIONS = ["jpg", "png", "gif", "bmp", "webp", "jxl", "avif", "heic", "cr2", "tiff", "dat", "psd"]


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of each document behind a signature; some once more, cut to their first bytes."""
    magic = ",".join(f"'{m}'" for m in MAGIC_HEX)
    ext = ",".join(f"'{e}'" for e in BLOB_EXTENSIONS)
    return (
        table(spark, sf_dir, "documents")
        .selectExpr(
            "explode(IF(doc_id % 25 IN (7, 9), array(0, 1), array(0))) AS copy", "doc_id",
            f"concat('f', doc_id, '.', element_at(array({ext}), cast(doc_id % 12 AS int) + 1)) AS name",
            f"concat(unhex(element_at(array({magic}), cast(doc_id % 14 AS int) + 1)), encode(text, 'UTF-8')) AS whole",
        )
        .selectExpr(
            "IF(copy = 1, -doc_id - 1, doc_id) AS doc_id", "IF(copy = 1, concat('short-', name), name) AS name",
            "CASE WHEN copy = 0 THEN whole WHEN doc_id % 25 = 7 THEN substring(whole, 1, 1) ELSE substring(whole, 1, 2 + cast(doc_id % 13 AS int)) END AS content",
        )
    )


def strings_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS seq",
        "concat(p_name, ' ', p_partkey, IF(p_partkey % 4 = 0, ' %d', ''), IF(p_partkey % 6 = 0, ' %s', ''), IF(p_partkey % 10 = 0, ' %filename%', '')) AS key",
    )


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations in all languages: some missing, some equal to the key, some with a lost placeholder, three stale keys each."""
    langs = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("lang"))
    parts = spread_rows(table(spark, sf_dir, "part").select("p_partkey"), LANGUAGES)
    # the keys grow with the table and are never sent to the driver; the languages fan out after they are met
    ref = strings_ref(spark, sf_dir).hint("merge")
    rows = (
        parts.join(ref, parts.p_partkey == ref.seq)
        .withColumn("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(LANGUAGES - 1))))
        .join(langs, "n_nationkey")
        .filter("(p_partkey + n_nationkey) % 9 <> 0")
        .selectExpr(
            "lang", "key",
            "CASE WHEN (p_partkey + n_nationkey) % 13 = 0 THEN key WHEN (p_partkey + n_nationkey) % 19 = 0 THEN '' "
            "WHEN (p_partkey + n_nationkey) % 17 = 0 THEN concat(lang, ' ', replace(replace(key, '%d', ''), '%s', '')) "
            "ELSE concat(lang, ' ', key) END AS value",
        )
    )
    stale = langs.select("lang", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i")).selectExpr(
        "lang", "concat('old key ', i) AS key", "concat(lang, ' old ', i) AS value"
    )
    return rows.unionByName(stale)


def playlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines of ten lists; list 7 holds one over-long line and list 8 repeats its lines."""
    return (
        catalog(spark, sf_dir)
        .withColumn("list_id", F.expr("o_custkey % 10"))
        .withColumn("copy", F.explode(F.expr("IF(list_id = 8, array(0, 1), array(0))")))
        .selectExpr(
            "list_id", "file_id * 2 + copy + 1 AS line_no",
            "CASE WHEN file_id % 7 = 0 THEN concat('\\\\\\\\host', replace(path, '/', '\\\\')) "
            "WHEN file_id % 5 = 0 THEN concat('\"C:', replace(path, '/', '\\\\'), '\" extra') "
            "WHEN file_id % 5 = 1 THEN concat('<img src=\"C:', replace(path, '/', '\\\\'), '\">') "
            "WHEN file_id % 5 = 2 THEN title "
            "WHEN file_id % 5 = 3 THEN concat('# note ', file_id) "
            "ELSE concat('X:\\\\gone\\\\', title, '<br>') END AS line0",
        )
        .selectExpr("list_id", "line_no", "IF(list_id = 7 AND line_no % 1001 = 3, rpad(line0, 600, 'x'), line0) AS line")
    )


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .selectExpr(
            "event_id", "ts", f"concat('/photos/', user_id % {FOLDERS}) AS dir", "event_type", "value",
        )
        .selectExpr(
            "event_id", "dir", "concat(dir, '/IMG', event_id % 200, '.jpg') AS path",
            "CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'written' END AS kind",
            "ts", "cast(date_trunc('HOUR', ts) AS timestamp_ntz) AS mtime", "cast(floor(value * 1000) AS bigint) AS length",
        )
    )


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are created once and renamed three times, each time by a deletion and a creation some milliseconds apart; some too far apart, some backwards."""
    return (
        table(spark, sf_dir, "events")
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(6))))
        .selectExpr(
            "event_id * 7 + step AS event_id", "concat('/photos/', user_id % 20) AS dir",
            "concat('/photos/', user_id % 20, '/F', event_id, '-', (step + 1) div 2, '.jpg') AS path",
            "IF(step % 2 = 0, 'created', 'deleted') AS kind",
            "event_id AS file", "step", "ts", "date_trunc('HOUR', ts) AS hour", "cast(floor(value * 10) AS bigint) AS length",
        )
        # deletion k at k seconds, its creation after it by up to 399 ms or, for every fifth file, before it
        .selectExpr(
            "event_id", "dir", "IF(kind = 'deleted', replace(path, concat('-', (step + 1) div 2), concat('-', (step - 1) div 2)), path) AS path", "kind",
            "timestampadd(MILLISECOND, cast(((step + 1) div 2) * 1000 + IF(step % 2 = 0 AND step > 0, IF(file % 5 = 0, -1, 1) * ((file * 37 + step) % 400), 0) AS int), ts) AS ts",
            "cast(hour AS timestamp_ntz) AS mtime", "length",
        )
    )


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw ``key=value`` lines of three layers for one profile per customer."""
    return (
        spread_rows(table(spark, sf_dir, "customer"), 10)
        .withColumn("line_no", F.explode(F.sequence(F.lit(1), F.lit(10))))
        .selectExpr(
            "c_custkey AS profile", "line_no",
            "CASE WHEN line_no <= 4 THEN 'default' WHEN line_no <= 7 THEN 'global' ELSE 'user' END AS layer",
            "CASE line_no "
            "WHEN 1 THEN 'Cores=2' WHEN 2 THEN 'Gamma = 1.0' WHEN 3 THEN 'AutoContrast=true' WHEN 4 THEN 'Language=en' "
            "WHEN 5 THEN concat('  Cores=', c_custkey % 30) "
            "WHEN 6 THEN IF(c_custkey % 3 = 0, 'AutoContrast=maybe', 'AutoContrast=FALSE') "
            "WHEN 7 THEN IF(c_custkey % 4 = 0, '', concat('Gamma=', c_custkey % 7, '.5')) "
            "WHEN 8 THEN IF(c_custkey % 5 = 0, 'Cores=99', 'Language=') "
            "WHEN 9 THEN IF(c_custkey % 2 = 0, concat('Language=', lower(c_mktsegment)), 'Gamma=oops') "
            "ELSE IF(c_custkey % 6 = 0, 'Language=last', '=nokey') END AS raw_line",
        )
    )


#: feature -> (include patterns, exclude patterns), in order
FOLDER_RULES = {
    "contrast": (["/photos/199*", "*/IMG1"], ["/photos/1995/*"]),
    "density": (["/photos/*/3/"], ["*.tif"]),
}

# --- DuckDB texts -----------------------------------------------------------------------------

_MOD = "((({0}) % 256) + 256) % 256"
_MAGIC_DUCK = ",".join(f"'{m}'" for m in MAGIC_HEX)
_EXT_DUCK = ",".join(f"'{e}'" for e in BLOB_EXTENSIONS)
_PARAMS_DUCK = """
  (p_size % 21) / 20.0::DOUBLE - 0.5::DOUBLE AS contrast, 0.1::DOUBLE + (p_size % 50) * 0.06::DOUBLE AS gamma,
  (p_partkey % 41) / 20.0::DOUBLE AS saturation, (p_size % 11) / 20.0::DOUBLE AS sharpen,
  (p_partkey % 17) / 16.0::DOUBLE AS lighten_shadows, (p_partkey % 13) / 12.0::DOUBLE AS darken_highlights,
  p_partkey % 256 AS flags, (p_partkey * 37) % 36000 AS rot100"""

DUCK: dict[str, str] = {
    "catalog": """
 SELECT *, dir || '/' || title AS path FROM (SELECT *, 'IMG' || file_id || '.' || ext AS title FROM (
  SELECT o_orderkey AS file_id, o_custkey, '/photos/' || year(o_orderdate) || '/' || substr(o_orderpriority, 1, 1) AS dir,
   (['jpg','JPEG','png','tif','tiff','gif','nef','txt'])[o_orderkey % 8 + 1] AS ext,
   floor(o_totalprice * o_totalprice / 100)::BIGINT AS size, o_orderdate AS mtime,
   o_orderdate - to_days((o_orderkey % 30)::INT) - to_hours((o_orderkey % 24)::INT) - to_minutes((o_custkey % 60)::INT) AS ctime,
   o_orderkey % 3 <> 0 AS selected FROM orders))""",
    "pixels": f"""
 SELECT image_id, label, 8 AS w, 8 AS h, p % 8 AS x, p // 8 AS y, {_MOD.format('v')} AS b,
  {_MOD.format('v * 7 + 31 * p')} AS g, {_MOD.format('v * 13 + 17 * p')} AS r FROM (
  SELECT vec_id AS image_id, label, p, floor(embedding[p + 1]::DOUBLE * 1000)::BIGINT AS v
  FROM (SELECT *, unnest(range(len(embedding))) AS p FROM embeddings))""",
    "pixels32": f"""
 SELECT vec_id // 16 AS image_id, 32 AS w, 32 AS h, (t % 4) * 8 + p % 8 AS x, (t // 4) * 8 + p // 8 AS y, {_MOD.format('v')} AS b,
  {_MOD.format('v * 7 + 31 * p')} AS g, {_MOD.format('v * 13 + 17 * p')} AS r FROM (
  SELECT vec_id, p, vec_id % 16 AS t, floor(embedding[p + 1]::DOUBLE * 1000)::BIGINT AS v
  FROM (SELECT *, unnest(range(len(embedding))) AS p FROM embeddings) UNION ALL
  SELECT vec_id, p, vec_id % 16, 0 FROM (SELECT unnest(range(m + 1, m // 16 * 16 + 16)) AS vec_id FROM (SELECT max(vec_id) AS m FROM embeddings)), range(64) t(p))""",
    "pixel_samples": """
 SELECT l_suppkey AS image_id, l_partkey % 256 AS b, l_orderkey % 256 AS g, (floor(l_quantity) * 5 % 256)::BIGINT AS r FROM lineitem""",
    "params": f" SELECT p_partkey AS hash, p_partkey * 2 AS seq, {_PARAMS_DUCK} FROM part",
    "params_import": f"""
 SELECT CASE WHEN p_partkey = 3 THEN 0 ELSE p_partkey + 100 END AS hash, p_partkey * 2 + copy AS seq,
 {_PARAMS_DUCK.replace('(p_size % 21)', '((p_size + 3 + copy) % 21)')}
 FROM (SELECT *, unnest(CASE WHEN p_partkey % 5 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM part)""",
    "exif": """
 SELECT o_orderkey AS image_id, o_orderdate AS mtime,
  CASE WHEN o_custkey % 9 = 8 THEN '' ELSE 'Maker' || (o_custkey % 5) || ' Corp' END AS make,
  CASE WHEN o_custkey % 2 = 0 THEN 'Maker' || (o_custkey % 5) || ' X' ELSE 'X1' END AS model,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '0000:00:00 00:00:00'
   WHEN o_orderkey % 13 = 0 THEN year(o_orderdate) || ':' || month(o_orderdate) || ':' || day(o_orderdate)
   WHEN o_orderkey % 5 = 0 THEN year(o_orderdate) || ':' || month(o_orderdate) || ':' || day(o_orderdate) || ' ' || (o_orderkey % 24) || ':' || (o_custkey % 60) || ':' || (o_orderkey % 60)
   ELSE strftime(o_orderdate, '%Y:%m:%d') || ' 10:20:30' END AS date_raw,
  o_orderkey % 50 AS exposure_num, (o_custkey % 6) * 10 AS exposure_den, o_orderkey % 9 AS orientation,
  100 + o_orderkey % 400 AS width, 100 + o_custkey % 300 AS height,
  CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE 10 + o_orderkey % 160 END AS thumb_w,
  CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE 10 + o_custkey % 120 END AS thumb_h,
  CASE WHEN o_orderkey % 2 = 0 THEN 'N' ELSE 'S' END AS lat_ref,
  CASE WHEN o_orderkey % 3 = 0 THEN ((o_orderkey * 37) % 90000)::DOUBLE / 1000 ELSE (o_orderkey % 90)::DOUBLE END AS lat_deg,
  CASE WHEN o_orderkey % 3 = 0 THEN 0::DOUBLE ELSE (o_custkey % 60)::DOUBLE + CASE WHEN o_orderkey % 3 = 1 THEN 0.5::DOUBLE ELSE 0::DOUBLE END END AS lat_min,
  CASE WHEN o_orderkey % 3 = 2 THEN (o_orderkey % 60)::DOUBLE ELSE 0::DOUBLE END AS lat_sec,
  CASE WHEN o_custkey % 2 = 0 THEN 'E' ELSE 'W' END AS lon_ref,
  CASE WHEN o_orderkey % 3 = 0 THEN ((o_orderkey * 53) % 180000)::DOUBLE / 1000 ELSE (o_custkey % 180)::DOUBLE END AS lon_deg,
  CASE WHEN o_orderkey % 3 = 0 THEN 0::DOUBLE ELSE (o_orderkey % 60)::DOUBLE + CASE WHEN o_orderkey % 3 = 1 THEN 0.25::DOUBLE ELSE 0::DOUBLE END END AS lon_min,
  CASE WHEN o_orderkey % 3 = 2 THEN (o_custkey % 60)::DOUBLE ELSE 0::DOUBLE END AS lon_sec,
  o_custkey AS alt_num, o_orderkey % 5 AS alt_den, o_orderkey % 2 AS alt_ref, o_orderkey % 32 AS flash,
  CASE WHEN o_orderkey % 3 = 0 THEN 'User comments' WHEN o_orderkey % 3 = 1 THEN '   ' ELSE 'uc ' || c_mktsegment END AS user_comment,
  CASE WHEN o_orderkey % 5 < 2 THEN '' ELSE 'desc ' || c_mktsegment END AS description,
  CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'jc ' || c_mktsegment END AS jpeg_comment
 FROM orders JOIN customer ON o_custkey = c_custkey""",
    "blobs": f"""
 SELECT CASE WHEN copy = 1 THEN -doc_id - 1 ELSE doc_id END AS doc_id, CASE WHEN copy = 1 THEN 'short-' || name ELSE name END AS name,
  CASE WHEN copy = 0 THEN whole WHEN doc_id % 25 = 7 THEN whole[1:1] ELSE whole[1:2 + doc_id % 13] END AS content FROM (
  SELECT unnest(CASE WHEN doc_id % 25 IN (7, 9) THEN [0, 1] ELSE [0] END) AS copy, doc_id, 'f' || doc_id || '.' || (([{_EXT_DUCK}])[doc_id % 12 + 1]) AS name,
   unhex(([{_MAGIC_DUCK}])[doc_id % 14 + 1]) || encode(text) AS whole FROM documents)""",
    "strings_ref": """
 SELECT p_partkey AS seq, p_name || ' ' || p_partkey || CASE WHEN p_partkey % 4 = 0 THEN ' %d' ELSE '' END
  || CASE WHEN p_partkey % 6 = 0 THEN ' %s' ELSE '' END || CASE WHEN p_partkey % 10 = 0 THEN ' %filename%' ELSE '' END AS key FROM part""",
    "strings": """
 SELECT n_name AS lang, key, CASE WHEN (seq + n_nationkey) % 13 = 0 THEN key WHEN (seq + n_nationkey) % 19 = 0 THEN ''
   WHEN (seq + n_nationkey) % 17 = 0 THEN n_name || ' ' || replace(replace(key, '%d', ''), '%s', '') ELSE n_name || ' ' || key END AS value
 FROM strings_ref, nation WHERE (seq + n_nationkey) % 9 <> 0
 UNION ALL SELECT n_name, 'old key ' || i, n_name || ' old ' || i FROM nation, range(1, 4) t(i)""",
    "playlist": r"""
 SELECT list_id, line_no, CASE WHEN list_id = 7 AND line_no % 1001 = 3 THEN rpad(line0, 600, 'x') ELSE line0 END AS line FROM (
  SELECT list_id, file_id * 2 + copy + 1 AS line_no,
   CASE WHEN file_id % 7 = 0 THEN '\\host' || replace(path, '/', '\')
    WHEN file_id % 5 = 0 THEN '"C:' || replace(path, '/', '\') || '" extra'
    WHEN file_id % 5 = 1 THEN '<img src="C:' || replace(path, '/', '\') || '">'
    WHEN file_id % 5 = 2 THEN title WHEN file_id % 5 = 3 THEN '# note ' || file_id ELSE 'X:\gone\' || title || '<br>' END AS line0
  FROM (SELECT *, unnest(CASE WHEN list_id = 8 THEN [0, 1] ELSE [0] END) AS copy FROM (SELECT *, o_custkey % 10 AS list_id FROM catalog)))""",
    "file_events": f"""
 SELECT event_id, dir, dir || '/IMG' || (event_id % 200) || '.jpg' AS path,
  CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'written' END AS kind,
  ts, date_trunc('hour', ts) AS mtime, floor(value * 1000)::BIGINT AS length
 FROM (SELECT *, '/photos/' || (user_id % {FOLDERS}) AS dir FROM events)""",
    "moves": """
 SELECT event_id * 7 + step AS event_id, '/photos/' || (user_id % 20) AS dir,
  '/photos/' || (user_id % 20) || '/F' || event_id || '-' || (CASE WHEN step % 2 = 0 THEN (step + 1) // 2 ELSE (step - 1) // 2 END) || '.jpg' AS path,
  CASE WHEN step % 2 = 0 THEN 'created' ELSE 'deleted' END AS kind,
  ts + to_milliseconds((((step + 1) // 2) * 1000 + CASE WHEN step % 2 = 0 AND step > 0 THEN (CASE WHEN event_id % 5 = 0 THEN -1 ELSE 1 END) * ((event_id * 37 + step) % 400) ELSE 0 END)::BIGINT) AS ts,
  date_trunc('hour', ts) AS mtime, floor(value * 10)::BIGINT AS length
 FROM (SELECT *, unnest(range(7)) AS step FROM events)""",
    "settings": """
 SELECT c_custkey AS profile, line_no, CASE WHEN line_no <= 4 THEN 'default' WHEN line_no <= 7 THEN 'global' ELSE 'user' END AS layer,
  CASE line_no WHEN 1 THEN 'Cores=2' WHEN 2 THEN 'Gamma = 1.0' WHEN 3 THEN 'AutoContrast=true' WHEN 4 THEN 'Language=en'
   WHEN 5 THEN '  Cores=' || (c_custkey % 30)
   WHEN 6 THEN CASE WHEN c_custkey % 3 = 0 THEN 'AutoContrast=maybe' ELSE 'AutoContrast=FALSE' END
   WHEN 7 THEN CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'Gamma=' || (c_custkey % 7) || '.5' END
   WHEN 8 THEN CASE WHEN c_custkey % 5 = 0 THEN 'Cores=99' ELSE 'Language=' END
   WHEN 9 THEN CASE WHEN c_custkey % 2 = 0 THEN 'Language=' || lower(c_mktsegment) ELSE 'Gamma=oops' END
   ELSE CASE WHEN c_custkey % 6 = 0 THEN 'Language=last' ELSE '=nokey' END END AS raw_line
 FROM (SELECT *, unnest(range(1, 11)) AS line_no FROM customer)""",
}
_NEEDS = {"strings": ["strings_ref"], "playlist": ["catalog"]}


def duck_with(views: list[str], sql: str) -> str:
    """Prefix ``sql`` with the common table expressions of the views it reads."""
    wanted: list[str] = []
    for view in views:
        for name in [*_NEEDS.get(view, []), view]:
            if name not in wanted:
                wanted.append(name)
    if not wanted:
        return sql
    # a view with a union would be put into every place that reads it, and joins over it be ordered without its size
    body = ",\n".join(f"{name} AS {'MATERIALIZED ' if name == 'pixels32' else ''}({DUCK[name]})" for name in wanted)
    sql = sql.lstrip()
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {body},\n{sql[15:]}"
    if sql.upper().startswith("WITH "):
        return f"WITH {body},\n{sql[5:]}"
    return f"WITH {body}\n{sql}"

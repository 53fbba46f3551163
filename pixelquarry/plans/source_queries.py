"""Queries over binary sources and streams. Spark derives the bytes and the event files from the tables."""

import uuid

from pyspark.sql import functions as F

from pixelquarry.plans import views
from pixelquarry.plans.registry import Registry
from pixelquarry.session import shared_folder
from pixelquarry.sources import exif_bytes, param_store
from pixelquarry.streaming import state, watch

R = Registry()


def le(value: str, size: int) -> str:
    """Hex text of an integer's little-endian bytes."""
    return "concat(" + ", ".join(f"substr(hex((shiftright(cast({value} AS bigint), {8 * k}) & 255) + 256), 2)" for k in range(size)) + ")"


def tag(code: int, kind: int, count: int, value: str) -> str:
    return f"concat({le(str(code), 2)}, {le(str(kind), 2)}, {le(str(count), 4)}, {value})"


def exif_files(s, d):
    """Small JPEG files whose EXIF block holds some of the metadata rows; every 17th has a broken camera pointer."""
    model = "hex(encode(rpad(model, 15, ' '), 'UTF-8')), '00'"
    parts = [
        "'49492A0008000000'", le("3", 2), tag(0x110, 2, 16, le("50", 4)), tag(0x112, 3, 1, f"concat({le('orientation', 2)}, '0000')"),
        tag(0x8769, 4, 1, le("IF(image_id % 17 = 0, 5000, 66)", 4)), le("0", 4), model,
        le("2", 2), tag(0x829A, 5, 1, le("96", 4)), tag(0x9209, 3, 1, f"concat({le('flash', 2)}, '0000')"), le("0", 4),
        le("exposure_num", 4), le("exposure_den", 4),
    ]
    comment = "encode(coalesce(jpeg_comment, ''), 'UTF-8')"
    body = (
        f"concat('FFD8', IF(image_id % 3 = 0, concat('FFFE', {le(f'(length({comment}) + 2) div 256', 1)}, {le(f'(length({comment}) + 2) % 256', 1)}, hex({comment})), ''), "
        f"'FFE10070', '457869660000', {', '.join(parts)}, 'FFDA0002', '0102030405060708')"
    )
    return views.exif(s, d).selectExpr("image_id", f"unhex({body}) AS content")


R.add("exif_extract", """SELECT image_id, orientation, rtrim(rpad(model, 15, ' ')) AS model, CASE WHEN image_id % 17 = 0 THEN NULL WHEN exposure_num = 0 OR exposure_den = 0 THEN exposure_num ELSE exposure_num // gcd(exposure_num, exposure_den) END AS exposure_num,
 CASE WHEN image_id % 17 = 0 THEN NULL WHEN exposure_num = 0 OR exposure_den = 0 THEN exposure_den ELSE exposure_den // gcd(exposure_num, exposure_den) END AS exposure_den, image_id % 17 <> 0 AS flash_present,
 CASE WHEN image_id % 17 = 0 THEN NULL ELSE flash END AS flash, CASE WHEN image_id % 3 = 0 THEN nullif(jpeg_comment, '') END AS jpeg_comment FROM exif""", "exif")(
    lambda s, d: exif_bytes.extract_exif(exif_files(s, d), "image_id").selectExpr(
        "image_id", "orientation", "rtrim(model) AS model", "exposure_num", "exposure_den", "flash_present", "flash", "jpeg_comment"))


def store_files(s, d, version: int):
    """Binary stores of up to 500 records each, packed by Spark from the parameter rows."""
    record = [le("hash", 8), *[le(f"(hash * {k} + {k}) % 256", 1) for k in range(2, 10)], le("flags", 1), *[le(str(9 + k), 1) for k in range(6)],
              le("hash % 1000", 2), le("1", 2), le("2", 2), le("3", 2), le("17", 1)]
    if version == 2:
        record += [le("18", 1), le("19", 1), le("hash % 256", 1), le("rot100", 2), "'000000'"]
    size = 40 if version == 2 else 32
    header = f"concat('0000000000000000', {le(str(param_store.MAGIC[0]), 4)}, {le(str(param_store.MAGIC[1]), 4)}, {le(str(version), 4)}, repeat('00', {size - 20}))"
    rows = views.params(s, d).selectExpr("hash", "hash div 500 AS store_id", f"concat({', '.join(record)}) AS rec")
    packed = rows.groupBy("store_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hash", "rec"))), lambda r: r["rec"]), "").alias("recs"))
    return packed.selectExpr(f"unhex(concat({header}, recs)) AS content")


_COLUMNS = ["hash", "contrast", "gamma", "flags", "yellow", "zoom_left", "zoom_bottom", "cyan_red", "magenta_green", "yellow_blue", "saturation", "angle"]
R.add("param_store_read", """SELECT hash, (hash * 2 + 2) % 256 AS contrast, (hash * 3 + 3) % 256 AS gamma, flags, 14 AS yellow, hash % 1000 AS zoom_left, 3 AS zoom_bottom, 17 AS cyan_red, 18 AS magenta_green, 19 AS yellow_blue,
 CASE WHEN hash % 256 > 127 THEN hash % 256 - 256 ELSE hash % 256 END AS saturation, rot100 AS angle FROM params WHERE hash <> 0""", "params")(
    lambda s, d: param_store.unpack_stores(store_files(s, d, 2)).select(*_COLUMNS))
R.add("param_store_upgrade", """SELECT hash, (hash * 2 + 2) % 256 AS contrast, (hash * 3 + 3) % 256 AS gamma, flags, 14 AS yellow, hash % 1000 AS zoom_left, 3 AS zoom_bottom, 128 AS cyan_red, 128 AS magenta_green, 128 AS yellow_blue,
 0 AS saturation, 0 AS angle FROM params WHERE hash <> 0""", "params")(
    lambda s, d: param_store.unpack_stores(store_files(s, d, 1)).select(*_COLUMNS))


@R.add("param_store_write", "SELECT hash, gamma, flags FROM params WHERE hash <> 0", "params")
def param_store_write(s, d):
    folder = f"{shared_folder(s)}/store-{uuid.uuid4().hex}"
    param_store.write_store(views.params(s, d), folder)
    return s.read.parquet(folder).select("hash", "gamma", "flags")


# --- streams ---------------------------------------------------------------------------------

SLICES = 3


def event_stream(s, d):
    """The file events as a stream of many files in shuffled order: a file has events of one slice of time and late ones of the slice before.

    Returns (stream, its folder, the watermark's delay that covers this). A last file holds one row past all times, so that the watermark passes all events.
    """
    base = f"{shared_folder(s)}/events-{uuid.uuid4().hex}"
    events = views.file_events(s, d)
    t = state.micros(events)
    low, high = events.select(F.min(t), F.max(t)).first()
    step = (high - low) // SLICES + 1
    arrives = F.floor((t - low) / step) + F.pmod(F.xxhash64("event_id"), F.lit(2))
    for i in range(SLICES + 1):
        events.filter(arrives == i).repartition(F.xxhash64("event_id")).write.mode("append").parquet(f"{base}/in")
    end = events.limit(1).withColumns({c: F.lit("") for c in ("path", "dir", "kind")}).withColumn("event_id", F.lit(-1).cast("bigint"))
    end = end.withColumn("ts", F.expr(f"timestampadd(MICROSECOND, {high + 3 * step}, TIMESTAMP_NTZ'1970-01-01 00:00:00')"))
    end.select(events.columns).write.mode("append").parquet(f"{base}/in")
    stream = s.readStream.schema(events.schema).option("maxFilesPerTrigger", 16).parquet(f"{base}/in")
    return stream, base, f"{2 * step // 1000 + 1} milliseconds"


def run_stream(rows, base):
    """All rows a stream gives until its input is used up."""
    writer = rows.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp")
    writer.trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{base}/out").filter("event_id >= 0")


_CHANGED = """SELECT event_id, path FROM (SELECT *, lag(mtime) OVER (PARTITION BY path ORDER BY ts, event_id) AS prev FROM file_events) WHERE prev IS NULL OR prev <> mtime"""


@R.add("watch_modified", _CHANGED, "file_events")
def watch_modified(s, d):
    stream, base, delay = event_stream(s, d)
    return run_stream(state.modified_stream(stream, delay), base)


R.add("watch_modified_batch", _CHANGED, "file_events")(lambda s, d: watch.changed_events(views.file_events(s, d)).select("event_id", "path"))

THROTTLE_TEST_MS = 400_000
_THROTTLED = f"""WITH RECURSIVE ev AS (SELECT event_id, dir, epoch_us(ts) AS t, row_number() OVER (PARTITION BY dir ORDER BY ts, event_id) AS pos FROM file_events),
 nx AS (SELECT e.dir, e.event_id, e.pos, min(n.pos) AS nxt FROM ev e LEFT JOIN ev n ON n.dir = e.dir AND n.t >= e.t + {THROTTLE_TEST_MS * 1000} GROUP BY 1, 2, 3),
 walk AS (SELECT dir, event_id, nxt FROM nx WHERE pos = 1 UNION ALL SELECT n.dir, n.event_id, n.nxt FROM walk w JOIN nx n ON n.dir = w.dir AND n.pos = w.nxt) SELECT event_id, dir FROM walk"""
R.add("throttle_changes", _THROTTLED, "file_events")(
    lambda s, d: watch.throttle(views.file_events(s, d), THROTTLE_TEST_MS, chunk_rows=16).select("event_id", "dir"))


@R.add("throttle_changes_stream", _THROTTLED, "file_events")
def throttle_changes_stream(s, d):
    stream, base, delay = event_stream(s, d)
    return run_stream(state.throttled_stream(stream, THROTTLE_TEST_MS, delay), base)


@R.add("catalog_upsert_stream", """SELECT path, dir, length, strftime(mtime, '%Y-%m-%d %H') AS hour FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS rn FROM file_events) WHERE rn = 1 AND kind <> 'deleted'""", "file_events")
def catalog_upsert_stream(s, d):
    stream, base, delay = event_stream(s, d)
    run_stream(state.catalog_stream(stream, delay), base)
    return state.read_catalog(s, f"{base}/cp").filter("path <> ''").select("path", "dir", "length", F.date_format("mtime", "yyyy-MM-dd HH").alias("hour"))


_PAIRS = f"""WITH d AS (SELECT * FROM moves WHERE kind = 'deleted'), c AS (SELECT * FROM moves WHERE kind = 'created'),
 p AS (SELECT d.path AS old_path, c.path AS new_path, d.event_id AS deleted_id, c.event_id AS created_id, d.ts AS d_ts, c.ts AS c_ts, abs(epoch_us(d.ts) - epoch_us(c.ts)) AS apart
  FROM d JOIN c USING (length, mtime) WHERE abs(epoch_us(d.ts) - epoch_us(c.ts)) <= {watch.RENAME_MS * 1000}),
 pairs AS (SELECT old_path, new_path, deleted_id, created_id FROM (SELECT *, row_number() OVER (PARTITION BY deleted_id ORDER BY apart, c_ts, created_id) AS rd,
  row_number() OVER (PARTITION BY created_id ORDER BY apart, d_ts, deleted_id) AS rc FROM p) WHERE rd = 1 AND rc = 1 AND old_path <> new_path)"""
R.add("catalog_renames", f"{_PAIRS} SELECT * FROM pairs", "moves")(lambda s, d: watch.renames(views.moves(s, d)))
R.add("catalog_entries", f"""{_PAIRS.replace("WITH ", "WITH RECURSIVE ", 1)},
 lives AS (SELECT *, last_value(CASE WHEN kind = 'created' THEN event_id END IGNORE NULLS) OVER (PARTITION BY path ORDER BY ts, event_id) AS life FROM moves),
 links AS (SELECT created_id AS life, l.life AS before FROM pairs JOIN lives l ON l.event_id = deleted_id WHERE l.life IS NOT NULL AND l.life <> created_id),
 walk AS (SELECT life, before, 1 AS hops FROM links UNION ALL SELECT w.life, k.before, hops + 1 FROM walk w JOIN links k ON k.life = w.before),
 first AS (SELECT life, max_by(before, hops) AS entry_id, max(hops) AS renamed FROM walk GROUP BY life),
 newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS rn FROM lives) WHERE rn = 1 AND kind <> 'deleted')
 SELECT coalesce(entry_id, n.life, event_id) AS entry_id, path, length, coalesce(renamed, 0) AS renamed FROM newest n LEFT JOIN first USING (life)""", "moves")(
    lambda s, d: watch.entries(views.moves(s, d)))


WATCHED_BYTES = 128 << 20


def _watched(s, d):
    """Watch a folder into which Spark wrote the documents as text files: four, or more where one would pass ``WATCHED_BYTES``."""
    base = f"{shared_folder(s)}/watch-{uuid.uuid4().hex}"
    lines = views.table(s, d, "documents").select(F.concat_ws(" ", "doc_id", "text").alias("line"))
    total = lines.agg(F.sum(F.octet_length("line").cast("bigint"))).first()[0] or 0
    lines.repartition(max(4, -(-total // WATCHED_BYTES))).write.text(f"{base}/in")
    stream = watch.watch_folder(s, f"{base}/in", ["txt"])
    query = (
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return s.read.schema(stream.schema).parquet(f"{base}/out").select("length", F.lower(F.substring_index("path", ".", -1)).alias("ext"))


R.add("watch_folder")(_watched)
R.add("settle_delay", """SELECT event_id FROM file_events WHERE mtime <= TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 250 MILLISECOND""", "file_events")(
    lambda s, d: watch.settled(views.file_events(s, d), watch.SETTLE_MS, "mtime + (current_timestamp()::timestamp_ntz - TIMESTAMP_NTZ'2024-01-10 00:00:00')").select("event_id"))

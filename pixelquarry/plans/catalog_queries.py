"""Queries over the file catalog, playlists and names."""

import re
import uuid

from pyspark.sql import functions as F

from pixelquarry.functions import formats, text
from pixelquarry.operators import catalog as cat
from pixelquarry.operators.scaling import number_rows, shifted
from pixelquarry.plans import views
from pixelquarry.plans.registry import Registry
from pixelquarry.session import materialise, shared_folder
from pixelquarry.sources import files, listing, playlist, text_lines

R = Registry()

NAT = """array_to_string(list_transform(regexp_extract_all(lower(title), '[0-9]+|[^0-9]+'), lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN lpad(r, 20, '0') ELSE r END), '')"""
LISTED = f"""listed AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY nat, path) AS pos, count(*) OVER (PARTITION BY dir) AS n
 FROM (SELECT *, {NAT} AS nat FROM catalog))"""


# --- sources ---------------------------------------------------------------------------------

def _shared_uri(s, name):
    """A new folder all tasks can reach, as a URI."""
    folder = f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"
    s.range(1).write.parquet(f"{folder}/where")
    return s.read.parquet(f"{folder}/where").inputFiles()[0].rsplit("/where", 1)[0]


_ESCAPED = re.compile("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]")


def _part_of(name, value):
    """Folder of a value, as Spark names it when it writes a table in parts."""
    return f"{name}=" + (_ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", value) if value else "__HIVE_DEFAULT_PARTITION__")


def _written_files(s, d):
    """A text file for every document, in folders by language and source. Each task writes its own files in place, so that nobody has to move them all."""
    root = f"{_shared_uri(s, 'scan')}/files"

    def write(batches):
        import pyarrow as pa
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(root)
        made = set()
        for batch in batches:
            for lang, source, n, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folder = f"{base}/{_part_of('lang', lang)}/{_part_of('source', source)}"
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                with fs.open_output_stream(f"{folder}/part-{n:015d}.txt") as f:
                    f.write(line + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    line = F.concat_ws(" ", "doc_id", "text").cast("binary").alias("line")
    rows = views.table(s, d, "documents").select("lang", "source", F.monotonically_increasing_id().alias("n"), line)
    rows.mapInArrow(write, "n bigint").write.format("noop").mode("overwrite").save()
    return root


_FILES = "SELECT 'txt' AS ext, strlen(concat_ws(' ', doc_id, text)) + 1 AS size, 'source=' || source AS folder"


@R.add("catalog_scan", f"{_FILES} FROM documents")
def catalog_scan(s, d):
    return files.scan_folder(s, f"{_written_files(s, d)}/lang=*/source=*", ["txt"]).select("ext", "size", text.title_of(F.col("dir")).alias("folder"))


@R.add("catalog_scan_recursive", f"{_FILES}, 2 AS depth FROM documents")
def catalog_scan_recursive(s, d):
    return listing.list_tree(s, _written_files(s, d), ["txt"]).select("ext", "size", "depth", text.title_of(F.col("dir")).alias("folder"))


R.add("supported_extensions", f"""WITH e AS (SELECT unnest([{','.join(f"'{e}'" for e in formats.BUILT_IN_ENDINGS)}]) AS ext
  UNION SELECT lower(x[3:]) FROM (SELECT unnest(string_split('*.hdp;*.wdp;x;*.nef', ';')) AS x) WHERE length(x) > 2)
 SELECT ext, count(*) AS n, sum(size)::BIGINT AS bytes FROM catalog WHERE lower(ext) IN (SELECT ext FROM e) GROUP BY 1""", "catalog")(
    lambda s, d: views.catalog(s, d).filter(F.lower("ext").isin(*formats.supported_endings("*.hdp;*.wdp;x", "*.nef")))
    .groupBy("ext").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")))

BY_EXT = """CASE WHEN e IN ('jpg','jpeg','jfif') THEN 'JPEG' WHEN e = 'bmp' THEN 'BMP' WHEN e = 'png' THEN 'PNG' WHEN e IN ('tif','tiff') THEN 'TIFF'
 WHEN e = 'webp' THEN 'WEBP' WHEN e = 'jxl' THEN 'JXL' WHEN e = 'avif' THEN 'AVIF' WHEN e IN ('heif','heic','hif') THEN 'HEIF' WHEN e = 'tga' THEN 'TGA'
 WHEN e = 'qoi' THEN 'QOI' WHEN e = 'psd' THEN 'PSD' WHEN e IN ('nef','cr2','dng') THEN 'RAW' ELSE 'UNKNOWN' END"""
R.add("format_by_extension", f"SELECT file_id, {BY_EXT} AS format FROM (SELECT *, lower(ext) AS e FROM catalog)", "catalog")(
    lambda s, d: views.catalog(s, d).select("file_id", formats.format_of_ending(F.col("ext")).alias("format")))

R.add("format_by_magic", f"""SELECT doc_id, CASE WHEN length(hx) < 4 THEN 'UNKNOWN' WHEN hx LIKE '424D%' THEN 'BMP' WHEN hx LIKE 'FFD8%' THEN 'JPEG'
  WHEN hx LIKE '89504E470D0A1A0A%' THEN 'PNG' WHEN hx LIKE '474946383761%' OR hx LIKE '474946383961%' THEN 'GIF' WHEN hx LIKE '52494646________57454250%' THEN 'WEBP'
  WHEN hx LIKE 'FF0A%' OR hx LIKE '0000000C4A584C200D0A870A%' THEN 'JXL' WHEN hx LIKE '________66747970617669%' THEN 'AVIF'
  WHEN hx LIKE '________667479706865_9%' OR hx LIKE '________66747970686576%' THEN 'HEIF' WHEN hx LIKE '________6674797063727820%' THEN 'RAW'
  WHEN hx LIKE '716F6966%' THEN 'QOI' WHEN hx LIKE '38425053%' THEN 'PSD' WHEN ({BY_EXT}) <> 'UNKNOWN' THEN {BY_EXT}
  WHEN hx LIKE '________66747970%' THEN 'AVIF' WHEN hx LIKE '49492A00%' OR hx LIKE '4D4D002A%' THEN 'TIFF' ELSE 'UNKNOWN' END AS format
 FROM (SELECT doc_id, hex(content[1:16]) AS hx, regexp_extract(name, '\\.([^.]*)$', 1) AS e FROM blobs)""", "blobs")(
    lambda s, d: views.blobs(s, d).select(
        "doc_id", formats.format_of_content(F.col("content"), text.extension_of(F.col("name"))).alias("format")))


@R.add("text_encoding_detect", """WITH u AS (SELECT doc_id, text, strlen(text) AS n8, flatten(list_transform(string_split(left(text, 64), ''), lambda c: CASE WHEN unicode(c) > 65535
   THEN [55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)] ELSE [unicode(c)] END)) AS us FROM documents),
 g AS (SELECT *, us[1:32] AS hd FROM u), f AS (SELECT *, 2 * len(hd) AS n16, list_sum(list_transform(hd, lambda v: CASE WHEN v & 255 <> 0 THEN 1 ELSE 0 END + CASE WHEN v < 256 THEN 1 ELSE 0 END)) AS good FROM g)
 SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN CASE WHEN 2 * len(us) + 2 >= 16 THEN 'UTF-16LE' ELSE 'ANSI' END WHEN 1 THEN CASE WHEN n8 + 3 >= 16 THEN 'UTF-8' ELSE 'ANSI' END WHEN 2 THEN 'UTF-8'
  WHEN 3 THEN CASE WHEN n16 >= 16 AND good > n16 * 2 // 3 THEN 'UTF-16LE' ELSE 'ANSI' END ELSE 'ANSI' END AS encoding FROM f""")
def text_encoding_detect(s, d):
    docs = views.table(s, d, "documents").selectExpr(
        "doc_id",
        "CASE doc_id % 5 WHEN 0 THEN concat(unhex('FFFE'), encode(text, 'UTF-16LE')) WHEN 1 THEN concat(unhex('EFBBBF'), encode(text, 'UTF-8')) "
        "WHEN 2 THEN encode(concat('<?xml version=\"1.0\" encoding=\"utf-8\"?>', text), 'UTF-8') WHEN 3 THEN encode(text, 'UTF-16LE') ELSE encode(text, 'UTF-8') END AS content",
    )
    return docs.select("doc_id", formats.text_encoding(F.col("content")).alias("encoding"))


R.add("utf8_validate", "SELECT doc_id, octet_length(content) > 0 AND TRY(decode(content)) IS NOT NULL AS valid FROM blobs", "blobs")(
    lambda s, d: views.blobs(s, d).selectExpr("doc_id", "length(content) > 0 AND is_valid_utf8(cast(content AS string)) AS valid"))

R.add("checksum_manifest", "SELECT sha256(content) || ' *' || name AS line FROM blobs", "blobs")(
    lambda s, d: files.checksum_manifest(views.blobs(s, d)))

R.add("size_guard", f"""WITH g AS (SELECT *, {BY_EXT} AS format FROM (SELECT *, lower(ext) AS e FROM catalog))
 SELECT image_id, CASE WHEN format = 'JPEG' AND size > 100000000 OR format = 'PNG' AND size > 50000000 THEN 'too many bytes' WHEN width > 480 OR height > 480 THEN 'side too long'
  WHEN width * height > 90000 THEN 'too many pixels' ELSE 'ok' END AS status FROM g JOIN exif ON file_id = image_id""", "catalog exif")(
    lambda s, d: cat.size_guard(
        views.catalog(s, d).select(F.col("file_id").alias("image_id"), "size", formats.format_of_ending(F.col("ext")).alias("format"))
        .join(views.exif(s, d).select("image_id", "width", "height"), "image_id"),
        max_bytes={"JPEG": 100_000_000, "PNG": 50_000_000}, max_pixels=90_000, max_side=480).select("image_id", "status"))

# --- playlists -------------------------------------------------------------------------------

LIST_FOLDER = "C:\\photos\\1995\\1"
CUT = """placed AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY list_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM playlist),
cut AS (SELECT list_id, line_no, CASE WHEN strlen(line) > {limit} - start THEN left(line, ({limit} - start)::INT) ELSE line END AS line FROM placed WHERE start < {limit})"""
ENTRIES = CUT.format(limit=2147483647) + r""",
good AS (SELECT * FROM cut),
ent AS (SELECT list_id, line_no, CASE WHEN instr(line, '\\') > 0 THEN regexp_extract(line[instr(line, '\\'):], '^([^\r\n"<]*)', 1)
  WHEN instr(line[2:], ':\') > 0 THEN regexp_extract(line[instr(line[2:], ':\'):], '^([^\r\n"<]*)', 1)
  WHEN regexp_matches(line, '\.(jpg|jpeg|png|tif|tiff|gif|nef)', 'i') THEN 'C:\photos\1995\1\' || regexp_extract(line, '([^"<>\r\n]*)$', 1) END AS name FROM good),
entries AS (SELECT * FROM ent WHERE name IS NOT NULL)"""
R.add("playlist_source", f"WITH {ENTRIES} SELECT * FROM entries", "playlist")(
    lambda s, d: playlist.playlist_entries(views.playlist(s, d), LIST_FOLDER, line_limit=None))

R.add("playlist_refused", "SELECT list_id, 'long line' AS reason FROM playlist WHERE length(line) >= 512 GROUP BY 1", "playlist")(
    lambda s, d: playlist.refused_lists(views.playlist(s, d), playlist.LINE_LIMIT))


def _list_files(s, d):
    """A file for every list: UTF-8 with and without a mark, UTF-16 with and without one, and single bytes of the Western European code page.

    Tasks write the parts of lists that lie in their range, then the bytes of each list's parts are copied one after the other, so no task holds a list.
    """
    root = _shared_uri(s, "lists")
    kinds = [(b"\xef\xbb\xbf", "utf-8"), (b"", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"", "utf-16-le"), (b"", "cp1252")]

    def write(batches):
        import pyarrow as pa
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(root)
        fs.create_dir(f"{base}/parts", recursive=True)
        now, f, written = None, None, []
        for batch in batches:
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key[:2] != now:
                    if f:
                        f.close()
                    now = key[:2]
                    written.append(now)
                    f = fs.open_output_stream(f"{base}/parts/{now[0]}-{now[1]}", buffer_size=1 << 16)
                f.write((key[2] + "\r\n").encode(kinds[now[0] % 5][1]))
        if f:
            f.close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in written], pa.int64()), pa.array([x[1] for x in written], pa.int32())], ["list_id", "part"])

    def join(rows):
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(root)
        at = int(rows["list_id"].iloc[0])
        with fs.open_output_stream(f"{base}/{at}.txt") as f:
            f.write(kinds[at % 5][0])
            for part in sorted(rows["part"]):
                with fs.open_input_stream(f"{base}/parts/{at}-{part}") as g:
                    while data := g.read(1 << 20):
                        f.write(data)
        return rows[["list_id"]].head(1)

    lines = views.playlist(s, d).withColumn("line", F.expr(ACCENT))
    ranged = lines.repartitionByRange("list_id", "line_no").sortWithinPartitions("list_id", "line_no")
    parts = materialise(ranged.select("list_id", F.spark_partition_id().alias("part"), "line").mapInArrow(write, "list_id bigint, part int"))
    materialise(parts.groupBy("list_id").applyInPandas(join, "list_id bigint"))
    return f"{root}/*.txt"


ACCENT = "IF(line_no % 4 = 0, replace(line, 'photos', 'ph\u00f6tos'), line)"


@R.add("playlist_files", f"""SELECT list_id, row_number() OVER (PARTITION BY list_id ORDER BY line_no) AS line_no, {ACCENT.replace("IF(", "CASE WHEN ").replace(" = 0, ", " = 0 THEN ", 1).replace("), line)", ") ELSE line END")} AS line FROM playlist""", "playlist")
def playlist_files(s, d):
    lines = text_lines.read_text(s, _list_files(s, d), range_bytes=1 << 14)
    number = F.regexp_extract("list_id", r"(\d+)\.txt$", 1).cast("bigint")
    return lines.select(number.alias("list_id"), "line_no", F.regexp_replace("line", "\r$", "").alias("line"))


R.add("take_first_kb", f"WITH {CUT.format(limit=2048)} SELECT * FROM cut", "playlist")(
    lambda s, d: playlist.first_kilobytes(views.playlist(s, d), 2).select("list_id", "line_no", "line"))


@R.add("playlist_resolve", f"""WITH {ENTRIES} SELECT list_id, line_no, path, size FROM entries JOIN catalog
  ON lower(path) = replace(regexp_replace(lower(name), '^c:', ''), '\\', '/')""", "playlist")
def playlist_resolve(s, d):
    names = playlist.playlist_entries(views.playlist(s, d), LIST_FOLDER, line_limit=None)
    local = names.withColumn("name", F.translate(F.regexp_replace("name", "(?i)^c:", ""), "\\", "/"))
    return cat.resolve_playlist(local, views.catalog(s, d), hot_rows=1000).select("list_id", "line_no", "path", "size")


# --- names -----------------------------------------------------------------------------------

R.add("path_split", r"""SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(path, '[^/]*$') AS title,
  regexp_extract(path, '\.([^.]*)$', 1) AS ext FROM catalog""", "catalog")(
    lambda s, d: views.catalog(s, d).select("path").select(
        "path", text.folder_of(F.col("path")).alias("folder"), text.title_of(F.col("path")).alias("title"),
        text.extension_of(text.title_of(F.col("path"))).alias("ext")))

GLOBS = "/PHOTOS/199*/2;;*/img1*.JPG;*nef;/photos/*5"
R.add("glob_match", r"""SELECT path, CASE WHEN regexp_matches(path, '^/photos/199.*?/2', 'i') THEN '/PHOTOS/199*/2' WHEN regexp_matches(path, '^.*?/img1.*?\.jpg', 'i') THEN '*/img1*.JPG'
  WHEN regexp_matches(path, '^.*?nef', 'i') THEN '*nef' WHEN regexp_matches(path, '^/photos/.*?5', 'i') THEN '/photos/*5' END AS pattern FROM catalog""", "catalog")(
    lambda s, d: views.catalog(s, d).select("path", text.first_match(F.col("path"), text.split_patterns(GLOBS)).alias("pattern")))

R.add("pattern_specificity", """WITH p AS (SELECT file_id, CASE WHEN file_id % 17 = 0 THEN NULL ELSE upper(left(path, (file_id % 20)::INT)) || CASE WHEN file_id % 2 = 0 THEN '*' ELSE '' END END AS p1,
   CASE WHEN file_id % 13 = 0 THEN NULL ELSE left(path, (o_custkey % 20)::INT) || CASE WHEN o_custkey % 2 = 0 THEN '*' ELSE 'q' END END AS p2 FROM catalog),
 c AS (SELECT *, len(list_filter(range(1, least(length(p1), length(p2)) + 1), lambda i: lower(left(p1, i::INT)) = lower(left(p2, i::INT)))) AS k FROM p)
 SELECT file_id, CASE WHEN p1 IS NULL AND p2 IS NULL THEN 0 WHEN p1 IS NULL THEN -1 WHEN p2 IS NULL THEN 1
  WHEN length(p1) = k AND length(p2) = k THEN 0 WHEN length(p1) = k THEN -1 WHEN length(p2) = k THEN 1
  WHEN p1[k + 1] = '*' THEN -1 WHEN p2[k + 1] = '*' THEN 1 ELSE 0 END AS cmp FROM c""", "catalog")(
    lambda s, d: views.catalog(s, d).selectExpr(
        "file_id",
        "CASE WHEN file_id % 17 = 0 THEN NULL ELSE concat(upper(left(path, cast(file_id % 20 AS int))), IF(file_id % 2 = 0, '*', '')) END AS p1",
        "CASE WHEN file_id % 13 = 0 THEN NULL ELSE concat(left(path, cast(o_custkey % 20 AS int)), IF(o_custkey % 2 = 0, '*', 'q')) END AS p2")
    .select("file_id", text.more_specific("p1", "p2").alias("cmp")))

R.add("contains_ci", "SELECT file_id, instr(lower(path), 'g' || (file_id % 9)) AS at, instr(lower(path), '.j') AS at_j FROM catalog", "catalog")(
    lambda s, d: views.catalog(s, d).select(
        "file_id", text.position_ci(F.col("path"), F.expr("concat('G', file_id % 9)")).alias("at"),
        text.position_ci(F.col("path"), F.lit(".J")).alias("at_j")))

R.add("first_number", r"SELECT file_id, regexp_extract(title, '^[^0-9]*([0-9]+)[^0-9]', 1) AS num, regexp_extract('0' || file_id, '^[^0-9]*([0-9]+)[^0-9]', 1) AS at_end FROM catalog", "catalog")(
    lambda s, d: views.catalog(s, d).select(
        "file_id", text.first_number(F.col("title")).alias("num"), text.first_number(F.expr("concat('0', file_id)")).alias("at_end")))

R.add("natural_sort_key", f"SELECT path, {NAT} AS sort_key FROM catalog", "catalog")(
    lambda s, d: views.catalog(s, d).select("path", text.natural_key(F.col("title")).alias("sort_key")))

PICKED = f"""picked AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY nat, path) AS number FROM (SELECT *, {NAT} AS nat FROM catalog WHERE selected))"""
R.add("rename_template", rf"""WITH {PICKED} SELECT path, number, 'a' || number || '_' || regexp_extract(title, '^[^0-9]*([0-9]+)[^0-9]', 1) || '_' || lpad(number::VARCHAR, greatest(4, length(number::VARCHAR))::INT, '0') || '_'
  || title || '_' || regexp_replace(title, '\.[^.]*$', '') || '.' || regexp_extract(title, '\.([^.]*)$', 1) || strftime(ctime, '_%H-%M-%d-%m-%Y-%y-%B-%b') AS new_name FROM picked""", "catalog")(
    lambda s, d: cat.rename_plan(views.catalog(s, d).withColumn("mtime", F.col("ctime")), "a%x_%n_%4x_%f_%F.%e_%h-%min-%d-%m-%y-%2y-%M-%3M").select("path", "number", "new_name"))

PLAN = rf"""{PICKED}, plan AS (SELECT path, dir, CASE WHEN o_custkey % 3 = 0 THEN 'n' || number || '.' || ext WHEN o_custkey % 3 = 1 THEN upper(dir) || '/sub' || '/' || title ELSE '/backup/' || year(mtime) || '/' || title END AS new_name FROM picked),
 acts AS (SELECT *, CASE WHEN instr(new_name, '/') = 0 THEN false ELSE lower(left(new_name, length(regexp_extract(new_name, '^(.*)/', 1)))) <> lower(left(dir, length(regexp_extract(new_name, '^(.*)/', 1)))) END AS copy,
  CASE WHEN instr(new_name, '/') > 0 THEN regexp_extract(new_name, '^(.*)/', 1) ELSE dir END AS target_dir FROM plan)"""


def _plan(s, d):
    plan = cat.number_selected(views.catalog(s, d)).withColumn(
        "new_name", F.expr("CASE o_custkey % 3 WHEN 0 THEN concat('n', number, '.', ext) WHEN 1 THEN concat(upper(dir), '/sub', '/', title) ELSE concat('/backup/', year(mtime), '/', title) END"))
    return plan.withColumn("copy", text.copy_needed("new_name", "dir")).withColumn(
        "target_dir", F.when(F.instr("new_name", "/") > 0, text.folder_of(F.col("new_name"))).otherwise(F.col("dir")))


R.add("copy_or_rename", f"WITH {PLAN} SELECT path, new_name, copy, target_dir FROM acts", "catalog")(
    lambda s, d: _plan(s, d).select("path", "new_name", "copy", "target_dir"))

R.add("batch_summary", f"""WITH {PLAN} SELECT CASE WHEN copy THEN 'copied' ELSE 'renamed' END AS what, count(*) AS n FROM acts GROUP BY 1
 UNION ALL SELECT 'folders created', count(DISTINCT target_dir) FROM acts WHERE target_dir NOT IN (SELECT dir FROM catalog)""", "catalog")(
    lambda s, d: cat.plan_summary(_plan(s, d), views.catalog(s, d)))

_MOVES = """pl AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY file_id) AS pos, lead(title) OVER (PARTITION BY dir ORDER BY file_id) AS nx, lag(title) OVER (PARTITION BY dir ORDER BY file_id) AS pv FROM catalog),
 p AS (SELECT path, pos % 10 = 7 AS copy, CASE WHEN pos % 10 IN (0, 2, 3, 5, 6) THEN dir || '/' || coalesce(nx, title) WHEN pos % 10 = 1 THEN dir || '/' || coalesce(pv, title) WHEN pos % 10 = 4 THEN dir || '/new_' || title
   WHEN pos % 10 = 7 THEN CASE WHEN file_id % 2 = 0 THEN '/backup/' || title ELSE dir || '/' || coalesce(pv, title) END ELSE dir || '/same_' || (pos // 10) || '.jpg' END AS target FROM pl WHERE pos % 10 <> 7 OR file_id % 3 > 0),
 st AS (SELECT p.*, lower(p.path) AS f, lower(target) AS t, c.path IS NOT NULL AS there, CASE WHEN p.path = target THEN 'same' WHEN p.path <> min(p.path) OVER (PARTITION BY lower(target)) THEN 'collision' WHEN copy AND c.path IS NOT NULL THEN 'exists' END AS state
   FROM p LEFT JOIN catalog c ON lower(c.path) = lower(target)),
 mv AS (SELECT * FROM st WHERE state IS NULL AND NOT copy),
 walk AS (SELECT path AS start, f AS origin, t AS pos, 1::BIGINT AS hops, path AS seen, there FROM mv UNION ALL SELECT w.start, origin, m.t, hops + 1, m.path, m.there FROM walk w JOIN mv m ON m.f = w.pos WHERE w.pos <> w.origin),
 ways AS (SELECT start, max(hops) AS hops, max_by(there, hops) AS there, max_by(pos, hops) = any_value(origin) AS circle, min(seen) AS least FROM walk GROUP BY start),
 turns AS (SELECT w.start, min(w.hops) AS step FROM walk w JOIN ways y USING (start) WHERE circle AND w.pos = lower(least) GROUP BY 1),
 steps AS (SELECT st.path, target, copy, coalesce(state, CASE WHEN copy OR circle OR NOT y.there THEN 'done' ELSE 'exists' END) AS state, y.hops, circle, least, turns.step FROM st LEFT JOIN ways y ON y.start = st.path AND state IS NULL LEFT JOIN turns ON turns.start = st.path)"""


def _moves(s, d):
    numbered = number_rows(views.catalog(s, d), ["dir"], [F.col("file_id")])
    near = shifted(numbered, ["dir"], {"nx": ("title", 1), "pv": ("title", -1)}).filter("pos % 10 <> 7 OR file_id % 3 > 0")
    return near.selectExpr(
        "path", "pos % 10 = 7 AS copy",
        "CASE WHEN pos % 10 IN (0, 2, 3, 5, 6) THEN concat(dir, '/', coalesce(nx, title)) WHEN pos % 10 = 1 THEN concat(dir, '/', coalesce(pv, title)) WHEN pos % 10 = 4 THEN concat(dir, '/new_', title) "
        "WHEN pos % 10 = 7 THEN IF(file_id % 2 = 0, concat('/backup/', title), concat(dir, '/', coalesce(pv, title))) ELSE concat(dir, '/same_', pos div 10, '.jpg') END AS target")


R.add("rename_steps", f"""WITH RECURSIVE {_MOVES} SELECT path, target, copy, state, CASE WHEN state <> 'done' THEN NULL WHEN copy THEN 0 WHEN circle THEN step ELSE hops END::BIGINT AS step,
 CASE WHEN state = 'done' AND circle AND path = least THEN path || '.~moving' END AS via FROM steps""", "catalog")(
    lambda s, d: cat.rename_steps(_moves(s, d), views.catalog(s, d)))


@R.add("batch_failures", f"""WITH RECURSIVE {_MOVES} SELECT CASE WHEN state = 'done' THEN CASE WHEN copy THEN 'copied' ELSE 'renamed' END WHEN copy THEN 'copies failed' ELSE 'renames failed' END AS what, count(*) AS n
  FROM steps WHERE state <> 'same' GROUP BY 1
 UNION ALL SELECT 'folders created', count(DISTINCT regexp_extract(target, '^(.*)/', 1)) FROM steps WHERE state = 'done' AND regexp_extract(target, '^(.*)/', 1) NOT IN (SELECT dir FROM catalog)""", "catalog")
def batch_failures(s, d):
    plan = materialise(_moves(s, d)).withColumn("target_dir", text.folder_of(F.col("target")))
    return cat.plan_summary(plan, views.catalog(s, d), cat.rename_steps(plan, views.catalog(s, d)))


R.add("batch_numbering", f"WITH {PICKED} SELECT path, number FROM picked", "catalog")(
    lambda s, d: cat.number_selected(views.catalog(s, d)).select("path", "number"))

HUMAN = "CASE WHEN {s} >= 1048576 THEN ({s} >> 20) || ' MB' WHEN {s} >= 1024 THEN ({s} >> 10) || ' KB' WHEN {s} > 0 THEN {s} || ' b' ELSE '' END"
R.add("humanize_size", f"SELECT file_id, {HUMAN.format(s='size')} AS human, {HUMAN.format(s='(size % (o_custkey * 7 + 1))')} AS human_part FROM catalog", "catalog")(
    lambda s, d: views.catalog(s, d).withColumn("part", F.expr("size % (o_custkey * 7 + 1)")).select(
        "file_id", text.humanize_size("size").alias("human"), text.humanize_size("part").alias("human_part")))

R.add("info_line", f"""WITH {LISTED} SELECT path, trim(title || '  ' || '[' || pos || '/' || n || ']' || '        ' || trunc((file_id % 300) / 100.0::DOUBLE * 100 + 0.5)::INT || ' % | '
  || (100 + file_id % 400) || ' x ' || (50 + file_id % 90) || ' | ' || {HUMAN.format(s='size')} || ' ' || path) AS line FROM listed""", "catalog")(
    lambda s, d: cat.positions(views.catalog(s, d)).selectExpr(
        "*", "(file_id % 300) / 100.0D AS zoom", "100 + file_id % 400 AS width", "50 + file_id % 90 AS height")
    .select("path", text.info_line(" <f>  <i>\\t<z> | <s> | <l> <p> ").alias("line")))

R.add("path_template", r"""SELECT file_id, 'conv "' || path || '" -crop ' || (10 + file_id % 5) || 'x' || (20 + file_id % 3) || '+' || file_id || '+' || o_custkey || ' out/' || title || ' "' || dir || '"' AS command,
  'x "' || title || '" ' || dir || '/sub' AS command2 FROM catalog""", "catalog")(
    lambda s, d: views.catalog(s, d).selectExpr("*", "file_id AS sel_left", "o_custkey AS sel_top", "10 + file_id % 5 AS sel_w", "20 + file_id % 3 AS sel_h").select(
        "file_id",
        text.path_text("conv %filename% -crop %w%x%h%+%x%+%y% out/%filetitle% %directory%", selection=("sel_left", "sel_top", "sel_w", "sel_h")).alias("command"),
        text.path_text("x %filetitle% %directory%/sub").alias("command2")))

# --- order and walks -------------------------------------------------------------------------

R.add("catalog_sort", """SELECT path, row_number() OVER (ORDER BY size DESC, path) AS by_size, row_number() OVER (ORDER BY mtime, path) AS by_mtime FROM catalog""", "catalog")(
    lambda s, d: cat.positions(
        cat.positions(views.catalog(s, d).select("path", "title", "size", "mtime"), "size", descending=True, group=()).withColumnRenamed("pos", "by_size"),
        "mtime", group=()).select("path", "by_size", F.col("pos").alias("by_mtime")))

R.add("catalog_shuffle")(
    lambda s, d: cat.positions(views.catalog(s, d).select("path", "title"), "random", group=(), seed=7).select("path", "pos"))

R.add("position_of_n", f"WITH {LISTED} SELECT path, pos, n, '[' || pos || '/' || n || ']' AS place FROM listed", "catalog")(
    lambda s, d: cat.positions(views.catalog(s, d)).selectExpr("path", "pos", "n", "concat('[', pos, '/', n, ']') AS place"))

NEAR = "OVER (PARTITION BY dir ORDER BY nat, path ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
R.add("next_prev", f"""WITH {LISTED} SELECT path, coalesce(lead(path) OVER w, first_value(path) {NEAR}) AS next, coalesce(lag(path) OVER w, last_value(path) {NEAR}) AS prev
 FROM listed WINDOW w AS (PARTITION BY dir ORDER BY nat, path)""", "catalog")(
    lambda s, d: cat.next_prev(views.catalog(s, d)).select("path", "next", "prev"))

R.add("first_last", f"""WITH {LISTED} SELECT dir, max(CASE WHEN pos = 1 THEN path END) AS first, max(CASE WHEN pos = n THEN path END) AS last, max(n) AS n FROM listed GROUP BY 1""", "catalog")(
    lambda s, d: cat.first_last(views.catalog(s, d)))

R.add("peek_k", f"""WITH {LISTED} SELECT path, lead(path, 3) OVER w AS ahead, lag(path, 3) OVER w AS behind FROM listed WINDOW w AS (PARTITION BY dir ORDER BY nat, path)""", "catalog")(
    lambda s, d: cat.peek(views.catalog(s, d), 3).select("path", "ahead", "behind"))

R.add("folder_walk_siblings", """WITH f AS (SELECT DISTINCT dir, regexp_extract(dir, '^(.*)/[^/]*$', 1) AS parent FROM catalog)
 SELECT parent, dir, CASE WHEN count(*) OVER (PARTITION BY parent) > 1 THEN coalesce(lead(dir) OVER (PARTITION BY parent ORDER BY dir), min(dir) OVER (PARTITION BY parent)) END AS next_dir FROM f""", "catalog")(
    lambda s, d: cat.sibling_folders(views.catalog(s, d)))

R.add("folder_walk_subtree", f"""SELECT path, row_number() OVER (ORDER BY string_split(dir, '/'), nat, path) AS pos
 FROM (SELECT *, {NAT} AS nat FROM (SELECT path, title, CASE WHEN file_id % 5 = 0 THEN regexp_replace(dir, '/[^/]*$', '') ELSE dir END AS dir FROM catalog))
 WHERE dir = '/photos' OR starts_with(dir, '/photos/')""", "catalog")(
    lambda s, d: cat.walk_subtree(
        views.catalog(s, d).withColumn("dir", F.expr("CASE WHEN file_id % 5 = 0 THEN regexp_replace(dir, '/[^/]*$', '') ELSE dir END")), "/photos")
    .select("path", "pos"))

R.add("catalog_verify", "SELECT path, CASE WHEN file_id % 6 <> 0 THEN 'kept' ELSE 'lost' END AS state FROM catalog", "catalog")(
    lambda s, d: cat.verify(views.catalog(s, d), views.catalog(s, d).filter("file_id % 6 <> 0")).select("path", "state"))

R.add("catalog_union_distinct", r"""SELECT path, CASE WHEN regexp_matches(title, '^.*?\.jp', 'i') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(title, '^img1', 'i') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(title, '^.*?9\.', 'i') THEN 1 ELSE 0 END AS hits
 FROM catalog WHERE regexp_matches(title, '\.jp|^img1|9\.', 'i')""", "catalog")(
    lambda s, d: cat.union_hits(views.catalog(s, d), ["*.jp", "img1", "*9."], distinct=False).groupBy("path").agg(F.count("*").cast("int").alias("hits"))
    .join(cat.union_hits(views.catalog(s, d), ["*.jp", "img1", "*9."]).select("path"), "path"))

R.add("duplicate_content", """WITH h AS (SELECT path, CASE WHEN file_id % 3 = 0 THEN 77 ELSE o_custkey END AS hash FROM catalog)
 SELECT path, hash, count(*) OVER (PARTITION BY hash) AS copies, min(path) OVER (PARTITION BY hash) AS first_path FROM h WHERE hash <> 0 QUALIFY copies > 1""", "catalog")(
    lambda s, d: cat.duplicate_content(
        views.catalog(s, d).selectExpr("path", "IF(file_id % 3 = 0, 77L, o_custkey) AS hash"), hot_rows=1000).select("path", "hash", "copies", "first_path"))

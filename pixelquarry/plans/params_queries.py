"""Queries over the parameter store, folder rules and settings."""

from pyspark.sql import functions as F

from pixelquarry.functions import metadata, quantize
from pixelquarry.operators import params as par
from pixelquarry.operators import stats
from pixelquarry.plans import views
from pixelquarry.plans.registry import Registry
from pixelquarry.plans.stats_queries import H8, NIGHT, RUNS
from pixelquarry.sources import settings as cfg

R = Registry()
DEFAULTS = {"contrast": 0.0, "gamma": 1.0, "saturation": 1.0, "sharpen": 0.3, "lighten_shadows": 0.5}


def _round(expr: str) -> str:
    return f"floor({expr} * 1e6 + 0.5)"


# --- coding ----------------------------------------------------------------------------------

def _duck_byte(v, lo, hi):
    return f"trunc(0.5::DOUBLE + 255.0::DOUBLE * (greatest({lo}::DOUBLE, least({hi}::DOUBLE, {v})) - ({lo}::DOUBLE)) / {hi - lo}::DOUBLE)::BIGINT"


_QUANT = {"contrast": (-0.5, 0.5), "gamma": (0.5, 2.0), "sharpen": (0.0, 0.5), "lighten_shadows": (0.0, 1.0)}
_SAT = "(128.0::DOUBLE * greatest(-1.0::DOUBLE, least(1.0::DOUBLE, saturation - 1.0::DOUBLE)))"
Q_DUCK = "q AS (SELECT hash, " + ", ".join(f"{_duck_byte(c, *r)} AS {c}_q" for c, r in _QUANT.items()) + f""",
 least(127, trunc(CASE WHEN {_SAT} < 0 THEN {_SAT} - 0.5 ELSE {_SAT} + 0.5 END)::BIGINT) AS saturation_q,
 (((rot100 - 18000) % 36000) + 36000) % 36000 AS angle_q FROM params)"""


def quantized(s, d):
    return views.params(s, d).selectExpr(
        "hash", *[f"{quantize.to_byte(c, *r)} AS {c}_q" for c, r in _QUANT.items()],
        f"{quantize.saturation_to_code('saturation')} AS saturation_q", f"{quantize.angle_to_code('((rot100 - 18000) / 100.0D)')} AS angle_q",
    )


R.add("param_quantize", f"WITH {Q_DUCK} SELECT * FROM q", "params")(quantized)

R.add("param_dequantize", f"""WITH {Q_DUCK} SELECT hash, """ + ", ".join(
    f"floor(({c}_q * {hi - lo}::DOUBLE / 255.0::DOUBLE + ({lo}::DOUBLE)) * 1e6 + 0.5)::BIGINT AS {c}" for c, (lo, hi) in _QUANT.items())
    + """, floor((saturation_q / 128.0::DOUBLE + 1.0) * 1e6 + 0.5)::BIGINT AS saturation, floor(CASE WHEN angle_q > 18000 THEN angle_q * 0.01::DOUBLE - 360.0 ELSE angle_q * 0.01::DOUBLE END * 100 + 0.5)::BIGINT AS angle100 FROM q""", "params")(
    lambda s, d: quantized(s, d).selectExpr(
        "hash", *[f"{_round(quantize.from_byte(f'{c}_q', *r))} AS {c}" for c, r in _QUANT.items()],
        f"{_round(quantize.saturation_from_code('saturation_q'))} AS saturation", f"floor(({quantize.angle_from_code('angle_q')}) * 100 + 0.5) AS angle100"))

R.add("flags_unpack", """SELECT hash, flags, (flags & 1) <> 0 AS auto_contrast, (flags & 2) <> 0 AS density, (flags & 4) <> 0 AS high_quality, (flags & 32) <> 0 AS screen_relative,
 (flags & 64) <> 0 AS auto_crop, (flags & 128) <> 0 AS keep_ratio, ((flags >> 3) & 3) * 90 AS rotation FROM params""", "params")(
    lambda s, d: views.params(s, d).select("hash", "flags", *[c.alias(n) for n, c in quantize.unpack_flags("flags").items()]))

R.add("flags_pack", """SELECT hash, CASE WHEN p % 2 = 1 THEN 1 ELSE 0 END + CASE WHEN p % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN p % 5 = 0 THEN 4 ELSE 0 END
 + CASE WHEN p % 7 = 0 THEN 64 ELSE 0 END + CASE WHEN p % 11 = 0 THEN 128 ELSE 0 END + (p % 4) * 8 AS code FROM (SELECT hash, rot100 AS p FROM params)""", "params")(
    lambda s, d: views.params(s, d).select(
        "hash", quantize.pack_flags({
            "auto_contrast": "rot100 % 2 = 1", "density": "rot100 % 3 = 0", "high_quality": "rot100 % 5 = 0", "auto_crop": "rot100 % 7 = 0",
            "keep_ratio": "rot100 % 11 = 0"}, "rot100 % 4 * 90").alias("code")))

# --- joins -----------------------------------------------------------------------------------

FILES_DUCK = "files AS (SELECT path, CASE WHEN file_id % 3 = 0 THEN 55 ELSE o_custkey * 2 END AS hash FROM catalog)"


def hashed_files(s, d):
    return views.catalog(s, d).selectExpr("path", "IF(file_id % 3 = 0, 55L, o_custkey * 2) AS hash")


R.add("param_lookup", f"""WITH {FILES_DUCK} SELECT path, f.hash, """ + ", ".join(f"coalesce(p.{c}, {v}::DOUBLE) AS {c}" for c, v in DEFAULTS.items()) + """,
  p.hash IS NOT NULL AS stored FROM files f LEFT JOIN (SELECT * FROM params WHERE hash <> 0) p ON f.hash = p.hash""", "catalog params")(
    lambda s, d: par.lookup(hashed_files(s, d), views.params(s, d), DEFAULTS, hot_rows=1000))

_COLS = "hash, seq, contrast, gamma, saturation, sharpen, lighten_shadows, darken_highlights, flags, rot100"
MERGE = """pool AS (SELECT 0 AS side, * FROM params WHERE hash <> 0 UNION ALL SELECT 1, * FROM params_import WHERE hash <> 0),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY {order}) AS rn FROM pool)"""
R.add("param_merge", f"WITH {MERGE.format(order='side, seq')} SELECT {_COLS} FROM ranked WHERE rn = 1", "params params_import")(
    lambda s, d: par.merge(views.params(s, d), views.params_import(s, d), preserve=True))
R.add("param_merge_overwrite", f"WITH {MERGE.format(order='side DESC, seq DESC')} SELECT {_COLS} FROM ranked WHERE rn = 1", "params params_import")(
    lambda s, d: par.merge(views.params(s, d), views.params_import(s, d), preserve=False))
R.add("param_upsert", f"WITH {MERGE.format(order='side DESC, seq DESC')} SELECT {_COLS} FROM ranked WHERE rn = 1", "params params_import")(
    lambda s, d: par.upsert(views.params(s, d), views.params_import(s, d)))
R.add("param_delete", f"SELECT {_COLS} FROM params WHERE hash NOT IN (SELECT hash FROM params_import WHERE flags % 3 = 0)", "params params_import")(
    lambda s, d: par.delete(views.params(s, d), views.params_import(s, d).filter("flags % 3 = 0")))

RULES_DUCK = r"""mt AS (SELECT *, CASE WHEN regexp_matches(path, '^/photos/199', 'i') THEN '/photos/199*' WHEN regexp_matches(path, '^.*?/IMG1', 'i') THEN '*/IMG1' END AS ci,
  CASE WHEN regexp_matches(path, '^/photos/1995/', 'i') THEN '/photos/1995/*' END AS ce,
  CASE WHEN regexp_matches(path, '^/photos/.*?/3/', 'i') THEN '/photos/*/3/' END AS di, CASE WHEN regexp_matches(path, '^.*?\.tif', 'i') THEN '*.tif' END AS de FROM catalog),
 sp AS (SELECT *, len(list_filter(range(1, 30), lambda i: i <= least(length(ci), length(ce)) AND lower(left(ci, i::INT)) = lower(left(ce, i::INT)))) AS ck,
  len(list_filter(range(1, 30), lambda i: i <= least(length(di), length(de)) AND lower(left(di, i::INT)) = lower(left(de, i::INT)))) AS dk FROM mt),
 ruled AS (SELECT *, CASE WHEN ci IS NOT NULL AND ce IS NOT NULL THEN NOT (length(ce) > ck AND (length(ci) = ck OR ci[ck + 1] = '*')) WHEN ci IS NOT NULL THEN true WHEN ce IS NOT NULL THEN false END AS contrast_rule,
  CASE WHEN di IS NOT NULL AND de IS NOT NULL THEN NOT (length(de) > dk AND (length(di) = dk OR di[dk + 1] = '*')) WHEN di IS NOT NULL THEN true WHEN de IS NOT NULL THEN false END AS density_rule FROM sp)"""
R.add("rule_resolve", f"WITH {RULES_DUCK} SELECT path, contrast_rule AS contrast, density_rule AS density FROM ruled", "catalog")(
    lambda s, d: par.resolve_rules(views.catalog(s, d).select("path"), views.FOLDER_RULES))

_ROT = """CASE WHEN thumb_w > 0 AND thumb_h > 0 AND (width > height) <> (thumb_w > thumb_h) THEN 0 WHEN orientation = 1 THEN 0 WHEN orientation = 3 THEN 180
 WHEN orientation = 6 THEN 90 WHEN orientation = 8 THEN 270 ELSE 0 END"""


@R.add("effective_params", f"""WITH {H8}, {RUNS}, {NIGHT}, {RULES_DUCK},
 f AS (SELECT path, file_id, CASE WHEN file_id % 3 = 0 THEN 55 ELSE o_custkey * 2 END AS hash, file_id % 10 = 0 AS keep, {_ROT} AS exif_rotation,
   coalesce(n.night, 0.0) AS night, (file_id % 4) / 8.0::DOUBLE AS sunset, contrast_rule, density_rule, file_id % 2 = 0 AS dc, file_id % 5 = 0 AS dd
  FROM ruled JOIN exif ON file_id = image_id LEFT JOIN night n ON n.image_id = file_id),
 j AS (SELECT f.*, p.hash IS NOT NULL AS hit, p.hash IS NOT NULL AND NOT keep AS use_it, p.contrast AS pc, p.gamma AS pg, p.lighten_shadows AS pl, p.flags AS pf
  FROM f LEFT JOIN (SELECT * FROM params WHERE hash <> 0) p ON f.hash = p.hash)
 SELECT path, hit AS stored, CASE WHEN use_it THEN pc ELSE 0.1::DOUBLE END AS contrast, CASE WHEN use_it THEN pg ELSE 1.0::DOUBLE END AS gamma,
  CASE WHEN use_it THEN pl WHEN hit THEN 0.5::DOUBLE ELSE 0.5::DOUBLE * (1.0 - night) * (1.0 - sunset) END AS lighten_shadows,
  CASE WHEN use_it THEN (pf & 1) <> 0 WHEN keep THEN dc ELSE coalesce(contrast_rule, dc) END AS contrast_on,
  CASE WHEN use_it THEN (pf & 2) <> 0 WHEN keep THEN dd ELSE coalesce(density_rule, dd) END AS density_on,
  CASE WHEN use_it THEN ((pf >> 3) & 3) * 90 WHEN hit THEN 0 ELSE exif_rotation END AS rotation FROM j""", "catalog exif params pixels")
def effective_params(s, d):
    tags = views.exif(s, d).select("image_id", metadata.rotation("orientation", "width", "height", "thumb_w", "thumb_h").alias("exif_rotation"))
    scores = stats.night_score(stats.hist_exact(views.pixels(s, d))).select("image_id", "night")
    files = (
        views.catalog(s, d).withColumn("image_id", F.col("file_id")).join(tags, "image_id").join(scores, "image_id", "left")
        .selectExpr("path", "IF(file_id % 3 = 0, 55L, o_custkey * 2) AS hash", "file_id % 10 = 0 AS keep", "exif_rotation", "coalesce(night, 0.0D) AS night",
                    "(file_id % 4) / 8.0D AS sunset", "file_id % 2 = 0 AS contrast_on", "file_id % 5 = 0 AS density_on")
    )
    rules = {"contrast_on": views.FOLDER_RULES["contrast"], "density_on": views.FOLDER_RULES["density"]}
    out = par.effective(files, views.params(s, d), {"contrast": 0.1, "gamma": 1.0, "lighten_shadows": 0.5}, rules, hot_rows=1000)
    return out.select("path", "stored", "contrast", "gamma", "lighten_shadows", "contrast_on", "density_on", "rotation")


R.add("keep_params_override", """WITH t AS (SELECT hash, contrast, gamma, saturation, sharpen, CASE WHEN hash % 4 = 0 THEN '0.25 -1 0.1 -1 -1 -1 -1 -1 -1 -1 -1 1.5' WHEN hash % 4 = 1 THEN '-1 1.2 ' || (hash % 7) WHEN hash % 4 = 2 THEN '0.3 x 0.2' ELSE '' END AS preset FROM params)
 SELECT hash, CASE hash % 4 WHEN 0 THEN 0.25 WHEN 2 THEN 0.3 ELSE contrast END AS contrast, CASE hash % 4 WHEN 1 THEN 1.2 ELSE gamma END AS gamma,
  CASE hash % 4 WHEN 0 THEN 0.1 WHEN 1 THEN (hash % 7)::DOUBLE ELSE sharpen END AS sharpen, CASE hash % 4 WHEN 0 THEN 1.5 ELSE saturation END AS saturation FROM t""", "params")(
    lambda s, d: par.apply_preset(
        views.params(s, d).selectExpr(
            "hash", "contrast", "gamma", "saturation", "sharpen",
            "CASE hash % 4 WHEN 0 THEN '0.25 -1 0.1 -1 -1 -1 -1 -1 -1 -1 -1 1.5' WHEN 1 THEN concat('-1 1.2 ', hash % 7) WHEN 2 THEN '0.3 x 0.2' ELSE '' END AS preset"),
        "preset", names=("contrast", "gamma", "saturation", "sharpen")).drop("preset"))

# --- settings --------------------------------------------------------------------------------

PARSED = r"""kv AS (SELECT profile, layer, line_no, regexp_extract(raw_line, '^\s*([^\s=]+)', 1) AS key, regexp_extract(raw_line, '^\s*[^\s=]+\s*=?\s*(.*)$', 1) AS value FROM settings),
 parsed AS (SELECT profile, layer, key, arg_max(value, line_no) AS value FROM kv WHERE key <> '' GROUP BY 1, 2, 3)"""
R.add("settings_source", f"WITH {PARSED} SELECT * FROM parsed", "settings")(lambda s, d: cfg.parse_lines(views.settings(s, d)))


@R.add("settings_layer", f"""WITH {PARSED}, l AS (SELECT profile, key, coalesce(max(value) FILTER (WHERE layer = 'user'), max(value) FILTER (WHERE layer = 'global')) AS sv, max(value) FILTER (WHERE layer = 'default') AS dv FROM parsed GROUP BY 1, 2)
 SELECT profile, max(CASE WHEN key = 'Cores' THEN CASE WHEN coalesce(sv, '') = '' THEN 2 ELSE greatest(1, least(16, coalesce(trunc(TRY_CAST(sv AS DOUBLE))::BIGINT, 0))) END END) AS cores,
  max(CASE WHEN key = 'Gamma' THEN CASE WHEN coalesce(sv, '') = '' THEN 1.0::DOUBLE ELSE greatest(0.5::DOUBLE, least(4.0::DOUBLE, coalesce(TRY_CAST(sv AS DOUBLE), 0.0))) END END) AS gamma,
  bool_or(CASE WHEN key = 'AutoContrast' THEN CASE lower(sv) WHEN 'true' THEN true WHEN 'false' THEN false ELSE true END END) AS auto_contrast,
  max(CASE WHEN key = 'Language' THEN coalesce(sv, dv) END) AS language FROM l GROUP BY 1""", "settings")
def settings_layer(s, d):
    rows = cfg.layered(cfg.parse_lines(views.settings(s, d)))

    def one(key, column):
        return F.max(F.when(F.col("key") == key, column))

    return rows.groupBy("profile").agg(
        one("Cores", cfg.as_int(2, 1, 16)).alias("cores"), one("Gamma", cfg.as_double(1.0, 0.5, 4.0)).alias("gamma"),
        one("AutoContrast", cfg.as_bool(True)).alias("auto_contrast"), one("Language", cfg.as_text()).alias("language"))


_VALUE = """CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN c_custkey || ' ' || (c_nationkey - 9) || ' ' || (c_custkey % 300) || '  -' || c_nationkey || ' x'
 WHEN 2 THEN '  ' || c_nationkey || ' ' || (c_custkey % 400) WHEN 3 THEN (c_custkey % 300) || ' ' || c_nationkey || ' ' || (c_custkey % 7) WHEN 4 THEN 'max ' || c_custkey ELSE c_nationkey || 'px 3 4 5' END"""


@R.add("settings_values", f"""WITH t AS (SELECT c_custkey AS profile, {_VALUE} AS set_value FROM customer), n AS (SELECT *, list_transform(string_split(trim(regexp_replace(set_value, '\\s+', ' ', 'g')), ' '), lambda x: TRY_CAST(x AS INT)) AS v FROM t),
 k AS (SELECT profile, v, CASE WHEN len(v) >= 4 AND v[1] + v[2] + v[3] + v[4] IS NOT NULL THEN v[1:4] ELSE [0, 0, 0, 0] END AS r, CASE WHEN len(v) >= 2 AND v[1] + v[2] IS NOT NULL THEN [greatest(1, v[1]), greatest(1, v[2])] ELSE [320, 240] END AS s,
  CASE WHEN len(v) >= 3 AND v[1] + v[2] + v[3] IS NOT NULL THEN [v[1] & 255, v[2] & 255, v[3] & 255] ELSE [243, 242, 231] END AS c FROM n)
 SELECT profile, least(r[1], r[3]) AS left_, least(r[2], r[4]) AS top_, greatest(r[1], r[3]) AS right_, greatest(r[2], r[4]) AS bottom_, s[1] AS width, s[2] AS height, c[1] AS red, c[2] AS green, c[3] AS blue FROM k""")
def settings_values(s, d):
    """Rectangles, sizes and colours from one text per profile."""
    rows = views.table(s, d, "customer").selectExpr("c_custkey AS profile", f"{_VALUE} AS set_value")
    typed = rows.select("profile", cfg.as_rect((0, 0, 0, 0)).alias("rect"), cfg.as_size((320, 240)).alias("size"), cfg.as_color((243, 242, 231)).alias("color"))
    return typed.selectExpr("profile", "rect.left AS left_", "rect.top AS top_", "rect.right AS right_", "rect.bottom AS bottom_", "size.width", "size.height", "color.red", "color.green", "color.blue")

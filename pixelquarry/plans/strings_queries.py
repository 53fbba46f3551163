"""Queries over translation catalogs."""

from pyspark.sql import functions as F

from pixelquarry.operators import strings as st
from pixelquarry.operators.scaling import spread_rows
from pixelquarry.plans import views
from pixelquarry.plans.registry import Registry

R = Registry()

_LINES = """lines AS (SELECT n_name AS lang, p_partkey * 3 + k AS line_no, CASE k
   WHEN 0 THEN CASE WHEN (p_partkey + n_nationkey) % 5 = 0 THEN '//' || p_name || p_partkey || chr(9) || n_name || p_partkey ELSE p_name || p_partkey || ' ' || chr(9) || n_name || ' ' || p_partkey || '  ' END
   WHEN 1 THEN CASE WHEN p_partkey % 10 = 0 THEN '//: Key ' || (p_partkey % 70) || ': value: ' || p_partkey || ' ' WHEN p_partkey % 10 = 1 THEN '// just a note ' || p_partkey ELSE '' END
   ELSE CASE WHEN p_partkey % 40 = 0 THEN p_name || p_partkey || chr(9) || 'again' WHEN p_partkey % 41 = 1 THEN 'alone ' || p_partkey ELSE '' END END AS line
  FROM (SELECT *, unnest([0, 1, 2]) AS k FROM part), nation)"""


def catalog_lines(s, d):
    langs = views.table(s, d, "nation").select("n_nationkey", F.col("n_name").alias("lang"))
    parts = spread_rows(views.table(s, d, "part"), 3 * views.LANGUAGES).withColumn("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(24)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return parts.join(langs, "n_nationkey").selectExpr(
        "lang", "p_partkey * 3 + k AS line_no",
        "CASE k WHEN 0 THEN IF((p_partkey + n_nationkey) % 5 = 0, concat('//', p_name, p_partkey, '\t', lang, p_partkey), concat(p_name, p_partkey, ' ', '\t', lang, ' ', p_partkey, '  ')) "
        "WHEN 1 THEN CASE WHEN p_partkey % 10 = 0 THEN concat('//: Key ', p_partkey % 70, ': value: ', p_partkey, ' ') WHEN p_partkey % 10 = 1 THEN concat('// just a note ', p_partkey) ELSE '' END "
        "ELSE CASE WHEN p_partkey % 40 = 0 THEN concat(p_name, p_partkey, '\t', 'again') WHEN p_partkey % 41 = 1 THEN concat('alone ', p_partkey) ELSE '' END END AS line")


@R.add("string_catalog_source", f"""WITH {_LINES}, k AS (SELECT *, CASE WHEN starts_with(line, '//: ') THEN 'info' WHEN starts_with(line, '//') AND contains(line, chr(9)) THEN 'old' WHEN starts_with(line, '//') THEN 'comment' WHEN line <> '' THEN 'pair' END AS kind FROM lines),
 pr AS (SELECT lang, line_no, kind, trim(split_part(CASE WHEN kind = 'old' THEN line[3:] ELSE line END, chr(9), 1)) AS key, rtrim(split_part(CASE WHEN kind = 'old' THEN line[3:] ELSE line END, chr(9), 2)) AS value FROM k WHERE kind IN ('pair', 'old')),
 f AS (SELECT lang, key, arg_min(value, line_no) AS value, min(line_no) AS first_at, count(*) AS n, max(line_no) FILTER (WHERE kind = 'pair') AS lp, count(DISTINCT value) AS vs FROM pr GROUP BY 1, 2)
 SELECT 'string' AS what, lang, key, value FROM f UNION ALL SELECT 'error', lang, key, n::VARCHAR FROM f WHERE n > 1 AND (lp > first_at OR vs > 1)
 UNION ALL SELECT 'info', lang, regexp_extract(line, '^//: ([^:]*):', 1), trim(arg_max(regexp_extract(line, '^//: [^:]*:(.*)$', 1), line_no)) FROM k WHERE kind = 'info' GROUP BY 2, 3
 UNION ALL SELECT 'comment', lang, line_no::VARCHAR, line FROM k WHERE kind = 'comment'""")
def string_catalog_source(s, d):
    t = st.parse_catalog(catalog_lines(s, d))
    return (
        t["strings"].select(F.lit("string").alias("what"), "lang", "key", "value")
        .union(t["errors"].select(F.lit("error"), "lang", "key", F.col("times").cast("string")))
        .union(t["info"].select(F.lit("info"), "lang", "k", "v"))
        .union(t["comments"].select(F.lit("comment"), "lang", F.col("line_no").cast("string"), "line"))
    )


R.add("translate_lookup", """SELECT a.lang, a.key, coalesce(nullif(s.value, ''), a.key) AS text FROM (SELECT n_name AS lang, key FROM strings_ref, nation) a LEFT JOIN strings s ON s.lang = a.lang AND s.key = a.key""", "strings_ref strings")(
    lambda s, d: st.lookup(
        spread_rows(views.strings_ref(s, d), views.LANGUAGES).select("key", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("n_nationkey"))
        .join(views.table(s, d, "nation").select("n_nationkey", F.col("n_name").alias("lang")), "n_nationkey").select("lang", "key"),
        views.strings(s, d)))

STATE = """st AS (SELECT coalesce(a.lang, s.lang) AS lang, coalesce(a.key, s.key) AS key, s.value, CASE WHEN a.key IS NULL THEN 'out of date' WHEN coalesce(s.value, '') = '' THEN 'missing' WHEN s.value = s.key THEN 'same' ELSE 'done' END AS state
 FROM (SELECT n_name AS lang, key FROM strings_ref, nation) a FULL JOIN strings s ON s.lang = a.lang AND s.key = a.key)"""
R.add("strings_reconcile", f"WITH {STATE} SELECT * FROM st", "strings_ref strings")(lambda s, d: st.reconcile(views.strings_ref(s, d), views.strings(s, d)))

R.add("placeholder_check", """SELECT lang, r.key, (length(value) - length(replace(value, '%d', ''))) // 2 = (length(r.key) - length(replace(r.key, '%d', ''))) // 2 AND (length(value) - length(replace(value, '%s', ''))) = (length(r.key) - length(replace(r.key, '%s', '')))
 AND (length(value) - length(replace(value, '%filename%', ''))) = (length(r.key) - length(replace(r.key, '%filename%', ''))) AS fits FROM strings_ref r JOIN strings s ON r.key = s.key WHERE value <> ''""", "strings_ref strings")(
    lambda s, d: st.placeholder_check(views.strings_ref(s, d), views.strings(s, d)))

R.add("translation_progress", f"""WITH {STATE}, c AS (SELECT coalesce(lang, 'ALL') AS lang, count(*) AS total, sum(CASE WHEN state = 'missing' THEN 1 ELSE 0 END)::BIGINT AS missing FROM st WHERE state <> 'out of date' GROUP BY ROLLUP (lang))
 SELECT *, total - missing AS done, round_even(100.0::DOUBLE * (total - missing) / total, 0)::BIGINT AS percent, round_even(100.0::DOUBLE * missing / total, 0)::BIGINT AS missing_percent FROM c""", "strings_ref strings")(
    lambda s, d: st.progress(st.reconcile(views.strings_ref(s, d), views.strings(s, d))))

_USE = """us AS (SELECT literal, page_id AS doc_id, count(*) AS uses FROM (SELECT page_id, unnest(regexp_extract_all(html, '"([^"]*)"', 1)) AS literal FROM pages) GROUP BY 1, 2)"""


def pages(s, d):
    return views.table(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))


R.add("literal_usage", f"WITH {_USE} SELECT * FROM us")(lambda s, d: st.literal_usage(pages(s, d)))
R.add("literal_usage_counts", f"WITH {_USE} SELECT literal, count(*) AS files, sum(uses)::BIGINT AS uses, min(doc_id) AS first_file FROM us GROUP BY 1")(
    lambda s, d: st.usage_counts(st.literal_usage(pages(s, d))))

TEXTS = r">([^<]+)<"
_TEXT_USE = _USE.replace('"([^"]*)"', TEXTS)
R.add("untranslated_candidates", rf"""WITH {_TEXT_USE} SELECT DISTINCT literal FROM us WHERE literal NOT IN (SELECT DISTINCT literal FROM us WHERE doc_id % 4 = 0) AND trim(literal) <> ''
 AND NOT regexp_full_match(literal, '\.[a-z]{{3}}') AND NOT regexp_full_match(literal, '\*\.[a-z]{{3,4}}') AND NOT regexp_full_match(literal, '[^\pL\pN_\pM]+') AND NOT regexp_full_match(literal, '[\d.]+')
 AND NOT (literal LIKE '<%>') AND NOT (literal LIKE '\%%\%' ESCAPE '\' AND length(literal) > 1) AND NOT (literal LIKE '{{%}}') AND NOT starts_with(literal, '/') AND regexp_matches(literal, '[a-zA-Z]{{2}}') AND literal NOT IN ('About', 'Home')""")(
    lambda s, d: st.untranslated(
        st.literal_usage(pages(s, d), TEXTS), st.literal_usage(pages(s, d), TEXTS).filter("doc_id % 4 = 0").select(F.col("literal").alias("key")), ["About", "Home"]))

R.add("strings_except", "SELECT text, min(seq) AS seq FROM (SELECT p_partkey AS seq, p_name AS text FROM part) WHERE text NOT IN (SELECT p_name FROM part WHERE p_partkey % 50 = 0) GROUP BY 1")(
    lambda s, d: st.except_keep_order(
        views.table(s, d, "part").selectExpr("p_partkey AS seq", "p_name AS text"), views.table(s, d, "part").filter("p_partkey % 50 = 0").selectExpr("p_name AS text")))
R.add("strings_union", "SELECT p_name AS text FROM part UNION SELECT p_type FROM part UNION SELECT n_name FROM nation UNION SELECT c_mktsegment FROM customer")(
    lambda s, d: st.union_texts(
        views.table(s, d, "part").selectExpr("p_name AS text"), views.table(s, d, "part").selectExpr("p_type AS text"),
        views.table(s, d, "nation").selectExpr("n_name AS text"), views.table(s, d, "customer").selectExpr("c_mktsegment AS text")))

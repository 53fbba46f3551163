"""Registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquarry.llm import attribution, binary, bpe, decontam, extract, licenses, quality, ranked, sentences, sharding, simhash, tries, urls

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(table(spark, sf_dir, "pages"), urls.listed_entries(spark))
    return judged.select("page_id", "host", "path", F.when(F.col("tier") == 0, F.col("entry")).alias("rule"), "verdict")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encode, decode = bpe.codec_functions(spark, RANKS, public_tokenizers.PATTERN)
    ids = table(spark, sf_dir, "documents").select("doc_id", encode("text").alias("ids"))
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return ids.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(decode("ids"), 256).alias("decoded_sha256")
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition(table(spark, sf_dir, "documents"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_pages(table(spark, sf_dir, "pages"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, folder = binary.write_token_files(table(spark, sf_dir, "documents"), TOKENIZER, END_ID)
    read = binary.read_token_files(manifest, folder)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.substring_index("text", "\n", 1)
    body = F.expr("substring(text, char_length(substring_index(text, '\n', 1)) + 2)")
    text, sections = attribution.record([("lang", F.col("lang")), ("source", F.col("source")), ("head", head), ("body", body)])
    found = attribution.token_counts(table(spark, sf_dir, "documents"), TOKENIZER, text, sections)
    return found.select("doc_id", "section", "n_bytes", F.col("n_tokens").cast("bigint").alias("n_tokens"), "n_crossing")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encode, decode = sentences.model_functions(spark, PIECES)
    ids = table(spark, sf_dir, "documents").select("doc_id", encode("text").alias("ids"))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return ids.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decode("ids").cast("binary"), 256).alias("decoded_sha256"),
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS pos, doc_id, {_TERMS} AS terms FROM documents),
held AS (SELECT pos, doc_id, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM held),
tf AS (SELECT pos, term, count(*) AS tf FROM (SELECT pos, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
i AS (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS terms FROM benchmark),
q AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(terms) AS term FROM i) GROUP BY ALL),
s AS (SELECT item, item_id, doc_id, pos, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN held USING (pos), total GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, pos) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(tries.rebuild(tries.turn_lists(table(spark, sf_dir, "conversations"))))


OP13_SQL = """
WITH t AS (SELECT conv_id, turn, sha256(strlen(role) || ':' || role || text)[1:32] AS key, strlen(text) AS n_bytes
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
l AS (SELECT conv_id, list({'key': key, 'n_bytes': n_bytes} ORDER BY turn NULLS FIRST, key) AS turns FROM t GROUP BY conv_id),
bits AS (SELECT conv_id, flatten([[(ascii(c) >> k) & 1 for k in range(8)] for c in regexp_extract_all(conv_id::VARCHAR, '.')])::BIGINT[] AS bits FROM l),
h AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, bits), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) % 9 AS h FROM bits),
r AS (SELECT l.conv_id, list_concat(coalesce(b.turns[1:h], []), l.turns[h + 1:]) AS turns FROM l JOIN h USING (conv_id) LEFT JOIN l AS b ON b.conv_id = l.conv_id - l.conv_id % 5),
p AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM r),
k AS (SELECT conv_id, depth, len(turns) AS size, sha256(array_to_string([x.key for x in turns[1:depth]], '')) AS node, coalesce(turns[depth].n_bytes, 0) AS n_bytes FROM p),
up AS (SELECT a.node, a.depth, b.node AS above FROM (SELECT node, depth, min(conv_id) AS conv_id FROM k GROUP BY ALL) a JOIN k b ON b.conv_id = a.conv_id AND b.depth <= a.depth),
n AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(n_bytes) AS n_bytes,
  sha256(coalesce(string_agg(CASE WHEN size = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM k GROUP BY node, depth),
c AS (SELECT u.above AS node, count(*) AS n_children FROM up u JOIN n ON n.node = u.above WHERE u.depth = n.depth + 1 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (node)),
s AS (SELECT u.above AS node, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * n_bytes) AS saved FROM up u JOIN f USING (node) GROUP BY 1)
SELECT f.conv_id, f.depth, g.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (node) LEFT JOIN (SELECT u.node, m.conv_id FROM up u JOIN n AS m ON m.node = u.above WHERE u.depth = m.depth + 1) g ON g.node = f.node
"""

_BLOCKED = " OR ".join(f"host = '{k[:-1]}' OR host LIKE '%.{k[:-1]}'" for k, _ in urls.LISTED)
OP2_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, CASE
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
  WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IN ('com/fr/', 'org/') THEN 'allow'
  WHEN path LIKE '/%' AND ({_BLOCKED}) THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""

QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_url_filter, op3_byte_bpe, op4_quality_rules, op5_html_extract, op6_simhash_dedup, op7_sharding, op8_decontamination,
    op9_token_files, op10_token_counts, op11_sentencepiece, op12_ranked_search,
    op13_conversation_trie,
)}
ORACLES = {"op2_url_filter": OP2_SQL, "op12_ranked_search": OP12_SQL, "op13_conversation_trie": OP13_SQL}

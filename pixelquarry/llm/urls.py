"""URL filters: a blocked Bloom filter before an exact hash join.

Listed entries are canonical ``host/path-beginning`` keys with an action. Every URL has one key for each number of
last host labels and length of path beginning that the list uses, however many labels it has itself. A blocked Bloom filter of the listed keys (one 512-bit block per key, eight bits in it) passes possible hits; those
meet the list in an exact hash join, which removes the false positives. URLs without a possible hit never move. The filter's size is bounded by
``MAX_BLOCKS`` whatever the list's size: a longer list passes more, and the join stays exact.

Cases: a null URL, or one without ``://``, has an empty host and path, meets no entry and is allowed by default; an empty list allows everything; of
equal keys the first action in alphabetical order counts; repeated rows are judged each for itself; an empty table gives an empty result; other columns
are not read; a null id stays null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelquarry.operators.scaling import broadcast_if_small, join_hot_keys

WORDS = 8
BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 17  # 8 MB
BROADCAST_KEYS = 500_000

#: Fixed values of the contract: rules.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: A parameter of the query: hosts that are blocked where no rule fits.
LISTED = [(f"{host}.example.{end}/", "block") for host in ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track") for end in ("com", "net", "org")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    at = F.locate("://", url)
    rest = F.substr(url, at + 3)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.when(at > 0, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def path_of(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _split_key(key: Column) -> tuple[Column, Column]:
    at = F.locate("/", key)
    return F.substring_index(key, "/", 1), F.when(at > 0, F.substr(key, at)).otherwise("")


def _places(keys: list[str], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and the bits inside it (one in each of eight 64-bit words) of every key."""
    h = np.array([xxhash.xxh3_64_intdigest(k.encode()) for k in keys], np.uint64)
    block = (h >> np.uint64(32)) % np.uint64(blocks)
    spread = h[:, None] * np.array([2 * i + 0x9E3779B97F4A7C15 for i in range(WORDS)], np.uint64)[None, :]
    return block.astype(np.int64), np.uint64(1) << (spread >> np.uint64(58))


def bloom_filter(listed: DataFrame, key: str = "key", bits_per_key: int = BITS_PER_KEY, max_blocks: int = MAX_BLOCKS) -> np.ndarray:
    """Blocks of the filter (blocks x 8 words); they are filled on Spark and at most ``max_blocks`` rows come to the driver."""
    blocks = int(min(max_blocks, max(1, listed.count() * bits_per_key // (64 * WORDS) + 1)))

    def fill(column: pa.Array) -> pa.Array:
        block, bits = _places(column.fill_null("").to_pylist(), blocks) if len(column) else (np.zeros(0, np.int64), np.zeros((0, WORDS), np.uint64))
        fields = [pa.array(block)] + [pa.array(bits[:, i].copy().view(np.int64)) for i in range(WORDS)]
        return pa.StructArray.from_arrays(fields, ["block", *(f"w{i}" for i in range(WORDS))])

    kind = "struct<block: bigint, " + ", ".join(f"w{i}: bigint" for i in range(WORDS)) + ">"
    rows = listed.select(F.arrow_udf(fill, kind)(key).alias("f")).select("f.*")
    out = np.zeros((blocks, WORDS), np.int64)
    for r in rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]).collect():
        out[r["block"]] = [r[f"w{i}"] for i in range(WORDS)]
    return out.view(np.uint64)


def url_keys(host: str, path: str, shapes: list[tuple[int, int]]) -> list[str]:
    """Keys under which a URL may be listed; ``shapes``: the (labels of the host, length of the path) that listed keys have."""
    if not host or not shapes:
        return []
    most = max(n for n, _ in shapes)
    labels = host.rsplit(".", most)  # a host of more labels keeps its head in one piece, which no listed key reaches
    whole = len(labels) if len(labels) <= most else most
    ends = {n: ".".join(labels[-n:]) for n in {n for n, _ in shapes} if n <= whole}
    return [ends[n] + path[:k] for n, k in shapes if n in ends and k <= len(path)]


def judge_urls(pages: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, entry (the longest listed key of the smallest ``tier`` that fits, else null) and verdict, for each row.

    ``listed``: key, action and tier (entries of a smaller tier win over longer ones of a larger).
    """
    spark = pages.sparkSession
    entries = listed.groupBy("tier", "key").agg(F.min("action").alias("action"))
    own_host, own_path = _split_key(F.col("key"))
    n_labels = F.char_length(own_host) - F.char_length(F.replace(own_host, F.lit("."), F.lit(""))) + 1
    shapes = sorted(tuple(r) for r in entries.select(n_labels, F.char_length(own_path)).distinct().collect())  # label counts and path lengths in use: few
    shared = spark.sparkContext.broadcast(bloom_filter(entries.select("key").distinct()))

    def possible(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        table = shared.value
        keys = [url_keys(h, p, shapes) for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
        flat = [k for own in keys for k in own]
        if not flat:
            return pa.array([[] for _ in keys], pa.list_(pa.string()))
        block, bits = _places(flat, len(table))
        passed = iter(((table[block] & bits) == bits).all(axis=1).tolist())
        return pa.array([[k for k in own if next(passed)] for own in keys], pa.list_(pa.string()))

    base = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    probed = base.withColumn("keys", F.arrow_udf(possible, "array<string>")("host", "path"))
    clear = probed.filter(F.size("keys") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("entry"), F.lit(None).cast("int").alias("tier"), F.lit(default).alias("verdict"))
    same = ["page_id", "host", "path"]  # rows that are alike are judged together and given back one by one
    rows = probed.filter(F.size("keys") > 0).groupBy(*same).agg(F.first("keys").alias("keys"), F.count("*").alias("n_rows"))
    hits = rows.select(*same, "n_rows", F.explode("keys").alias("key"))
    small = entries.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    met = hits.join(broadcast_if_small(entries, BROADCAST_KEYS), "key", "left") if small else join_hot_keys(hits, entries, ["key"], "left")
    best = F.max_by(F.struct("key", "tier", "action"), F.when(F.col("action").isNotNull(), F.struct(-F.col("tier"), F.char_length("key"), F.col("key"))))
    judged = met.groupBy(*same).agg(F.max("n_rows").alias("n_rows"), best.alias("best")).withColumn("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_rows"))))
    judged = judged.select("page_id", "host", "path", F.col("best.key").alias("entry"), F.col("best.tier").alias("tier"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
    return clear.union(judged)


def listed_entries(spark, rules=RULES, listed=LISTED) -> DataFrame:
    """Rules in tier 0, the list in tier 1."""
    return spark.createDataFrame([(k, a, 0) for k, a in rules] + [(k, a, 1) for k, a in listed], "key string, action string, tier int")

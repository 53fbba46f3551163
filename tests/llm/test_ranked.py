"""Ranked search against a walk over all documents."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from pixelquarry.llm import queries, ranked

SF = "/root/testdata/sf0.001"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = Counter()
    for item, text in items:
        scored = []
        for at, (i, bag, n) in enumerate(bags):
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms(text) if t in bag)
            if score > 0:
                scored.append((-score, i is None, i or 0, at))
        for rank, (score, none, i, _) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, None if none else i, -score] += 1
    return out


def made(seed, n_docs=150):
    rng = np.random.default_rng(seed)
    words = ["alpha", "Beta", "ÉT", "é", "x1", "中文", "the", "THE", "of", "rare"] + [f"w{i}" for i in range(40)]
    texts = ["  ".join(words[j] for j in rng.zipf(1.4, rng.integers(0, 30)) if j < len(words)) + "." for _ in range(n_docs)]
    docs = [(int(i), texts[int(rng.integers(0, n_docs))]) for i in rng.permutation(n_docs)]
    docs += [(7, docs[3][1]), (7, docs[4][1]), (None, docs[5][1]), (None, None), (1000, None), (1001, ""), (1002, "-- ..."), (1003, "the " * 4000)]
    items = [(i, " ".join(words[j] for j in rng.integers(0, len(words), rng.integers(0, 9)))) for i in range(12)]
    items += [(3, items[2][1]), (3, items[2][1]), (20, None), (21, ""), (22, "nowhere found"), (None, "the of"), (23, "the the the rare rare"), (24, "THE; of\x00rare")]
    return docs, items


@pytest.mark.parametrize("block_bytes", [ranked.BLOCK_BYTES, 60])
def test_against_a_walk_over_all_documents(spark, block_bytes):
    docs, items = made(block_bytes)
    d = spark.createDataFrame([(i, t, "b", 0) for i, t in docs], "doc_id bigint, text string, bag string, m int").repartition(4)
    q = spark.createDataFrame([(i, t, 1, "s") for i, t in items], "item_id bigint, text string, score int, _text string").drop("_text").repartition(3)
    rows = ranked.rank_documents(d, q, 10, block_bytes=block_bytes)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in rows.collect()) == brute(docs, items, 10)


def test_broadcast_of_classes_is_only_a_plan(spark, monkeypatch):
    docs, items = made(5)
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(ranked, "BROADCAST_CLASSES", 0)
    monkeypatch.setattr(ranked, "CLASS_ROWS", 7)
    assert Counter(tuple(r) for r in ranked.rank_documents(d, q, 3).collect()) == brute(docs, items, 3)


def test_large_scores_are_added_as_integers(spark):
    docs, items = made(6, 30)
    items = [(1, "rare " * 700_000 + "the"), (2, "of the")]
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    want = brute(docs, [(1, "rare"), (2, "of the")], 10)
    got = ranked.rank_documents(d, q, 10).collect()
    assert {r for r in map(tuple, got) if r[0] == 2} == {r for r in want if r[0] == 2} and len(bags)


def test_copies_are_one_class(spark):
    docs = spark.createDataFrame([(i, "one two") for i in range(500, 0, -1)] + [(0, "two one  unrelated"), *((1000 + i, f"other {i}") for i in range(500))], "doc_id bigint, text string").repartition(6)
    items = spark.createDataFrame([(1, "two")], "item_id bigint, text string")
    rows = ranked.rank_documents(docs, items, 10).collect()
    assert sorted((r.rank, r.doc_id) for r in rows) == [(i, i) for i in range(1, 11)]


def test_nothing_to_rank(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert ranked.rank_documents(docs, items).count() == 0
    assert ranked.rank_documents(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), items.limit(0)).count() == 0
    assert ranked.rank_documents(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), spark.createDataFrame([(1, "-")], "item_id bigint, text string")).count() == 0


def test_query_matches_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = sorted(con.sql(queries.OP12_SQL).fetchall())
    assert want and sorted(tuple(r) for r in queries.op12_ranked_search(spark, SF).collect()) == want

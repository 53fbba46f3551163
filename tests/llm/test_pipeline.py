"""The pipeline against brute force over a small table."""

import numpy as np

import corpus_pipeline
from pixelquarry.llm import bpe, decontam, queries
from test_corpus import TIK, spaced_words, small

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, SF)
    assert kept.columns == docs.columns
    good = {r.doc_id: r.text for r in kept.collect()}
    unique = corpus_pipeline.dedup_stage(spark, kept, SF)
    sets = {}
    for i, t in good.items():
        w = spaced_words(small(t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    left, order = set(), sorted(sets)
    groups = {i: i for i in order}

    def root(i):
        while groups[i] != i:
            i = groups[i]
        return i

    for n, a in enumerate(order):
        for b in order[:n]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                groups[max(root(a), root(b))] = min(root(a), root(b))
    left = {i for i in order if root(i) == i}
    assert {r.doc_id for r in unique.select("doc_id").collect()} == left
    clean = corpus_pipeline.decontamination_stage(spark, unique, SF)
    items = [decontam.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = set()
    for i in left:
        body = decontam.words_of(good[i])
        spots = {}
        for at, w in enumerate(body):
            spots.setdefault(w, []).append(at)
        for item in items:
            for d in {at - j for j, w in enumerate(item) for at in spots.get(w, ())}:
                found = decontam.overlap(body, item, d, 4)
                if found and found[2] >= min(12, -(-4 * len(item) // 5)):
                    dirty.add(i)
    assert {r.doc_id for r in clean.select("doc_id").collect()} == left - dirty
    done = corpus_pipeline.tokens_stage(spark, clean, SF).collect()
    assert all(r.decoded_equal and r.n_tokens == len(r.ids) and r.ids == TIK.encode_ordinary(good[r.doc_id]) for r in done)


def test_run_goes_through_all_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 100 and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "tokens"]


def test_op2_matches_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = sorted(con.sql(queries.OP2_SQL).fetchall())
    assert sorted(tuple(r) for r in queries.op2_url_filter(spark, SF).collect()) == want


def test_decode_of_numbers():
    codec = bpe.BytePairs({b"a": 0, b"b": 1, b"ab": 2}, "[ab]+")
    assert codec.encode("aabab") == [0, 2, 2] and codec.decode(np.array([0, 2, 2])) == b"aabab"

"""Conversation tries against dictionaries of prefixes."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from pixelquarry.llm import queries, tries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, path string, depth string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = abs(c) - abs(c) % 5
        made[c] = tuple(turns.get(base if c >= 0 else -base, [])[:h] + own[h:])
    nodes = defaultdict(list)
    for c, path in made.items():
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
    children = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    out = Counter()
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if made[c] == p)))
        out[min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def some_rows(seed, n=120):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.permutation(n).tolist():
        c = c - 20
        kind = int(rng.integers(0, 6))
        length = 60 if c == 33 else int(rng.integers(1, 12))
        for t in range(length):
            text = "same start" if kind < 4 and t < 3 else f"é {rng.integers(0, 3)}" * int(rng.integers(0, 3))
            rows.append((c, t, "user" if t % 2 else None, text or None))
    copy = [(t, r, x) for c, t, r, x in rows if c == 0]
    rows += [(1000 + i, *x) for i in range(200) for x in copy]  # a common conversation
    rows += [rows[0], rows[1], (5, None, "user", "no number"), (5, None, "a", ""), (None, 0, "user", "no id"), (7777, 3, None, None), (7778, 0, "", "")]
    return rows


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_against_prefixes(spark, partitions):
    rows = some_rows(partitions)
    table = spark.createDataFrame([(*r, "p", "d") for r in rows], SCHEMA).repartition(4)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = tries.prefix_trie(tries.rebuild(tries.turn_lists(table)))
        assert got.columns == tries.NODES
        assert Counter(tuple(r) for r in got.collect()) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_upper_nodes_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(tries, "BROADCAST_UPPER", 0)
    monkeypatch.setattr(tries, "IDS_A_RUN", 3)
    rows = some_rows(9, 60)
    got = tries.prefix_trie(tries.rebuild(tries.turn_lists(spark.createDataFrame([(*r, "p", "d") for r in rows], SCHEMA))))
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tries.prefix_trie(tries.rebuild(tries.turn_lists(empty))).count() == 0
    null = spark.createDataFrame([(None, 0, "user", "x", "", "")], SCHEMA)
    assert tries.prefix_trie(tries.turn_lists(null)).count() == 0


def test_arrays_hold_exactly_the_paths():
    rng = np.random.default_rng(4)
    for _ in range(20):
        turns = [bytes(rng.integers(0, 256, tries.KEY, dtype=np.uint8)) for _ in range(int(rng.integers(2, 200)))]
        paths = sorted({b"".join(turns[i] for i in rng.integers(0, len(turns), rng.integers(0, 7)) ** 2 % len(turns)) for _ in range(400)})
        shard = tries.Shard(paths)
        prefixes = {p[: i * tries.KEY] for p in paths for i in range(len(p) // tries.KEY + 1)}
        assert (shard.array.check >= 0).sum() == len(prefixes)
        state_of = {}
        for depth, active, states in shard.walk():
            assert (states >= 0).all()
            for i, s in zip(active.tolist(), states.tolist(), strict=True):
                assert state_of.setdefault(s, paths[i][: depth * tries.KEY]) == paths[i][: depth * tries.KEY]
        assert set(state_of.values()) == prefixes
        assert shard.array.step(np.array([0]), np.array([10**6])).tolist() == [-1]


def test_long_conversation():
    paths = sorted([bytes(i % 251 for i in range(tries.KEY * 20_000)), bytes(tries.KEY)])
    assert sum(len(a) for _, a, _ in tries.Shard(paths).walk()) == 20_000 + 3


def test_query_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(con.sql(queries.OP13_SQL).fetchall(), key=key)
    assert len(want) > 20 and sorted((tuple(r) for r in queries.op13_conversation_trie(spark, SF).collect()), key=key) == want

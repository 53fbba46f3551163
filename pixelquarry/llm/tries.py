"""Prefix tries over conversations, as double arrays by prefix shard.

A conversation is the path of its turns, a turn the 128-bit digest of (role, text), so texts are read once and never shuffled. All paths are
range-partitioned in path order (equal ones by conversation id): each partition is a prefix shard, however common a first turn or a whole conversation
is. A shard numbers its turns densely, packs its distinct paths into the arrays BASE and CHECK (the child of state s by turn c is state BASE[s] + c, if
its CHECK is s), and traverses them for its nodes.

A node that other shards may hold too is a prefix of the shard's first or last path. Only these upper nodes are merged globally; there are at most two
paths of them a shard, so the last step over them, one task, grows with partitions, not with conversations. Ids of conversations that end in such a
node are hashed in order as a stream of short runs.

A task holds the distinct paths of its shard, about 150 bytes a node; a single conversation is worked on by one task.

Cases: rows without conv_id are left out; null roles and texts are empty; turns are ordered by number (null first), equal numbers by their digests;
repeated rows are turns each; a conversation without turns ends in the root; an empty table gives no node; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelquarry.operators.scaling import broadcast_if_small
from pixelquarry.session import materialise

KEY = 16
#: Codes up to which free places in the middle of the arrays are tried, and how many places.
FEW_CODES, TRIES = 64, 1024
IDS_A_RUN = 512
BROADCAST_UPPER = 200_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
PRIVATE, SHARED, ENDS = 0, 1, 2
PARTS = pa.schema([
    ("kind", pa.int8()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("n_bytes", pa.int64()), ("ends_sha256", pa.string()), ("ids", pa.string()),
])
PARTS_SQL = (
    "kind tinyint, key binary, parent_key binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, n_bytes bigint, ends_sha256 string, ids string"
)
NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


class DoubleArray:
    """BASE and CHECK over dense codes. State 0 is the root; a free place has CHECK -1."""

    def __init__(self) -> None:
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
        self.check[0] = 0
        self.low = 1  # no place below is free
        self.top = 1  # no place from here on is taken

    def _reach(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _free(self, count: int) -> np.ndarray:
        """The first ``count`` free places."""
        width = 2 * count + 64
        while True:
            self._reach(self.low + width)
            found = np.flatnonzero(self.check[self.low : self.low + width] < 0)
            if len(found) >= count:
                return found[:count] + self.low
            width *= 2

    def _take(self, places: np.ndarray, parents: np.ndarray | int) -> None:
        self.check[places] = parents
        self.top = max(self.top, int(places.max()) + 1)

    def add_single(self, parents: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Children of states that have one each: any free places will do."""
        if not len(parents):
            return parents
        places = self._free(len(parents))
        self.base[parents] = places - codes
        self._take(places, parents)
        self.low = int(places[-1]) + 1
        return places

    def add_children(self, parent: int, codes: np.ndarray) -> np.ndarray:
        """Children of one state: the first of some places where all fit, else behind everything."""
        base = None
        if len(codes) <= FEW_CODES:
            tries = self._free(TRIES) - codes[0]
            self._reach(int(tries[-1] + codes.max()) + 1)
            for code in codes:
                tries = tries[tries + code > 0]
                tries = tries[self.check[tries + code] < 0]
            base = int(tries[0]) if len(tries) else None
        if base is None:
            base = self.top - int(codes.min())
        places = base + codes
        self._reach(int(places.max()) + 1)
        self.base[parent] = base
        self._take(places, parent)
        return places

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Children by code, -1 where there is none."""
        to = self.base[states] + codes
        inside = (to > 0) & (to < len(self.check))
        to = np.where(inside, to, 0)
        return np.where(inside & (self.check[to] == states), to, -1)


class Shard:
    """The trie of distinct paths in ascending order."""

    def __init__(self, paths: list[bytes]) -> None:
        self.sizes = np.fromiter(map(len, paths), np.int64, len(paths)) // KEY
        self.starts = np.cumsum(self.sizes) - self.sizes
        raw = b"".join(paths)
        turns = pa.Array.from_buffers(pa.binary(KEY), len(raw) // KEY, [None, pa.py_buffer(raw)]).dictionary_encode()
        own = turns.indices.to_numpy()
        code = np.full(len(turns.dictionary), -1, np.int64)  # dense turn ids, by level, so that siblings lie together
        self.array = DoubleArray()
        state = np.zeros(len(paths), np.int64)
        known, active, depth = 0, np.flatnonzero(self.sizes > 0), 0
        while len(active):
            turn, at = own[self.starts[active] + depth], state[active]
            new = np.append(True, (turn[1:] != turn[:-1]) | (at[1:] != at[:-1]))
            fresh, place = np.unique(turn[new & (code[turn] < 0)], return_index=True)
            code[fresh[np.argsort(place)]] = known + 1 + np.arange(len(fresh))
            known += len(fresh)
            state[active] = self._level(at[new], code[turn[new]])[np.cumsum(new) - 1]
            depth += 1
            active = active[self.sizes[active] > depth]
        self.codes = code[own]

    def _level(self, parents: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Places of children; those of one parent stand together."""
        places = np.empty(len(parents), np.int64)
        first = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
        count = np.diff(np.append(first, len(parents)))
        for lo, n in zip(first[count > 1].tolist(), count[count > 1].tolist(), strict=True):
            places[lo : lo + n] = self.array.add_children(int(parents[lo]), codes[lo : lo + n])
        alone = first[count == 1]
        places[alone] = self.array.add_single(parents[alone], codes[alone])
        return places

    def walk(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Traverses the arrays with all paths at once: (depth, paths that go on, their states)."""
        active, states, depth = np.arange(len(self.sizes)), np.zeros(len(self.sizes), np.int64), 0
        while len(active):
            yield depth, active, states
            longer = self.sizes[active] > depth
            active, states = active[longer], states[longer]
            states = self.array.step(states, self.codes[self.starts[active] + depth])
            depth += 1


def _digests(path: bytes) -> list[bytes]:
    """Key of every prefix of a path, the empty one first."""
    h, out = hashlib.sha256(), []
    for at in range(0, len(path) + KEY, KEY):
        out.append(h.copy().digest()[:KEY])
        h.update(path[at : at + KEY])
    return out


class _Ends:
    """Distinct paths of sorted rows. Ids of a path are hashed once it can't be a prefix of the last path any more; the first path's are kept."""

    def __init__(self) -> None:
        self.paths: list[bytes] = []
        self.sizes: list[list[int]] = []
        self.firsts: list[int] = []
        self.counts: list[int] = []
        self.sha: list[str | None] = []
        self.open: list[tuple[int, list[int]]] = []  # paths that are prefixes of the one at hand, and their ids

    def add(self, path: bytes, sizes: list[int], conv_id: int) -> None:
        if not self.paths or self.paths[-1] != path:
            self._close(path)
            self.open.append((len(self.paths), []))
            self.paths.append(path)
            self.sizes.append(sizes)
            self.firsts.append(conv_id)
            self.counts.append(0)
            self.sha.append(None)
        self.counts[-1] += 1
        self.open[-1][1].append(conv_id)

    def _close(self, path: bytes) -> None:
        while self.open and not path.startswith(self.paths[self.open[-1][0]]):
            at, ids = self.open[-1]
            if at == 0:
                return  # the first path's rows may go on in the shard before
            self.open.pop()
            self.sha[at] = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def _shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = _Ends()
    for batch in batches:
        for conv_id, path, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found.add(path, sizes, conv_id)
    if not found.paths:
        return
    shard = Shard(found.paths)
    array, counts, firsts = shard.array, np.array(found.counts), np.array(found.firsts)
    size = len(array.check)
    n_convs, conv_id = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
    depth_of, n_bytes, last_state = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(len(counts), np.int64)
    flat = np.fromiter((b for sizes in found.sizes for b in sizes), np.int64, int(shard.sizes.sum()))
    levels, shared, keys = [], np.zeros(size, bool), {}
    borders = {0: _digests(found.paths[0]), len(counts) - 1: _digests(found.paths[-1])}
    for depth, active, states in shard.walk():
        np.add.at(n_convs, states, counts[active])
        np.minimum.at(conv_id, states, firsts[active])
        depth_of[states] = depth
        if depth:
            n_bytes[states] = flat[shard.starts[active] + depth - 1]
        ends = shard.sizes[active] == depth
        last_state[active[ends]] = states[ends]
        levels.append(states[np.append(True, states[1:] != states[:-1])])
        for border, digests in borders.items():
            at = np.searchsorted(active, border)
            if at < len(active) and active[at] == border:
                shared[states[at]] = True
                keys[int(states[at])] = digests[depth]
    n_children, own_children = np.zeros(size, np.int64), np.zeros(size, np.int64)
    n_leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for states in levels[:0:-1]:  # from the deepest to the root's children; what a shared node adds is known after the merge only
        np.add.at(n_children, array.check[states], 1)
        own = states[~shared[states]]
        n_leaves[own] += n_children[own] == 0
        saved[own] += (n_convs[own] - 1) * n_bytes[own]
        parents = array.check[own]
        np.add.at(n_leaves, parents, n_leaves[own])
        np.add.at(saved, parents, saved[own])
        np.add.at(own_children, parents, 1)
    sha = {int(s): h for s, h in zip(last_state, found.sha, strict=True) if h is not None}
    states = np.concatenate(levels)

    def rows(kind: int, at: np.ndarray, children: np.ndarray, **more: list) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(at), 10_000):
            own = at[lo : lo + 10_000]
            columns = {"kind": np.full(len(own), kind), "conv_id": conv_id[own], "depth": depth_of[own], "n_convs": n_convs[own], "n_children": children[own]}
            columns |= {"n_leaves": n_leaves[own], "saved_tokens": saved[own], "n_bytes": n_bytes[own]} | {k: v[lo : lo + 10_000] for k, v in more.items()}
            yield _batch(columns, len(own))

    private = states[~shared[states]]
    above = array.check[private]
    under = shared[above].tolist()
    yield from rows(
        PRIVATE, private, n_children, ends_sha256=[sha.get(s, EMPTY_SHA) for s in private.tolist()],
        parent_conv_id=[None if u else c for u, c in zip(under, conv_id[above].tolist(), strict=True)],
        parent_key=[keys[a] if u else None for u, a in zip(under, above.tolist(), strict=True)],
    )
    upper = states[shared[states]]
    yield from rows(SHARED, upper, own_children, key=[keys[s] for s in upper.tolist()], parent_key=[keys[int(array.check[s])] if s else None for s in upper.tolist()])
    for at, ids in found.open:
        key = keys[int(last_state[at])]
        for lo in range(0, len(ids), 1000 * IDS_A_RUN):
            runs = [ids[i : i + IDS_A_RUN] for i in range(lo, min(lo + 1000 * IDS_A_RUN, len(ids)), IDS_A_RUN)]
            yield _batch({"kind": [ENDS] * len(runs), "key": [key] * len(runs), "conv_id": [r[0] for r in runs], "ids": [",".join(map(str, r)) for r in runs]}, len(runs))


def _batch(columns: dict, count: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in PARTS], schema=PARTS)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtree sums over the merged upper nodes."""
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: -r["depth"])
    at = {r["key"]: r for r in rows}
    for r in rows:
        r["n_leaves"] += r["n_children"] == 0
        r["saved_tokens"] += (r["n_convs"] - 1) * r["n_bytes"]
        up = at.get(r["parent_key"]) if r["depth"] else None
        r["parent_conv_id"] = up and up["conv_id"]
        if up:
            up["n_children"] += 1
            up["n_leaves"] += r["n_leaves"]
            up["saved_tokens"] += r["saved_tokens"]
    names = ["key", *NODES[:-1]]
    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], PARTS.field(n).type) for n in names], names=names)


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of every key's runs, one after another; only the running hash is held."""
    key, h = None, None
    for batch in batches:
        out = []
        for own, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own != key:
                if h:
                    out.append((key, h.hexdigest()))
                key, h = own, hashlib.sha256()
            else:
                h.update(b",")
            h.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.string()), strict=True)], ["key", "ends_sha256"])
    if h:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()])], ["key", "ends_sha256"])


def turn_lists(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, as (key in hex, n_bytes of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * KEY)
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), F.coalesce(F.col("turn"), F.lit(0)).alias("turn"), digest.alias("key"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t"))
    ordered = F.array_sort(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["key"].alias("key"), t["n_bytes"].alias("n_bytes"))).alias("turns"))


def rebuild(lists: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of conversation c - c % ``family``; h: crc32 of c's decimal, modulo ``heads``.

    A family has a handful of conversations, so its rows meet by its id and never more.
    """
    made = lists.withColumn("_base", F.expr(f"conv_id - conv_id % {family}")).withColumn("_h", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int"))
    head = F.first(F.when(F.col("conv_id") == F.col("_base"), F.slice("turns", 1, heads - 1)), ignorenulls=True).over(Window.partitionBy("_base"))
    made = made.withColumn("_head", head)
    turns = F.concat(F.expr("coalesce(slice(_head, 1, _h), slice(turns, 1, 0))"), F.expr("slice(turns, _h + 1, greatest(size(turns) - _h, 0))"))
    return made.select("conv_id", turns.alias("turns"))


def prefix_trie(lists: DataFrame) -> DataFrame:
    """One row per distinct prefix of the turn lists.

    conv_id (smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves (childless nodes below or the node itself), saved_tokens
    (over the node and all below: members but one, times the bytes of the last text), ends_sha256 (of the ids that end here).
    """
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), ""))
    paths = lists.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["n_bytes"]).alias("sizes"))
    parts = materialise(paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_shard_nodes, PARTS_SQL))

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = parts.filter(f"kind = {SHARED}").groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("n_bytes").alias("n_bytes"), F.first("parent_key").alias("parent_key"), *sums)
    kinds = {f.name: k for f, k in zip(PARTS, PARTS_SQL.split(", "), strict=True)}
    upper = materialise(merged.repartition(1).mapInArrow(_totals, ", ".join(kinds[n] for n in ["key", *NODES[:-1]])))
    runs = parts.filter(f"kind = {ENDS}").repartition("key").sortWithinPartitions("key", "conv_id").select("key", "ids")
    ends = runs.mapInArrow(_hash_runs, "key binary, ends_sha256 string")
    upper_nodes = upper.join(ends, "key", "left").select(*NODES[:-1], F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))

    private = parts.filter(f"kind = {PRIVATE}")
    names = broadcast_if_small(upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent")), BROADCAST_UPPER)
    under = private.filter("parent_key IS NOT NULL").join(names, "parent_key").withColumn("parent_conv_id", F.col("_parent"))
    return upper_nodes.unionByName(under.select(*NODES)).unionByName(private.filter("parent_key IS NULL").select(*NODES))

r"""SimHash near-duplicates by a binary trie self-join.

A fingerprint bit is set where more than half of a text's shingle hashes have it. Distinct fingerprints are joined with themselves: for every way of
choosing the blocks of bits in which a pair of at most ``budget`` differing bits must agree (pigeonhole), fingerprints with equal chosen blocks form
the subtrie below one node; its node pairs are traversed together, differing bits are added up along the way, and a pair is left as soon as the sum
passes the budget. A subtrie gives the links that join its members into classes, never all its pairs. More fingerprints mean more blocks, so subtries
stay small; one that is still above ``SUBTRIE`` (different texts that are all close) goes another exact way in linear size: fingerprints within
``budget`` bits share a key within half the budget of both, and all holders of such a key belong together.

Links are then made into connected components by large-star and small-star steps, each written to the shared folder.

Words are ``[^\x20\x09-\x0D]+`` with A-Z in lower case. Cases: null and empty texts have fingerprint zero and are linked like any other; fewer words
than a shingle form one; repeated rows and equal texts share a class; ties take the smallest id; a null id is kept (and is the component's id only if
all its ids are null); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelquarry.llm import words as W
from pixelquarry.operators.scaling import broadcast_if_small, join_hot_keys
from pixelquarry.session import materialise

SEED = 42
BUDGET = 4
BITS = 64
#: Fingerprints expected below a node; decides how many blocks are chosen.
NODE = 64
#: Fingerprints of one subtrie in one task at most.
SUBTRIE = 1 << 14
#: Node pairs that are expanded at once.
FRONT = 1 << 19
#: Hash rows of a join key from which on it is spread.
HOT_ROWS = 200_000
#: Rows of two numbers that are broadcast at most, so that the texts they are joined with need not move; more are shuffled.
BROADCAST_NODES = 1_000_000


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of ``words`` words (of all words of shorter texts), and its row."""
    w = W.split(data, offsets, W.NOT_SPACE)
    if not len(w.starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lengths = w.ends - w.starts
    place = np.cumsum(lengths + 1) - lengths - 1
    joined = np.full(int(place[-1] + lengths[-1]), 0x20, np.uint8)
    bytes_at = np.flatnonzero(W.NOT_SPACE[w.data])
    joined[bytes_at + np.repeat(place - w.starts, lengths)] = w.data[bytes_at]
    n = w.per_row()
    first = np.cumsum(n) - n
    own = np.arange(len(w.starts)) - first[w.row]
    begin = np.flatnonzero((own + words <= n[w.row]) | (own == 0))
    last = np.minimum(begin + words, first[w.row[begin]] + n[w.row[begin]]) - 1
    text, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = [digest(text[a:b], SEED) for a, b in zip(place[begin].tolist(), (place[last] + lengths[last]).tolist(), strict=True)]
    return np.array(hashes, np.uint64), w.row[begin]


def fingerprint_rows(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros(rows, np.uint64)
    if len(hashes):
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        counts = np.diff(np.append(starts, len(row)))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        out[row[starts]] = np.packbits(2 * sums > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint(text: Column, words: int = 4) -> Column:
    """64-bit SimHash of a text column, as a signed long."""

    def scan(column: pa.Array) -> pa.Array:
        data, offsets = W.texts(column)
        parts = [np.zeros(0, np.uint64)]
        for lo, hi in W.slices(offsets, W.SLICE_BYTES // 2):
            hashes, row = shingle_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words)
            parts.append(fingerprint_rows(hashes, row, hi - lo))
        return pa.array(np.concatenate(parts).view(np.int64))

    return F.arrow_udf(scan, "bigint")(text)


def block_tables(count: int, budget: int = BUDGET) -> list[list[tuple[int, int]]]:
    """Orders of bit blocks (start, width), the chosen ones first: any pair within ``budget`` agrees in the chosen blocks of one order.

    The number of chosen blocks grows until ``count`` fingerprints leave about ``NODE`` below a node.
    """
    for chosen in range(1, 5):
        blocks = budget + chosen
        cuts = [BITS * i // blocks for i in range(blocks + 1)]
        spans = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
        if chosen == 4 or count <= NODE << min(sum(w for _, w in sorted(spans, key=lambda s: s[1])[:chosen]), 62):
            return [[spans[i] for i in pick] + [s for i, s in enumerate(spans) if i not in pick] for pick in combinations(range(blocks), chosen)]
    raise AssertionError


def chosen_bits(order: list[tuple[int, int]], budget: int = BUDGET) -> int:
    return sum(w for _, w in order[: len(order) - budget])


def _reordered(order: list[tuple[int, int]], column: str) -> Column:
    """Bits of ``column`` with the blocks in the given order, the first on top."""
    out, at = None, BITS
    for start, width in order:
        at -= width
        part = F.shiftleft(F.shiftrightunsigned(column, start).bitwiseAND(F.lit((1 << width) - 1)), at)
        out = part if out is None else out.bitwiseOR(part)
    return out


def restore(keys: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    out, at = np.zeros(len(keys), np.uint64), BITS
    for start, width in order:
        at -= width
        out |= (keys >> np.uint64(at) & np.uint64((1 << width) - 1)) << np.uint64(start)
    return out


class _Classes:
    """Classes of numbered members, each known by its smallest."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def trie_classes(keys: np.ndarray, starts: np.ndarray, stops: np.ndarray, depth: int, budget: int = BUDGET) -> np.ndarray:
    """Smallest member (an index) of each key's class, over the subtries ``keys[start:stop]`` whose keys share ``depth`` leading bits.

    Keys are distinct and ascend within a subtrie. A node is a range of keys; its children are split at the first key that has the next bit set.
    """
    classes, zeros = _Classes(len(keys)), {}

    def split(lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
        if level not in zeros:
            count = np.zeros(len(keys) + 1, np.int32)
            np.cumsum((keys >> np.uint64(BITS - 1 - level) & np.uint64(1)) == 0, out=count[1:])
            zeros[level] = count
        return lo + zeros[level][hi] - zeros[level][lo]

    many = stops - starts > 1
    stack = [(depth, starts[many], stops[many], starts[many], stops[many], np.zeros(int(many.sum()), np.int8))]
    while stack:
        level, a, a2, b, b2, spent = stack.pop()
        single = (a2 - a == 1) & (b2 - b == 1)
        if single.any():  # one key each: the rest of their paths at once
            x, y = a[single], b[single]
            near = np.bitwise_count(keys[x] ^ keys[y]) <= budget
            classes.link(x[near], y[near])
            a, a2, b, b2, spent = a[~single], a2[~single], b[~single], b2[~single], spent[~single]
        if not len(a):
            continue
        if len(a) > FRONT:
            for part in np.array_split(np.arange(len(a)), -(-len(a) // FRONT)):
                stack.append((level, a[part], a2[part], b[part], b2[part], spent[part]))
            continue
        if level == BITS:
            continue
        am, bm, same = split(a, a2, level), split(b, b2, level), a == b
        pairs = [(a, am, b, bm, spent, None), (am, a2, bm, b2, spent, None), (a, am, bm, b2, spent + 1, None), (am, a2, b, bm, spent + 1, ~same)]
        kept = []
        for p, p2, q, q2, cost, only in pairs:
            ok = (p2 > p) & (q2 > q) & (cost <= budget) & ~((p == q) & (p2 - p == 1))
            if only is not None:
                ok &= only
            kept.append([v[ok] for v in (p, p2, q, q2, cost)])
        stack.append((level + 1, *(np.concatenate(v) for v in zip(*kept, strict=True))))
    return classes.root


def fingerprint_links(fingerprints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Links (a, b) that join distinct fingerprints of at most ``budget`` differing bits into classes. ``fingerprints``: column fp, distinct, stored."""
    count = fingerprints.count()
    orders = block_tables(count, budget)
    top = min(chosen_bits(o, budget) for o in orders)  # blocks differ in width; flips of a chosen bit do no harm
    keyed = fingerprints.select(F.posexplode(F.array(*[_reordered(o, "fp") for o in orders])).alias("t", "key"))
    widths = F.array(*[F.lit(chosen_bits(o, budget)) for o in orders])
    keyed = keyed.withColumn("node", F.call_function("shiftrightunsigned", F.col("key"), F.lit(BITS) - widths[F.col("t")]))
    large = keyed.groupBy("t", "node").count().filter(F.col("count") > SUBTRIE).select("t", "node")
    # few at most: each stands for more than SUBTRIE keys
    n_large = large.count() if count > SUBTRIE else 0
    small = keyed.join(large, ["t", "node"], "left_anti") if n_large else keyed
    small = small.repartition("t", "node").sortWithinPartitions("t", "node", "key")

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: pa.Table) -> pa.RecordBatch:
            t, node, keys = (np.asarray(rows.column(i).combine_chunks()) for i in range(3))
            keys = keys.view(np.uint64)
            starts = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (node[1:] != node[:-1])))
            stops = np.append(starts[1:], len(t))
            out = []
            for one in np.unique(t[starts]):
                own = t[starts] == one
                lo, hi = int(starts[own][0]), int(stops[own][-1])
                root = trie_classes(keys[lo:hi], starts[own] - lo, stops[own] - lo, chosen_bits(orders[one], budget), budget)
                moved = np.flatnonzero(root != np.arange(hi - lo))
                fps = restore(keys[lo:hi], orders[one])
                out.append((fps[moved], fps[root[moved]]))
            a, b = (np.concatenate([x[i] for x in out]).view(np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        kept: list[pa.RecordBatch] = []
        for batch in batches:  # whole nodes only: the last one of a batch may go on in the next
            kept.append(batch)
            rows = pa.Table.from_batches(kept)
            t, node = np.asarray(rows.column(0)), np.asarray(rows.column(1))
            turn = np.flatnonzero((t[1:] != t[:-1]) | (node[1:] != node[:-1]))
            if len(turn):
                cut = int(turn[-1]) + 1
                yield flush(rows.slice(0, cut))
                kept = rows.slice(cut).combine_chunks().to_batches()
        if kept:
            yield flush(pa.Table.from_batches(kept))

    links = small.select("t", "node", "key").mapInArrow(traverse, "a bigint, b bigint")
    if n_large:
        half = budget // 2
        near = [np.bitwise_or.reduce(np.uint64(1) << np.array(f, np.uint64)) if f else np.uint64(0) for r in range(half + 1) for f in combinations(range(BITS - top), r)]
        flips = np.array(near, np.uint64)

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    t, key = np.asarray(batch.column(0))[at : at + 512], np.asarray(batch.column(1)).view(np.uint64)[at : at + 512]
                    keys = (key[:, None] ^ flips[None, :]).ravel().view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(t, len(flips)), pa.int32()), pa.array(keys), pa.array(np.repeat(key, len(flips)).view(np.int64))], ["t", "near", "key"])

        balls = keyed.join(large, ["t", "node"], "left_semi").select("t", "key").mapInArrow(spread, "t int, near bigint, key bigint")
        heads = balls.groupBy("t", "near").agg(F.min("key").alias("head"))
        stars = balls.join(heads, ["t", "near"]).filter("key <> head").select("t", "key", "head").distinct()
        back = F.arrow_udf(lambda t, k: pa.array(_restore_each(np.asarray(t), np.asarray(k).view(np.uint64), orders).view(np.int64)), "bigint")
        links = links.union(stars.select(back("t", "key").alias("a"), back("t", "head").alias("b")))
    return links


def _restore_each(t: np.ndarray, keys: np.ndarray, orders: list[list[tuple[int, int]]]) -> np.ndarray:
    out = np.zeros(len(keys), np.uint64)
    for one in np.unique(t):
        out[t == one] = restore(keys[t == one], orders[one])
    return out


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links; root is the smallest node reachable. Large-star and small-star until nothing changes."""
    edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(edges)
    while before[0]:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = join_hot_keys(both, least, ["a"], "inner", HOT_ROWS).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        edges = materialise(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    stars = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def simhash_components(docs: DataFrame, words: int = 4, budget: int = BUDGET, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) for each row."""
    signed = materialise(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), words).alias("fp")))
    distinct = materialise(signed.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    linked = materialise(connected(fingerprint_links(distinct.select("fp"), budget)))
    classes = linked.withColumnRenamed("node", "fp").join(distinct, "fp")
    ids = classes.groupBy("root").agg(F.min("least_id").alias("component"))
    known = distinct.join(linked.withColumnRenamed("node", "fp").join(ids, "root").select("fp", "component"), "fp", "left")
    known = known.select("fp", F.coalesce("component", "least_id").alias("component_id"))
    named = join_hot_keys(signed, known, ["fp"], "inner", HOT_ROWS)
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Cells in which shingles are counted, to tell rare ones (a power of two).
RARITY_BITS = 20
#: Buckets of up to so many texts are compared pair by pair at once.
SMALL_BUCKET = 4
#: Members that all others of a larger bucket are compared with: in the first round, in the second, and how many times more in each that follows.
FIRST_HEADS, NEXT_HEADS, MORE_HEADS = 1, 16, 4


def shingle_counts(texts: DataFrame, words: int = 5) -> np.ndarray:
    """How many shingles of column ``text`` fall into each of the cells that the upper bits of their hash name."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            data, offsets = W.texts(batch.column(0))
            for lo, hi in W.slices(offsets, W.SLICE_BYTES // 2):
                hashes, _ = shingle_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words)
                cells, n = np.unique(hashes >> np.uint64(64 - RARITY_BITS), return_counts=True)
                counts[cells.astype(np.int64)] += n
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["cell", "n"])

    found = texts.select("text").mapInArrow(scan, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most 2 ** RARITY_BITS rows
    counts = np.zeros(1 << RARITY_BITS, np.int64)
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    return counts


def shingle_prefixes(text: Column, counts: Broadcast, words: int, similarity: float) -> Column:
    """(size, tokens): number of distinct shingles, and of these the first in one order for all texts, rare cells first.

    As many are given as leave fewer than a similar text must share, so two texts of ``similarity`` or more have one in common. A text without words has
    the token 0.
    """

    def scan(column: pa.Array) -> pa.Array:
        data, offsets = W.texts(column)
        sizes, out, cells = [], [], counts.value
        for i in range(len(offsets) - 1):
            hashes, _ = shingle_hashes(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]), words)
            own = np.unique(hashes)
            own = own[np.argsort(cells[(own >> np.uint64(64 - RARITY_BITS)).astype(np.int64)], kind="stable")]
            sizes.append(len(own))
            out.append(own[: len(own) - math.ceil(similarity * len(own) - 1e-6) + 1] if len(own) else np.zeros(1, np.uint64))
        tokens = W.lists(np.concatenate([np.zeros(0, np.uint64), *out]).view(np.int64), np.array([len(x) for x in out], np.int64), pa.int64())
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), tokens], ["size", "tokens"])

    return F.arrow_udf(scan, "struct<size: int, tokens: array<bigint>>")(text)


def shingle_sets(text: Column, words: int = 5) -> Column:
    """Distinct shingle hashes of a text, ascending."""

    def scan(column: pa.Array) -> pa.Array:
        data, offsets = W.texts(column)
        out = []
        for i in range(len(offsets) - 1):
            hashes, _ = shingle_hashes(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]), words)
            out.append(np.unique(hashes.view(np.int64)))
        return W.lists(np.concatenate([np.zeros(0, np.int64), *out]), np.array([len(x) for x in out], np.int64), pa.int64())

    return F.arrow_udf(scan, "array<bigint>")(text)


def _jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.asarray(x.values), np.asarray(y.values)
        both = len(np.intersect1d(x, y, assume_unique=True))
        every = len(x) + len(y) - both
        out.append(both / every if every else 1.0)
    return pa.array(out, pa.float64())


def _similar(pairs: DataFrame, bearers: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose share of common shingles is ``similarity`` or more."""
    ends = materialise(pairs.select(F.col("a").alias("_node")).union(pairs.select("b")).distinct())
    bodies = bearers.join(broadcast_if_small(ends, BROADCAST_NODES), F.col("node") == F.col("_node"), "left_semi")
    sets = materialise(bodies.select("node", shingle_sets(F.col("text"), words).alias("set")))
    both = join_hot_keys(pairs, sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), ["a"], "inner", HOT_ROWS)
    both = join_hot_keys(both, sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), ["b"], "inner", HOT_ROWS)
    return materialise(both.filter(F.arrow_udf(_jaccard, "double")("set_a", "set_b") >= similarity).select("a", "b"))


def fingerprint_pairs(bearers: DataFrame, words: int = 5, budget: int = BUDGET) -> DataFrame:
    """Pairs (a, b) of texts in one class of the trie self-join: each with the smallest node of its class, so no more pairs than texts."""
    signed = materialise(bearers.select("node", fingerprint(F.col("text"), words).alias("fp")))
    linked = connected(fingerprint_links(materialise(signed.select("fp").distinct()), budget))
    firsts = signed.groupBy("fp").agg(F.min("node").alias("least"))
    classes = materialise(firsts.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    heads = classes.join(classes.groupBy("root").agg(F.min("least").alias("a")), "root").select("fp", "a")
    return materialise(join_hot_keys(signed, heads, ["fp"], "inner", HOT_ROWS).filter("a <> node").select("a", F.col("node").alias("b")))


def similar_links(bearers: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Links (a, b) that join all texts whose share of common shingles is ``similarity`` or more into classes. ``bearers``: node, text, one row per text.

    The trie self-join of the SimHash fingerprints comes first: its classes are verified and merged. What fingerprints of so few bits apart miss is found
    by rare shingles, between texts that are still of different classes.

    Texts with a common prefix token form a bucket. In each round some members of a bucket, its heads, are compared with all its members of other classes,
    verified links merge classes, and heads leave. A bucket is done when its members are of one class or all compared; no pair of different classes is
    left out. Heads are of the bucket's largest class, those with the fewest rare shingles of their own first: so a group of near copies gathers around
    its middle, what has joined is not compared again, and what has not yet meets 16 more, then 64, and so on. A large group takes no square of its size.
    """
    counts = bearers.sparkSession.sparkContext.broadcast(shingle_counts(bearers, words))
    prefixes = bearers.select("node", shingle_prefixes(F.col("text"), counts, words, similarity).alias("p"))
    prefixes = prefixes.select("node", "p.size", F.posexplode("p.tokens").alias("pos", "token"))
    tried = fingerprint_pairs(bearers, words)
    links = _similar(tried, bearers, words, similarity)
    roots = materialise(connected(links))
    members = _ranked(prefixes, roots)
    share, most = similarity / (1 + similarity), FIRST_HEADS
    while not members.isEmpty():
        first = members.filter((F.col("rank") <= F.lit(most)) | (F.col("n") <= SMALL_BUCKET))
        first = first.select("token", F.col("node").alias("x"), F.col("size").alias("size_x"), F.col("pos").alias("pos_x"), F.col("rank").alias("rank_x"), F.col("root").alias("root_x"))
        met = join_hot_keys(members, first, ["token"], "inner", HOT_ROWS).filter("rank > rank_x AND root <> root_x")
        # a pair whose first common token this is can share no more than what follows it in both
        possible = F.least(F.col("size") - F.col("pos"), F.col("size_x") - F.col("pos_x")) + 1e-6 >= share * (F.col("size") + F.col("size_x"))
        met = met.filter(possible | ((F.col("size") == 0) & (F.col("size_x") == 0)))
        pairs = met.select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b")).distinct()
        pairs = materialise(pairs.join(tried, ["a", "b"], "left_anti"))
        tried = tried.union(pairs)
        links = links.union(_similar(pairs, bearers, words, similarity))
        left = members.filter((F.col("rank") > F.lit(most)) & (F.col("n") > SMALL_BUCKET)).drop("n", "rank", "root")
        if left.isEmpty():
            break
        roots = materialise(connected(links))
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        members, most = _ranked(left, roots), max(NEXT_HEADS, most * MORE_HEADS)
    return links


def _ranked(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the buckets of several classes, with their class, the bucket's size and their rank as heads."""
    bucket = Window.partitionBy("token")
    merged = broadcast_if_small(roots.withColumnRenamed("root", "_root"), BROADCAST_NODES)
    members = members.join(merged, "node", "left").withColumn("root", F.coalesce("_root", "node")).drop("_root")
    members = members.withColumn("n", F.count("*").over(bucket)).withColumn("_least", F.min("root").over(bucket)).withColumn("_most", F.max("root").over(bucket))
    members = members.filter("_least < _most").drop("_least", "_most").withColumn("_own", F.count("*").over(Window.partitionBy("token", "root")))
    return materialise(members.withColumn("rank", F.row_number().over(bucket.orderBy(F.desc("_own"), "root", "pos", "node"))).drop("_own"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` but one of each group of near duplicates, with all their columns; the smallest id stays.

    Four of 64 bits find only the closest copies (about three in a hundred at a similarity of 0.8), so candidates come from common rare shingles, which no
    similar pair can lack; each is verified by the exact share of common shingles, and groups are the components of verified links.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("node", F.xxhash64(F.coalesce("text", F.lit(""))))
    facts = materialise(source.select("doc_id", "node"))
    nodes = materialise(facts.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")))
    several = materialise(nodes.filter("n > 1").select(F.col("node").alias("_node"), F.col("least_id").alias("_least")))
    bearers = source.join(broadcast_if_small(several, BROADCAST_NODES), F.col("node") == F.col("_node"), "left")
    bearers = bearers.filter("_node IS NULL OR doc_id <=> _least").drop("_node", "_least")
    repeated = materialise(facts.groupBy("node", "doc_id").count().filter("count > 1").select(F.col("node").alias("_node"), F.col("doc_id").alias("_twice")))
    any_repeated = not repeated.isEmpty()
    if any_repeated:  # one row per text: its shingles once
        again = (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_twice"))
        bearers = bearers.join(repeated, again, "left_anti").union(bearers.join(repeated, again, "left_semi").dropDuplicates(["node"]))
    linked = connected(similar_links(bearers.select("node", "text"), words, similarity))
    members = linked.join(nodes.select("node", "least_id"), "node")
    stay = members.groupBy("root").agg(F.min_by("node", F.struct("least_id", "node")).alias("stay"))
    gone_nodes = members.join(stay, "root").filter("node <> stay").select("node")
    copies = facts.join(nodes.select("node", "least_id"), "node").filter(~F.col("doc_id").eqNullSafe(F.col("least_id"))).select("node", "doc_id")
    gone = facts.join(gone_nodes, "node", "left_semi").select("node", "doc_id").union(copies)
    gone = materialise(gone.select(F.col("node").alias("_node"), F.col("doc_id").alias("_gone")).distinct())
    node = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    kept = docs.join(broadcast_if_small(gone, BROADCAST_NODES), (node == gone["_node"]) & docs[doc_id].eqNullSafe(gone["_gone"]), "left_anti")
    if not any_repeated:
        return kept
    twice = (F.xxhash64(F.coalesce(kept[text], F.lit(""))) == repeated["_node"]) & kept[doc_id].eqNullSafe(repeated["_twice"])
    once = kept.join(repeated, twice, "left_semi").dropDuplicates([doc_id, text])
    return kept.join(repeated, twice, "left_anti").unionByName(once)

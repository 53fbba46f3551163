"""Ranked lexical search of many items over all documents, by bag deduplication.

Documents are restricted to the items' vocabulary. Those with the same term counts and the same length class m are one class (grouped by the whole
vector, so equal hashes alone never join two), each class is scored once against all items, and only the classes that can reach an item's list are
expanded to their members by ascending id.

The items are the stated query set: they go to the tasks in blocks of about ``block_bytes`` of distinct item texts, and each block runs over all
documents. A task keeps ``k`` classes an item, so what leaves it is bounded by items, not by documents. Counts, lengths and document frequencies cover
all documents. A class that a third of all documents share is one row after the map side; of its members only the ``k`` smallest ids leave a task.

Integer arithmetic is 64-bit; sums are added as doubles only where they are proven to stay below 2^53.

Cases: a null or empty text has no terms, isn't counted, and is in no list; an item without terms gets no rows; equal items are scored once and listed
each; documents with equal ids are listed each; null ids come after others of the same score; no documents or no items give an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelquarry.llm.pieces import spans, take_runs
from pixelquarry.llm.words import ALNUM, LOWER, slices, split, texts
from pixelquarry.operators.scaling import broadcast_if_small
from pixelquarry.session import materialise

BLOCK_BYTES = 4 << 20
BROADCAST_CLASSES = 20_000
SLICE_BYTES = 4 << 20
CLASS_ROWS = 8192
#: Fixed values of the score: share of the length in m, and how fast repeats saturate (both in hundredths and thousandths of the usual parameters).
LENGTH_PERCENT, SATURATION = 75, 8
RANKED = "item int, score bigint, m bigint, bag binary, first_id bigint"


def terms_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """Slices of rows: (number of rows, row of each term, the terms); lower-cased A to Z, letters and digits and all outside ASCII."""
    data, offsets = texts(column)
    for lo, hi in slices(offsets, SLICE_BYTES):
        own = data[offsets[lo] : offsets[hi]]
        words = split(own, offsets[lo : hi + 1] - offsets[lo], ALNUM)
        low = LOWER[own]
        yield hi - lo, words.row, spans(low[ALNUM[low]], np.append(0, np.cumsum(words.ends - words.starts)))


def pack(rows: np.ndarray, codes: np.ndarray, counts: np.ndarray, n_rows: int) -> pa.Array:
    """Bags as binary: pairs of unsigned 32-bit integers (term, occurrences), terms ascending."""
    pairs = np.stack([codes, counts], axis=1).astype("<u4")
    ends = np.cumsum(np.bincount(rows, minlength=n_rows)) * 8
    return pa.Array.from_buffers(pa.large_binary(), n_rows, [None, pa.py_buffer(np.append(0, ends).astype(np.int64).tobytes()), pa.py_buffer(pairs.tobytes())])


def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, occurrences) of every pair."""
    sizes = np.asarray(pc.binary_length(column), np.int64) // 8
    pairs = np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), pairs[:, 0], pairs[:, 1]


def document_bags(docs: DataFrame, vocabulary: pa.Array, doc_id: str, text: str) -> DataFrame:
    """doc_id, n (all terms, with repeats) and the bag over the vocabulary, of every document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.to_pylist())
    kind = pa.struct([("n", pa.int64()), ("bag", pa.binary())])

    def bags(column: pa.Array) -> pa.Array:
        known = pa.array(shared.value, pa.large_binary())
        counts, packed = [np.zeros(0, np.int64)], []
        for n_rows, row, terms in terms_of(column):
            counts.append(np.bincount(row, minlength=n_rows))
            coded = terms.dictionary_encode()
            codes = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False)[coded.indices.to_numpy()] if len(terms) else np.zeros(0, np.int64)
            hit = codes >= 0
            keys, tf = np.unique(row[hit] * len(known) + codes[hit], return_counts=True)
            packed.append(pack(keys // len(known), keys % len(known), tf, n_rows).cast(pa.binary()))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(counts), pa.int64()), pa.concat_arrays([pa.array([], pa.binary()), *packed])], fields=list(kind))

    found = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.arrow_udf(bags, "struct<n: bigint, bag: binary>")(F.col(text)).alias("f"))
    return found.select("doc_id", "f.*").filter("n > 0")


def document_frequencies(classes: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term; every task sends one row a term at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            row, term, _ = unpack(batch.column(0))
            np.add.at(total, term, np.asarray(batch.column(1), np.int64)[row])
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["term", "docs"])

    out = np.zeros(size, np.int64)
    for row in classes.select("bag", "n_docs").mapInArrow(count, "term bigint, docs bigint").groupBy("term").agg(F.sum("docs").alias("docs")).collect():
        out[row.term] = row.docs
    return out


class Best:
    """The k best classes of every item so far: highest score, then smallest member."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.rows: list[list[tuple]] = [[] for _ in range(items)]

    def offer(self, item: int, scores: np.ndarray, firsts: np.ndarray, m: np.ndarray, bags: pa.Array) -> None:
        rows = self.rows[item]
        at = np.flatnonzero(scores >= max(1, -rows[-1][0] if len(rows) == self.k else 1))
        if not len(at):
            return
        if len(at) > self.k:
            at = at[np.lexsort((firsts[at], -scores[at]))[: self.k]]
        rows += [(-int(scores[i]), int(firsts[i]), int(m[i]), bags[int(i)].as_py()) for i in at]
        rows.sort()
        del rows[self.k :]


def score_classes(classes: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, k: int) -> DataFrame:
    """The ``k`` best classes of every item in every task. ``items``: distinct terms and how often the item has each."""
    shared = classes.sparkSession.sparkContext.broadcast((items, weights))
    missing = np.iinfo(np.int64).max  # classes whose members all lack an id come last

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        best = Best(len(items), k)
        exact = [float((weights[t] * c).sum()) * 1e6 < 2**53 for t, c in items]
        for batch in batches:
            for at in range(0, batch.num_rows, CLASS_ROWS):
                part = batch.slice(at, CLASS_ROWS)
                bags, m = part.column(0), np.asarray(part.column(1), np.int64)
                firsts = np.asarray(pc.fill_null(part.column(2), missing), np.int64)
                row, term, tf = unpack(bags)
                gain = (1_000_000_000 * tf) // (1000 * tf + SATURATION * m[row])
                order = np.argsort(term, kind="stable")
                row, gain = row[order], gain[order]
                edges = np.searchsorted(term[order], np.arange(len(weights) + 1))
                sizes = np.diff(edges)
                for item, (own, times) in enumerate(items):
                    count = sizes[own]
                    near = take_runs(row, edges[own], count)
                    add = take_runs(gain, edges[own], count) * np.repeat(weights[own] * times, count)
                    if exact[item]:
                        scores = np.bincount(near, add, minlength=part.num_rows).astype(np.int64)
                    else:
                        scores = np.zeros(part.num_rows, np.int64)
                        np.add.at(scores, near, add)
                    best.offer(item, scores, firsts, m, bags)
        for item, rows in enumerate(best.rows):
            if rows:
                score, first, m, bag = zip(*rows, strict=True)
                columns = [pa.array([item] * len(rows), pa.int32()), pa.array([-s for s in score], pa.int64()), pa.array(m, pa.int64()), pa.array(bag, pa.binary())]
                firsts = pa.array([None if f == missing else f for f in first], pa.int64())
                yield pa.RecordBatch.from_arrays([*columns, firsts], ["item", "score", "m", "bag", "first_id"])

    return classes.select("bag", "m", "first_id").mapInArrow(score, RANKED)


def _block(docs: DataFrame, items: list[str], k: int, doc_id: str, text: str) -> DataFrame:
    """item (place in the list), rank, doc_id, score."""
    spark = docs.sparkSession
    found = [(n, row, terms) for n, row, terms in terms_of(pa.array(items))]
    base = np.cumsum([0, *(n for n, _, _ in found)])
    row = np.concatenate([r + b for (_, r, _), b in zip(found, base[:-1], strict=True)])
    coded = pa.concat_arrays([t for _, _, t in found]).dictionary_encode()
    codes = coded.indices.to_numpy()
    edges = np.searchsorted(row, np.arange(len(items) + 1))
    queries = [np.unique(codes[a:b], return_counts=True) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    bags = materialise(document_bags(docs, coded.dictionary, doc_id, text))
    n_docs, n_terms = bags.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    m = F.expr(f"{100 - LENGTH_PERCENT} + (({LENGTH_PERCENT} * n * {n_docs}L) div {n_terms}L)")
    bags = bags.filter(F.octet_length("bag") > 0).select("doc_id", m.alias("m"), "bag")
    classes = materialise(bags.groupBy("bag", "m").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_docs")))
    df = document_frequencies(classes, len(coded.dictionary))
    weights = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)

    by_item = Window.partitionBy("item")
    reach = F.row_number().over(by_item.orderBy(F.desc("score"), F.asc_nulls_last("first_id"), "m", "bag"))
    chosen = materialise(score_classes(classes, queries, weights, k).withColumn("_place", reach).filter(f"_place <= {k}").drop("_place", "first_id"))
    wanted = chosen.select("bag", "m").distinct()
    # only the k smallest ids of a class can be listed; the window limits each task's rows before they are shuffled
    place = F.row_number().over(Window.partitionBy("bag", "m").orderBy(F.asc_nulls_last("doc_id")))
    members = bags.join(broadcast_if_small(wanted, BROADCAST_CLASSES), ["bag", "m"], "left_semi").withColumn("_place", place).filter(f"_place <= {k}")
    listed = chosen.join(members.select("bag", "m", "doc_id"), ["bag", "m"]).select("item", "score", "doc_id")
    rank = F.row_number().over(by_item.orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = listed.withColumn("rank", rank).filter(f"rank <= {k}").select("item", "rank", "doc_id", "score")
    names = spark.createDataFrame(list(enumerate(items)), "item int, _text string")
    return ranked.join(names, "item").drop("item")


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``k`` best documents of every item: item_id, rank, doc_id, score (above 0; equal scores by ascending id)."""
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("_text")).filter("_text IS NOT NULL")
    distinct = items.select("_text").distinct()
    n_bytes = distinct.agg(F.coalesce(F.sum(F.octet_length("_text") + 16), F.lit(0))).first()[0]
    blocks = -(-n_bytes // block_bytes)
    out = docs.sparkSession.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id bigint, score bigint")
    for block in range(blocks):  # one for every few megabytes of items
        own = distinct.filter(F.pmod(F.xxhash64("_text"), F.lit(blocks)) == block).orderBy("_text").collect()
        if own:
            ranked = _block(docs, [r[0] for r in own], k, doc_id, text)
            out = out.unionByName(items.join(ranked, "_text").select("item_id", "rank", "doc_id", "score"))
    return out

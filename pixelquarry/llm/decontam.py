r"""Benchmark decontamination by spaced seeds.

Fixed masks pick the words of a window that are hashed and ignore the others, so an overlap is still hit when words were replaced. Every accepted overlap
is hit: its every beginning scores above zero, so it starts with r > penalty equal words, and after its first different word at least
2 * penalty + 1 - r more are equal; each r has its mask of 2 * penalty + 1 counted words. Hashes
of all windows of test items and of training texts are joined; each hit names a diagonal (text position minus item position), and the texts are
compared word by word along it. An overlap is the stretch that scores best with +1 for an equal and ``-penalty`` for a different word.

Training hashes first meet a bitmap of the test hashes (its size is fixed by ``BITMAP_BITS``, whatever the tables' sizes); what passes is joined
exactly. Candidates are written to the shared folder once; only texts with candidates meet them again.

Words are ``[^\x20\x09-\x0D]+`` of the text with A-Z in lower case. Cases: null and empty texts match nothing; an item of fewer than ``min_words`` words
is met by texts that have just its words (as a part of longer texts so few words tell nothing); items that may overlap in fewer words than a mask counts have a mask of their own; equal item texts count once, under the smallest item id; repeated rows
give one result; an empty table on either side gives an empty result; other columns are not read; a null doc_id stays null.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelquarry.llm import words as W
from pixelquarry.llm.keys import row_key
from pixelquarry.operators.scaling import broadcast_if_small
from pixelquarry.session import materialise

BITMAP_BITS = 22
BROADCAST_ROWS = 500_000
MIN_WORDS = 5
HITS = "array<struct<gram: bigint, pos: int>>"


def _needed(words: int, min_matched: int) -> int:
    """Equal words that an item of ``words`` words must share."""
    return min(min_matched, -(-4 * words // 5))


def _seeds(short: list[int], min_matched: int = 12, penalty: int = 4) -> list[tuple[int, list[int]]]:
    """(salt, places that count) of all masks, and of the run of words for items of each length in ``short``."""
    weight = 2 * penalty + 1
    masks = ["1" * run + "0" + "1" * (weight - run) for run in range(penalty + 1, weight)] + ["1" * weight]
    seeds = [(m, [i for i, x in enumerate(mask) if x == "1"]) for m, mask in enumerate(masks)]
    for n in sorted(short):
        need = _needed(n, min_matched)
        if need < weight:  # too short for a different word between two runs above the penalty, or that run itself
            seeds.append((100 * n, list(range(need if n < 2 * penalty + 3 else min(need, penalty + 1)))))
    return seeds


def _scan(column: pa.Array, seeds: list[tuple[int, list[int]]], bitmap: np.ndarray | None, only: np.ndarray | None = None) -> pa.Array:
    data, offsets = W.texts(column)
    parts = []
    for lo, hi in W.slices(offsets):
        own = offsets[lo : hi + 1] - offsets[lo]
        w = W.split(data[offsets[lo] : offsets[hi]], own, W.NOT_SPACE)
        h, n = w.hashes(), w.per_row()
        first = np.cumsum(n) - n
        rows, pos, found = [], [], []
        for salt, places in seeds:
            g, at = W.grams(h, w.row, places, salt)
            if salt >= 100 and bitmap is None:  # of a test item only its own length
                own_length = n[w.row[at]] == salt // 100
                g, at = g[own_length], at[own_length]
            if bitmap is not None:
                cell = g >> np.uint64(64 - BITMAP_BITS)
                passed = np.flatnonzero(bitmap[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63)) & np.uint64(1))
                g, at = g[passed], at[passed]
            rows.append(w.row[at])
            pos.append(at - first[w.row[at]])
            found.append(g)
        row = np.concatenate(rows)
        order = np.argsort(row, kind="stable")
        fields = pa.StructArray.from_arrays([pa.array(np.concatenate(found)[order].view(np.int64)), pa.array(np.concatenate(pos)[order].astype(np.int32))], ["gram", "pos"])
        ends = np.zeros(hi - lo + 1, np.int32)
        np.cumsum(np.bincount(row, minlength=hi - lo), out=ends[1:])
        parts.append(pa.ListArray.from_arrays(pa.array(ends), fields))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.struct([("gram", pa.int64()), ("pos", pa.int32())])))


def words_of(text: str | None) -> list[str]:
    small = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", small)


def best_stretch(equal: np.ndarray, penalty: int) -> tuple[int, int, int]:
    """(start, stop, score) of the stretch that scores best; the first of equals."""
    steps = np.append(0, np.cumsum(np.where(equal, 1, -penalty)))
    low = np.minimum.accumulate(steps)
    gain = steps - low
    stop = int(np.argmax(gain))
    start = int(np.flatnonzero(steps[: stop + 1] == low[stop])[-1])
    return start, stop, int(gain[stop])


def overlap(doc: list[str], item: list[str], diagonal: int, penalty: int) -> tuple[int, int, int] | None:
    """(first item word, length, equal words) of the best overlap along a diagonal."""
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if hi <= lo:
        return None
    equal = np.array([a == b for a, b in zip(item[lo:hi], doc[lo + diagonal : hi + diagonal], strict=True)])
    start, stop, _ = best_stretch(equal, penalty)
    return lo + start, stop - start, int(equal[start:stop].sum())


def _overlaps(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    min_matched: int = 12, penalty: int = 4, min_words: int = MIN_WORDS,
) -> DataFrame:
    """Overlaps with the key (a hash of id and text) of their row."""
    spark = docs.sparkSession
    tests = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item_text")).filter("item_text IS NOT NULL")
    tests = tests.groupBy("item_text").agg(F.min("item_id").alias("item_id"))
    n_words = F.size(F.regexp_extract_all("item_text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    tests = tests.withColumn("item", F.xxhash64("item_text")).withColumn("item_words", n_words)
    needed = F.least(F.lit(min_matched), F.ceil(F.col("item_words") * 4 / 5))
    tiny, tests = tests.filter(F.col("item_words").between(1, min_words - 1)), tests.filter(F.col("item_words") >= min_words)
    short = [r[0] for r in tests.filter(needed < 2 * penalty + 1).select("item_words").distinct().collect()]  # few lengths
    seeds = _seeds(short, min_matched, penalty)
    scan = F.arrow_udf(lambda column: _scan(column, seeds, None), HITS)
    grams = tests.select("item", F.explode(scan("item_text")).alias("hit")).select("item", F.col("hit.gram").alias("gram"), F.col("hit.pos").alias("t_pos"))
    grams = materialise(grams)
    cell = F.shiftrightunsigned("gram", 64 - BITMAP_BITS)
    cells = grams.groupBy((cell / 64).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {64 - BITMAP_BITS}) % 64 AS int))")).alias("bits"))
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    for r in cells.collect():  # at most 2 ** (BITMAP_BITS - 6) rows
        bitmap[r["at"]] = r["bits"]
    shared = spark.sparkContext.broadcast(bitmap.view(np.uint64))
    train = F.arrow_udf(lambda column: _scan(column, seeds, shared.value), HITS)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("key", row_key("doc_id", "text"))
    hits = source.select("key", F.explode(train("text")).alias("hit")).select("key", F.col("hit.gram").alias("gram"), F.col("hit.pos").alias("pos"))
    joined = hits.join(broadcast_if_small(grams, BROADCAST_ROWS), "gram")
    pairs = materialise(joined.select("key", "item", (F.col("pos") - F.col("t_pos")).alias("diagonal")).distinct())
    # pair by pair, so that a text that meets many items, or one item many times, is never gathered with all of them
    by_pair = pairs.groupBy("key", "item").agg(F.collect_list("diagonal").alias("diagonals"))
    met = source.join(broadcast_if_small(pairs.select("key").distinct(), BROADCAST_ROWS), "key", "left_semi").dropDuplicates(["key"])
    met = met.join(by_pair, "key").join(tests.select("item", "item_id", "item_text"), "item").select("key", "doc_id", "text", "item_id", "item_text", "diagonals")

    result = "array<struct<doc_start: int, doc_end: int, item_start: int, n_matched: int, similarity: double>>"
    names = ["doc_start", "doc_end", "item_start", "n_matched", "similarity"]

    def verify(texts: pa.Array, item_texts: pa.Array, diagonals: pa.Array) -> pa.Array:
        out, before, doc = [], None, []
        for body, item_text, own in zip(texts.to_pylist(), item_texts.to_pylist(), diagonals.to_pylist(), strict=True):
            if body != before:
                before, doc = body, words_of(body)
            item, found = words_of(item_text), set()
            for diagonal in own:
                met = overlap(doc, item, diagonal, penalty)
                if met and met[2] >= _needed(len(item), min_matched):
                    found.add((met[0] + diagonal, met[0] + diagonal + met[1], met[0], met[2], met[2] / met[1]))
            out.append([dict(zip(names, x, strict=True)) for x in sorted(found)])
        return pa.array(out, pa.list_(pa.struct([*((n, pa.int32()) for n in names[:-1]), (names[-1], pa.float64())])))

    found = met.select("key", "doc_id", "item_id", F.explode(F.arrow_udf(verify, result)("text", "item_text", "diagonals")).alias("o")).select("key", "doc_id", "item_id", "o.*")
    small = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda text: F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    shortest = tiny.withColumn("_words", words(F.translate("item_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    shortest = shortest.groupBy("_words").agg(F.min("item_id").alias("item_id"))
    if shortest.isEmpty():
        return found
    # only texts that can't have more than so few words are split
    brief = source.withColumn("_words", F.when(~F.coalesce("text", F.lit("")).rlike(rf"(?s)^\s*(\S+\s+){{{min_words}}}"), words(small)))
    n = F.size("_words")
    whole = brief.join(broadcast_if_small(shortest, BROADCAST_ROWS), "_words")
    return found.unionByName(whole.select("key", "doc_id", "item_id", F.lit(0).alias("doc_start"), n.alias("doc_end"), F.lit(0).alias("item_start"), n.alias("n_matched"), F.lit(1.0).alias("similarity")))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Overlaps of at least ``min_matched`` equal words (of a shorter item: all but a fifth): doc_id, item_id, places in words, equal words, similarity.

    ``penalty`` 4 means that four of five words or more are equal in every overlap.
    """
    return _overlaps(docs, items, doc_id, text, **options).drop("key").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` without an overlap, with all their columns."""
    found = materialise(_overlaps(docs, items, doc_id, text, **options).select(F.col("key").alias("_leaked")).distinct())
    return docs.join(broadcast_if_small(found, BROADCAST_ROWS), row_key(docs[doc_id], docs[text]) == found["_leaked"], "left_anti")

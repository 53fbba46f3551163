r"""Quality rules with suffix-array repetition.

Word counts and the share of words in repeated passages. Repeats come from a suffix array over the words of each text: ranks are doubled until
every suffix differs, the stored ranks give the longest common prefixes of neighbours, and a suffix whose own prefix is longest among its
neighbours marks a maximal repeated passage. Their spans are united; the covered fraction and the longest repeat are limited.

Several texts are worked on together in slices of bounded size; memory follows the slice, or the longest single text (some 100 bytes a word).
Everything happens inside one task per row: no shuffle, and no source or group can be hot.

Cases: a null or empty text has no words and fails (fewer than ``min_words``); repeated rows are judged each for itself; an empty table gives an
empty result; other columns of the input are not read; a null id stays null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelquarry.llm import words as W

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Windows of the base rule.
WINDOW = 5
#: A repeat counts for the method from this many words on.
REPEAT_WORDS = 8
MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_covered bigint, longest_repeat bigint, n_repeats bigint"
_NAMES = [x.split()[0] for x in MEASURES.split(", ")]


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def duplicate_lines(w: W.Words) -> np.ndarray:
    r"""Per row, \n-split lines that hold a word and equal an earlier line."""
    rows = len(w.offsets) - 1
    breaks = np.flatnonzero(w.data == 10)
    starts = np.unique(np.concatenate([w.offsets[:-1], breaks + 1]))
    starts = starts[starts < len(w.data)]
    worded = np.searchsorted(w.starts, np.append(starts[1:], len(w.data))) > np.searchsorted(w.starts, starts)
    row = np.searchsorted(w.offsets, starts, "right") - 1
    ends = np.append(starts[1:], len(w.data))
    ends = ends - ((ends > starts) & (w.data[np.maximum(ends, 1) - 1] == 10))
    keys = W.mix(W.hash_spans(w.data, starts, ends) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[worded]
    _, first = np.unique(keys, return_index=True)
    lines = np.bincount(row[worded], minlength=rows)
    return (lines - np.bincount(row[worded][first], minlength=rows)).astype(np.int64)


def suffix_repeats(words: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For every word the length of the longest passage that starts there and also starts elsewhere in its row."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    keys = W.mix(words + (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[inverse].astype(np.int64)
    tied = np.flatnonzero(counts[inverse] > 1)
    levels, h = [rank], 1
    while len(tied):
        after = tied + h
        inside = after < n
        inside[inside] = row[after[inside]] == row[tied[inside]]
        second = np.zeros(len(tied), np.int64)
        second[inside] = rank[after[inside]] + 1
        pair = rank[tied] * (n + 1) + second
        order = np.argsort(pair)
        tied, pair, group = tied[order], pair[order], rank[tied][order]
        at = np.arange(len(tied))
        new_pair = np.append(True, pair[1:] != pair[:-1])
        new_group = np.append(True, group[1:] != group[:-1])
        head = np.maximum.accumulate(np.where(new_pair, at, 0))
        group_head = np.maximum.accumulate(np.where(new_group, at, 0))
        rank = rank.copy()
        rank[tied] = group + head - group_head
        levels.append(rank)
        size = np.diff(np.append(np.flatnonzero(new_pair), len(tied)))
        tied = tied[np.repeat(size > 1, size)]
        h *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1], order[1:]
    alike = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[alike], b[alike]
    common = np.zeros(len(a), np.int64)
    for s in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        ok = np.flatnonzero((x < n) & (y < n))
        ok = ok[levels[s][x[ok]] == levels[s][y[ok]]]
        common[ok] += 1 << s
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Words inside any repeated passage of ``least`` words or more."""
    starts = np.flatnonzero(longest >= least)
    steps = np.zeros(len(longest) + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + longest[starts], -1)
    return np.cumsum(steps[:-1]) > 0


def _measure(column: pa.Array, repeat_words: int) -> pa.Array:
    data, offsets = W.texts(column)
    out = {name: [] for name in _NAMES}
    for lo, hi in W.slices(offsets):
        own = offsets[lo : hi + 1] - offsets[lo]
        w = W.split(data[offsets[lo] : offsets[hi]], own, W.NOT_SPACE, lower=False)
        rows = hi - lo
        per_row = lambda chosen: np.bincount(w.row[chosen], minlength=rows).astype(np.int64)  # noqa: B023, E731
        longest = suffix_repeats(w.hashes(), w.row)
        top = np.zeros(rows, np.int64)
        np.maximum.at(top, w.row, longest)
        before = np.append(0, longest[:-1]) * np.append(False, w.row[1:] == w.row[:-1]) if len(longest) else longest
        values = [
            w.per_row(), row_sums(W.NOT_SPACE[w.data] & ((w.data & 0xC0) != 0x80), own), row_sums(SYMBOLS[w.data], own), duplicate_lines(w),
            per_row(covered(longest, WINDOW)), per_row(covered(longest, repeat_words)), top, per_row((longest >= repeat_words) & (before <= longest)),
        ]
        for name, v in zip(_NAMES, values, strict=True):
            out[name].append(v)
    return pa.StructArray.from_arrays([pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for v in out.values()], _NAMES)


def verdicts(
    measured: Column, min_words: int = 10, max_repeat_percent: int = 20, max_covered: float = 0.15, max_longest: float = 0.1, longest_free: int = 50,
) -> tuple[Column, Column]:
    """(base_failed, kept) from a column of measures.

    ``base_failed``: too few words, or too many in windows of five words that occur twice or more. ``kept`` also needs the method's limits: repeated
    passages cover ``max_covered`` of the words at most, and no repeat is longer than ``longest_free`` words and ``max_longest`` of the text at once.
    """
    n = measured["n_words"]
    base = (n < min_words) | (100 * measured["n_repeat_words"] > max_repeat_percent * n)
    long_repeat = (measured["longest_repeat"] > longest_free) & (measured["longest_repeat"] > max_longest * n)
    return base, ~base & ~((measured["n_covered"] > max_covered * n) | long_repeat)


def measures(text: Column, repeat_words: int = REPEAT_WORDS) -> Column:
    """Counts and repeats of a text column; passages count as repeated from ``repeat_words`` words on."""
    kind = "struct<" + MEASURES.replace(" ", ": ").replace(",: ", ", ") + ">"
    return F.arrow_udf(lambda column: _measure(column, repeat_words), kind)(text)


def repetition(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repeat_words: int = REPEAT_WORDS, **limits) -> DataFrame:
    """doc_id, measures, base_failed and kept for each row."""
    found = docs.select(F.col(doc_id).alias("doc_id"), measures(F.col(text), repeat_words).alias("m"))
    base, kept = verdicts(F.col("m"), **limits)
    return found.select("doc_id", "m.*", base.alias("base_failed"), kept.alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", repeat_words: int = REPEAT_WORDS, **limits) -> DataFrame:
    """Rows of ``docs`` that pass, with all their columns."""
    own = "_quality"
    while own in docs.columns:
        own += "_"
    return docs.withColumn(own, measures(F.col(text), repeat_words)).filter(verdicts(F.col(own), **limits)[1]).drop(own)

"""Token counts by section.

Whole records are encoded once; token spans come from the tokens' byte lengths (byte-level tokens tile the text). They are interval-joined with the
sections' spans by binary search over both sorted lists, so a text of n tokens and m sections takes n log m steps and stays in one task; no section
and no source can be hot.

A token that lies in several sections is allocated by ``rule``: ``majority`` (the section with most of its bytes, the first of equals), ``first``,
``last``, or ``split`` (in proportion to its bytes). Bytes outside all sections allocate to none; a token wholly outside is counted under no section.

Cases: a null text is an empty one, with zero tokens for each section; empty sections have none; sections must be sorted and disjoint; a null or empty
section list gives no rows; repeated rows are counted each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelquarry.llm.binary import ROWS, library

RULES = ("majority", "first", "last", "split")
SECTION = "struct<name: string, start: int, stop: int>"
COUNTS = "array<struct<section: string, n_bytes: bigint, n_tokens: double, n_crossing: bigint>>"


def allocate(ends: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of every section; all spans in bytes, tokens tile the text up to ``ends[-1]``.

    Tokens wholly inside a section are counted by two binary searches; only tokens over a section's edge, two for each section at most, are shared out.
    """
    n = len(starts)
    if not len(ends) or not n:
        return np.zeros(n), np.zeros(n, np.int64)
    begins = np.append(0, ends[:-1])
    inside = np.searchsorted(ends, stops, "right") - np.searchsorted(begins, starts, "left")
    counts = np.maximum(inside, 0).astype(float)
    edges = np.concatenate([starts, stops])
    holder = np.searchsorted(ends, edges, "right")  # the token with the byte after the edge
    within = holder < len(ends)
    over = np.unique(holder[within][begins[holder[within]] < edges[within]])
    shared, crossing = _share_out(begins[over], ends[over], starts, stops, rule)
    return counts + shared, crossing


def _share_out(begins: np.ndarray, ends: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Allocate tokens that no section holds wholly; they may leave gaps between them."""
    counts, crossing = np.zeros(len(starts)), np.zeros(len(starts), np.int64)
    # sections that meet a token: those that stop after its begin and start before its end
    first = np.searchsorted(stops, begins, "right")
    width = np.maximum(np.searchsorted(starts, ends, "left") - first, 0)
    token = np.repeat(np.arange(len(ends)), width)
    section = np.repeat(first - np.cumsum(width) + width, width) + np.arange(int(width.sum()))
    shared = np.minimum(ends[token], stops[section]) - np.maximum(begins[token], starts[section])
    token, section, shared = token[shared > 0], section[shared > 0], shared[shared > 0]
    np.add.at(crossing, section, 1)
    if rule == "split":
        np.add.at(counts, section, shared / np.bincount(token, shared, minlength=len(ends))[token])
        return counts, crossing
    order = {"majority": lambda: np.lexsort((section, -shared, token)), "first": lambda: np.lexsort((section, token)), "last": lambda: np.lexsort((-section, token))}[rule]()
    if len(order):
        token, section = token[order], section[order]
        np.add.at(counts, section[np.append(True, token[1:] != token[:-1])], 1)
    return counts, crossing


def token_counts(docs: DataFrame, tokenizer_file: str, text: Column, sections: Column, rule: str = "majority", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs`` and section: bytes, tokens and how many of the tokens that touch it cross its edges.

    ``sections`` is an array of (name, start, stop) in code points of ``text``, sorted and disjoint.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(texts: pa.Array, spans: pa.Array) -> pa.Array:
        encoder = library(shared.value)
        out = []
        for at in range(0, len(texts), ROWS):
            column = texts.slice(at, ROWS)
            ids, sizes = encoder.ids(column)
            lengths, stop = encoder.lengths[ids], np.cumsum(sizes)
            for body, parts, lo, hi in zip(column.to_pylist(), spans.slice(at, ROWS).to_pylist(), stop - sizes, stop, strict=True):
                parts = parts or []
                raw = np.frombuffer((body or "").encode(), np.uint8)
                place = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # byte of each code point
                cut = np.array([[p["start"], p["stop"]] for p in parts], np.int64).reshape(-1, 2).clip(0, len(place) - 1)
                starts, stops = place[cut[:, 0]], place[cut[:, 1]]
                counts, crossing = allocate(np.cumsum(lengths[lo:hi]), starts, stops, rule)
                out.append([{"section": p["name"], "n_bytes": int(b - a), "n_tokens": float(c), "n_crossing": int(x)} for p, a, b, c, x in zip(parts, starts, stops, counts, crossing, strict=True)])
        return pa.array(out, pa.list_(pa.struct([("section", pa.string()), ("n_bytes", pa.int64()), ("n_tokens", pa.float64()), ("n_crossing", pa.int64())])))

    made = docs.select(F.col(doc_id).alias("doc_id"), F.arrow_udf(count, COUNTS)(text, sections).alias("found"))
    # explode() would let the optimizer infer a filter that runs the function a second time
    return made.select("doc_id", F.explode_outer("found").alias("f")).filter("f IS NOT NULL").select("doc_id", "f.*")


def record(parts: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """(text, sections) of a record: the named parts one after another, each but the last with a line feed that belongs to it; null parts are empty."""
    texts = [F.coalesce(c.cast("string"), F.lit("")) for _, c in parts]
    texts = [F.concat(t, F.lit("\n")) for t in texts[:-1]] + texts[-1:]
    sections, at = [], F.lit(0)
    for (name, _), t in zip(parts, texts, strict=True):
        stop = at + F.char_length(t)
        sections.append(F.struct(F.lit(name).alias("name"), at.cast("int").alias("start"), stop.cast("int").alias("stop")))
        at = stop
    return F.concat(*texts), F.array(*sections)

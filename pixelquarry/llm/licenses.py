"""License scans by diagonal voting.

All rolling word k-gram hashes of all texts are joined with the positions of the same k-grams in license templates. A hit votes for the
diagonal (text position minus template position). Neighbouring diagonals, which inserted or missing words shift apart, are merged into
spans, and spans are verified: every vote is compared word by word, and enough of the template must be covered within a fitting length.

Cases: a null text is an empty one; no words give no spans; repeated rows are judged each for itself; an empty table gives an empty result;
other columns of the input, whatever their names, are not read; a null id stays null. Equal coverages are all kept.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelquarry.llm import words as W
from pixelquarry.llm.keys import row_key
from pixelquarry.operators.scaling import broadcast_if_small
from pixelquarry.session import materialise

#: Phrases and labels of the contract.
BASE_PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Opening sentences of public license notices, and the one-line forms in common use.
NOTICES = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("Released under the MIT License", "mit"),
    ("Licensed under the MIT License", "mit"),
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "apache-2.0"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl-3"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("Licensed under CC BY 4.0", "cc-by"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc-sa"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
]

GRAM = 3
#: Templates come from code, not from data; a longer list than this is joined by shuffle instead of broadcast.
BROADCAST_GRAMS = 200_000


@dataclass(frozen=True)
class Template:
    text: str
    label: str
    base: bool = False

    def words(self) -> list[str]:
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(self.text))


TEMPLATES = [Template(t, label, True) for t, label in BASE_PHRASES] + [Template(t, label) for t, label in NOTICES]


def _lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def template_positions(templates: list[Template]) -> list[tuple[int, int, int, int, str]]:
    """(gram, template, position, k, words) of every k-gram; phrases of two words have k 2."""
    rows = []
    for t, template in enumerate(templates):
        own = template.words()
        k = min(GRAM, len(own))
        if k < 2:
            raise ValueError(f"template needs two words or more: {template.text!r}")
        raw = np.frombuffer(" ".join(own).encode(), np.uint8)
        found = W.split(raw, np.array([0, len(raw)]), W.ALNUM)
        hashes, at = W.grams(found.hashes(), found.row, list(range(k)))
        rows += [(int(h), t, int(i), k, " ".join(own[i : i + k])) for h, i in zip(_signed(hashes), at, strict=True)]
    return rows


#: What :func:`scan_grams` returns.
SCAN = "struct<n_words: bigint, grams: array<bigint>>"
HIT = "struct<template: int, t_pos: int, k: int, pos: bigint>"
BROADCAST_ROWS = 200_000


def _words(column: pa.Array) -> Iterator[tuple[int, W.Words]]:
    data, offsets = W.texts(column)
    for lo, hi in W.slices(offsets):
        yield hi - lo, W.split(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], W.ALNUM)


def scan_grams(column: pa.Array) -> pa.Array:
    """Per text the number of words and the hashes of its 2-grams, then of its 3-grams."""
    parts = []
    for rows, w in _words(column):
        n, h = w.per_row(), w.hashes()
        pairs, threes = np.maximum(n - 1, 0), np.maximum(n - 2, 0)
        base, first = np.append(0, np.cumsum(pairs + threes)), np.append(0, np.cumsum(n))
        out = np.zeros(base[-1], np.int64)
        for k, before in ((2, np.zeros(rows, np.int64)), (3, pairs)):
            g, at = W.grams(h, w.row, list(range(k)))
            r = w.row[at]
            out[base[r] + before[r] + at - first[r]] = _signed(g)
        parts.append(pa.StructArray.from_arrays([pa.array(n), W.lists(out, pairs + threes, pa.int64())], ["n_words", "grams"]))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("n_words", pa.int64()), ("grams", pa.list_(pa.int64()))]))


def count_words(column: pa.Array) -> pa.Array:
    return pa.array(np.concatenate([np.zeros(0, np.int64), *(w.per_row() for _, w in _words(column))]), pa.int64())


def true_hits(column: pa.Array, tries: pa.Array, grams: dict[tuple[int, int], bytes]) -> pa.Array:
    """Hits whose words are the template's, word by word; each text is cut into words once."""
    out, row = [], 0
    for rows, w in _words(column):
        first = np.append(0, np.cumsum(w.per_row()))
        for r in range(rows):
            kept = []
            for t in tries[row].as_py():
                at = int(first[r] + t["pos"])
                own = b" ".join(w.data[a:b].tobytes() for a, b in zip(w.starts[at : at + t["k"]], w.ends[at : at + t["k"]], strict=True))
                if own == grams[t["template"], t["t_pos"]]:
                    kept.append(t)
            out.append(kept)
            row += 1
    return pa.array(out, pa.list_(pa.struct([("template", pa.int32()), ("t_pos", pa.int32()), ("k", pa.int32()), ("pos", pa.int64())])))


def votes(docs: DataFrame, templates: list[Template] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Votes per key (which stands for id and text), template and diagonal, with their places.

    Only hashes and places move: the texts with hits are read once more and compared there.
    """
    spark = docs.sparkSession
    positions = template_positions(templates)
    table = spark.createDataFrame([p[:4] for p in positions], "gram bigint, template int, t_pos int, k int")
    if len(positions) <= BROADCAST_GRAMS:
        table = F.broadcast(table)
    source = docs.select(F.col(text).alias("text"), row_key(F.col(doc_id), F.col(text)).alias("key"))
    grams = source.select("key", F.arrow_udf(scan_grams, SCAN)("text").alias("s")).select("key", "s.n_words", F.posexplode("s.grams").alias("i", "gram"))
    pos = F.expr("CASE k WHEN 2 THEN i ELSE i - greatest(n_words - 1, 0) END").cast("bigint")
    # the place tells 2-grams from 3-grams, whatever their hashes
    hits = grams.join(table, "gram").withColumn("pos", pos).filter("IF(k = 2, i < n_words - 1, i >= n_words - 1)")
    hits = hits.groupBy("key").agg(F.collect_set(F.struct("template", "t_pos", "k", "pos")).alias("tries"))
    hits = materialise(hits)
    spelled = {(t, at): own.encode() for _, t, at, _, own in positions}
    own = source.join(broadcast_if_small(hits.select("key"), BROADCAST_ROWS), "key", "left_semi").dropDuplicates(["key"]).join(hits, "key")
    found = own.select("key", F.explode(F.arrow_udf(lambda c, t: true_hits(c, t, spelled), f"array<{HIT}>")("text", "tries")).alias("h")).select("key", "h.*")
    return found.groupBy("key", "template", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("pos").alias("start"), F.max(F.col("pos") + F.col("k")).alias("stop"), F.collect_list(F.struct("pos", "t_pos")).alias("places"),
    )


def in_order(places: pa.Array) -> pa.Array:
    """How many different template places stand in the text one after another (longest rising run)."""
    out = []
    for row in places.to_pylist():
        ends: list[int] = []
        for p in sorted(row, key=lambda p: (p["pos"], -p["t_pos"])):
            at = bisect_left(ends, p["t_pos"])
            ends[at : at + 1] = [p["t_pos"]]
        out.append(len(ends))
    return pa.array(out, pa.int64())


def license_spans(
    docs: DataFrame, templates: list[Template] = TEMPLATES, doc_id: str = "doc_id", text: str = "text",
    slack: int = 4, min_coverage: float = 0.8, max_stretch: float = 1.5,
) -> DataFrame:
    """Candidate spans of every template, by key (see :func:`votes`).

    Diagonals at most ``slack`` apart are merged. ``verified``: different k-grams of the template, in its order, cover ``min_coverage`` of them or more and
    the span is at most ``max_stretch`` times as long as the template; a merged span that is too long, or has less, counts by its best single diagonal. Base
    phrases count place by place, unmerged.
    """
    spark = docs.sparkSession
    facts = []
    for t, template in enumerate(templates):
        n = len(template.words())
        facts.append((t, template.label, template.base, n, max(1, n - GRAM + 1)))
    known = F.broadcast(spark.createDataFrame(facts, "template int, label string, base boolean, t_words int, t_grams int"))
    found = votes(docs, templates, doc_id, text).join(known, "template")
    by_diagonal = Window.partitionBy("key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > slack), F.lit(True))
    found = found.withColumn("span", F.sum(apart.cast("int")).over(by_diagonal))
    limit = F.ceil(F.col("t_words") * max_stretch)
    alone = F.when(F.col("stop") - F.col("start") <= limit, F.struct("votes", (-F.col("diagonal")).alias("d"), "start", "stop"))
    spans = found.groupBy("key", "template", "span").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.max(alone).alias("alone"), F.flatten(F.collect_list("places")).alias("places"),
        *[F.max(c).alias(c) for c in ("label", "base", "t_words", "t_grams")],
    )
    fits = F.col("stop") - F.col("start") <= limit
    spans = spans.withColumn("merged", F.when(fits, F.arrow_udf(in_order, "bigint")("places")).otherwise(0)).drop("places")
    single = F.coalesce("alone.votes", F.lit(0)) > F.col("merged")
    best = F.greatest(F.col("merged"), F.coalesce("alone.votes", F.lit(0)))
    spans = spans.withColumn("coverage", F.least(F.lit(1.0), best / F.col("t_grams")))
    spans = spans.withColumn("start", F.when(single, F.col("alone.start")).otherwise(F.col("start"))).withColumn("stop", F.when(single, F.col("alone.stop")).otherwise(F.col("stop")))
    return spans.drop("alone", "merged").withColumn("verified", F.col("coverage") >= min_coverage)


def scan_licenses(docs: DataFrame, templates: list[Template] = TEMPLATES, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row for each row of ``docs``: counts and places of the base phrases, labels, and the best coverage as score."""
    spans = license_spans(docs, templates, doc_id, text, **options)
    base, good = F.col("base"), F.col("verified")
    joined = lambda cond: F.array_join(F.sort_array(F.collect_set(F.when(cond, F.col("label")))), ",")
    found = spans.groupBy("key").agg(
        F.sum(base.cast("bigint")).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(base).alias("base_labels"), joined(good).alias("labels"),
        F.max(F.when(good, F.col("coverage")).otherwise(0.0)).alias("score"),
        F.sum((good & ~base).cast("bigint")).alias("n_notices"),
    )
    found = materialise(found)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.arrow_udf(count_words, "bigint")(F.col(text)).alias("n_words"), row_key(F.col(doc_id), F.col(text)).alias("key"))
    met = rows.join(broadcast_if_small(found, BROADCAST_ROWS), "key", "left").drop("key")
    return met.fillna({"n_base": 0, "base_labels": "", "labels": "", "score": 0.0, "n_notices": 0})

"""Byte-level BPE, encoding and decoding.

Two tiers: a minimal perfect hash finds whole pre-tokens that are in the vocabulary; others are merged with a heap over linked bytes, lowest rank
and then leftmost first, in n log n steps for any length. Special tokens are not known: their spelling is ordinary text.

Where the pattern is the known one, texts are cut into pieces that no pre-token spans and each distinct piece of a slice is encoded once
(:mod:`pixelquarry.llm.pieces`). With any other pattern whole texts are encoded.

The rank file is read on the driver and broadcast (its size is the vocabulary's, not the data's). Everything else happens inside one task per row.

Cases: a null text is an empty one and has no tokens; null ids decode to an empty text; very long texts and very long single words are encoded
whole; repeated rows are encoded each for itself; an empty table gives an empty result; other columns are passed by; a null id stays null.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelquarry.llm.pieces import PLAIN, PieceTable, byte_level_cuts, encode_column, give_back, id_lists, whole_texts

_2_64 = 1 << 64
_CODECS: dict[bytes, tuple[BytePairs, PieceTable]] = {}
#: Text bytes encoded at once, and bytes of remembered pieces.
SLICE_BYTES, REMEMBERED_BYTES = 2 << 20, 32 << 20


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Tokens and ranks of a rank file (base64 token, space, rank)."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


class PerfectHash:
    """Minimal perfect hash over byte strings: every key has a slot of its own among exactly as many slots.

    Keys fall into buckets; large buckets first look for a displacement that sends all their keys to free slots, single keys take what is left.
    """

    def __init__(self, keys: list[bytes]) -> None:
        n = self.n = max(1, len(keys))
        self.buckets = max(1, n // 2)
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        own: list[list[tuple[int, bytes]]] = [[] for _ in range(self.buckets)]
        for key in keys:
            h = xxhash.xxh3_64_intdigest(key)
            own[h % self.buckets].append((h, key))
        order = sorted((b for b in range(self.buckets) if own[b]), key=lambda b: -len(own[b]))
        for b in order:
            if len(own[b]) == 1:
                continue
            d = 1
            while True:
                slots = [self._slot(h, d) for h, _ in own[b]]
                if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for slot, (_, key) in zip(slots, own[b], strict=True):
                self.keys[slot] = key
        free = iter([s for s, key in enumerate(self.keys) if key is None])
        for b in order:
            if len(own[b]) == 1:
                slot = next(free)
                self.shift[b] = -slot - 1
                self.keys[slot] = own[b][0][1]

    def _slot(self, h: int, d: int) -> int:
        return (((h + d * 0x9E3779B97F4A7C15) % _2_64 ^ h >> 29) * 0xBF58476D1CE4E5B9 % _2_64 >> 20) % self.n

    def find(self, key: bytes) -> int:
        """Slot of ``key``, or -1 if it isn't one of the keys."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        slot = -d - 1 if d < 0 else self._slot(h, d)
        return slot if self.keys[slot] == key else -1


class BytePairs:
    def __init__(self, ranks: dict[bytes, int], pattern: str, whole: PerfectHash | None = None) -> None:
        self.ranks = ranks
        self.pattern = pattern
        self.pre_tokens = regex.compile(pattern).findall
        self.whole = whole or PerfectHash(list(ranks))
        self.slot_rank = [ranks.get(key, -1) for key in self.whole.keys]
        size = max(ranks.values(), default=-1) + 1
        self.length = np.zeros(size, np.int64)
        self.start = np.zeros(size, np.int64)
        blob = bytearray()
        for token, rank in ranks.items():
            self.start[rank], self.length[rank] = len(blob), len(token)
            blob += token
        self.blob = np.frombuffer(bytes(blob), np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that isn't a token itself. A heap entry is rank, start and end in one integer, so ties go to the leftmost pair."""
        n, rank_of = len(piece), self.ranks.get
        bits = 6 if n < 64 else n.bit_length()
        low, up = (1 << bits) - 1, 2 * bits
        stop = list(range(1, n + 1))  # where the part that starts here ends; 0: no part starts here any more
        before = list(range(-1, n))  # start of the part before
        heap = [r << up | i << bits | i + 2 for i in range(n - 1) if (r := rank_of(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            end = entry & low
            i = entry >> bits & low
            j = stop[i]
            if not j or j >= n or stop[j] != end:
                continue  # one of the two parts has grown or gone meanwhile
            stop[i], stop[j] = end, 0
            if end < n:
                before[end] = i
                far = stop[end]
                if (r := rank_of(piece[i:far])) is not None:
                    heappush(heap, r << up | i << bits | far)
            if i:
                k = before[i]
                if (r := rank_of(piece[k:end])) is not None:
                    heappush(heap, r << up | k << bits | end)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : stop[i]]])
            i = stop[i]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pieces; a plain word is a single pre-token."""
        out = []
        for piece in pieces:
            ids = self.raw_token(piece) if PLAIN(piece) else self.encode(piece.decode())
            out.append(struct.pack(f"<{len(ids)}I", *ids))
        return out

    def raw_token(self, raw: bytes) -> list[int]:
        slot = self.whole.find(raw)
        return [self.slot_rank[slot]] if slot >= 0 else self.merge(raw)

    def encode(self, text: str) -> list[int]:
        return [i for token in self.pre_tokens(text) for i in self.raw_token(token.encode())]

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        return self.blob[np.repeat(self.start[ids] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()


def _codec(content: bytes, pattern: str, whole: PerfectHash) -> tuple[BytePairs, PieceTable]:
    """One codec and one table of pieces for each worker and vocabulary."""
    key = hashlib.sha256(content + pattern.encode()).digest()
    if key not in _CODECS:
        codec = BytePairs(read_ranks(content), pattern, whole)
        known = pattern == public_tokenizers.PATTERN
        whole_text = lambda found: [np.asarray(codec.encode(x.decode()), "<u4").tobytes() for x in found]
        _CODECS[key] = codec, PieceTable(codec.encode_pieces if known else whole_text, REMEMBERED_BYTES)
    return _CODECS[key]


def codec_functions(spark, rank_file: str, pattern: str) -> tuple[Callable, Callable]:
    """Column functions (encode: text to array of ids, decode: array of ids to binary)."""
    with open(rank_file, "rb") as f:
        content = f.read()
    shared = spark.sparkContext.broadcast((content, pattern, PerfectHash(list(read_ranks(content)))))
    cut = byte_level_cuts if pattern == public_tokenizers.PATTERN else whole_texts

    def encode(column: pa.Array) -> pa.Array:
        give_back()  # a reused worker may hold what another stage took
        return id_lists(*encode_column(column, cut, _codec(*shared.value)[1], SLICE_BYTES))

    def decode(column: pa.Array) -> pa.Array:
        codec = _codec(*shared.value)[0]
        return pa.array([codec.decode(np.asarray(x.values) if x.is_valid else np.zeros(0, np.int32)) for x in column], pa.binary())

    return F.arrow_udf(encode, "array<int>"), F.arrow_udf(decode, "binary")


def encode_texts(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` in a new column."""
    return docs.withColumn(ids, codec_functions(docs.sparkSession, rank_file, pattern)[0](F.col(text)))


def decode_ids(docs: DataFrame, rank_file: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that the token ids stand for in a new column."""
    return docs.withColumn(decoded, codec_functions(docs.sparkSession, rank_file, pattern)[1](F.col(ids)))

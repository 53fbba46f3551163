"""Words of many texts at once: numpy arrays over Arrow string buffers.

Works on UTF-8 bytes. Every class used here keeps or drops all bytes from 0x80 on, so a word never ends inside a character.
Memory follows the slice that is being worked on, not the Arrow batch: :func:`slices` cuts a batch into rows of a bounded number of bytes
(one row at least), and word hashes are computed in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
PIECE_BYTES = 1 << 20

#: Words end at white space: [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Words of lower-cased letters, digits and everything outside ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of a single longer row."""
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, rows)
        lo = min(hi, rows)


@dataclass
class Words:
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray

    def per_row(self) -> np.ndarray:
        return np.bincount(self.row, minlength=len(self.offsets) - 1).astype(np.int64)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends)


def split(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool = True) -> Words:
    """Words of consecutive rows; ``offsets`` starts at 0."""
    if lower:
        data = LOWER[data]
    mask = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = mask.copy()
    begin[1:] &= ~mask[:-1] | edge[1:-1]
    end = mask.copy()
    end[:-1] &= ~mask[1:] | edge[1:-1]
    starts = np.flatnonzero(begin)
    row = np.searchsorted(offsets, starts, "right") - 1
    return Words(data, offsets, starts, np.flatnonzero(end) + 1, row)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _UNBASE)):
            steps = np.full(max(n, PIECE_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by prefix sums of a polynomial; spans ascend and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + PIECE_BYTES, "right")))
        piece = data[base : int(ends[hi - 1])]
        up, down = _powers(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        lo = hi
    if len(_POWERS.get("up", ())) > 4 * PIECE_BYTES:  # a giant word needed long tables
        _POWERS.clear()
    return out


def _factors(k: int) -> list[np.uint64]:
    return [np.uint64(pow(_BASE, 2 * j + 3, 1 << 64)) for j in range(k)]


def grams(hashes: np.ndarray, row: np.ndarray, places: list[int], salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the words at ``places`` (ascending, first 0) of every window within one row; the windows' first words."""
    span = places[-1] + 1
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.full(n, np.uint64((salt * 0xA0761D6478BD642F + len(places)) % (1 << 64)), np.uint64)
    for place, factor in zip(places, _factors(len(places)), strict=True):
        total += hashes[place : place + n] * factor
    inside = np.flatnonzero(row[span - 1 :] == row[:n])
    return mix(total[inside]), inside


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Values in row order as one list per row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def char_places(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Code points before byte ``at`` in its row."""
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=seen[1:])
    return seen[at] - seen[offsets[row]]

"""Texts cut into pieces that can be encoded one by one, and tables of the distinct pieces.

Cutting works on the UTF-8 bytes of many texts at once. The pieces of a slice of texts are dictionary-encoded, each distinct piece is encoded once, and
the ids go back to the pieces' places by index arithmetic, so a frequent word costs a few array steps wherever it stands. Pieces met lately are
remembered between slices, bounded by bytes; what is remembered never changes a result.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pixelquarry.llm.words import slices, texts

#: Text bytes worked on at once (a longer text is a slice of its own).
SLICE_BYTES = 4 << 20
#: Bytes that the remembered pieces of a worker take, all told.
REMEMBERED_BYTES = 48 << 20

#: White space of more than one byte (Unicode White_Space; without the separators 1C to 1F).
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80")
#: An optional space and letters: a single pre-token.
PLAIN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
_MAY_BE_WIDE = np.zeros(256, bool)
_MAY_BE_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "!\"(),-./:;?"]] = True


def byte_level_cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, None]:
    """First bytes of pieces, for byte-level pre-tokens (a space and a run of letters, digits or signs, or white space).

    Cuts stand before a word's space, before the last white space in front of a word, after it if it isn't a space, before white space that follows a
    word, and between a letter and a sign. No pre-token spans one of these.
    """
    n = len(data)
    space = _SPACE[data]
    wide = np.array([m.span() for m in _WIDE_SPACE.finditer(data)] if _MAY_BE_WIDE[data].any() else [], np.int64).reshape(-1, 2)
    for lo, hi in wide.tolist():
        space[lo:hi] = True
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    edge = first[1:n]
    cut = first[:n].copy()
    cut[1:] |= space[1:] & ~space[:-1]
    begins = np.flatnonzero(space[:-1] & ~space[1:] & ~edge) + 1
    before = begins - 1
    if len(wide):
        own = np.searchsorted(wide[:, 1], begins).clip(max=len(wide) - 1)
        before = np.where(wide[own, 1] == begins, wide[own, 0], before)
    cut[before] = True
    cut[begins[data[before] != 0x20]] = True
    letter = _LETTER[data[:-1]]
    if n > 2:
        near = (data[1:-1] >= 0x80) & (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
        letter[1:] |= near
    cut[1:] |= letter & _SIGN[data[1:]]
    return np.flatnonzero(cut), None


def take_runs(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + count]``, one after another."""
    ends = np.cumsum(counts)
    return flat[np.repeat(starts - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)]


class PieceTable:
    """Ids of pieces, from a function that encodes a list of distinct pieces (each id list as little-endian unsigned 32-bit integers).

    Pieces met lately stay in plain arrays, some 50 bytes each. When these pass ``remembered_bytes``, only the pieces of the slice at hand stay.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], remembered_bytes: int = REMEMBERED_BYTES) -> None:
        self.encode, self.limit = encode, remembered_bytes
        self._keep(pa.array([], pa.large_binary()), np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def _keep(self, keys: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.keys, self.flat, self.sizes, self.starts = keys, flat, sizes, np.cumsum(sizes) - sizes

    def _add(self, keys: pa.Array) -> None:
        found = self.encode(keys.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        self._keep(pa.concat_arrays([self.keys, keys]), np.concatenate([self.flat, np.frombuffer(b"".join(found), "<u4")]), np.concatenate([self.sizes, sizes]))

    def ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, number of ids of each piece)."""
        if not len(pieces):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        coded = pieces.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.keys)
        new = at.is_null()
        if at.null_count:
            had = len(self.keys)
            self._add(coded.dictionary.filter(new))
            at = at.to_numpy(zero_copy_only=False)
            new = new.to_numpy(zero_copy_only=False)
            at[new] = had + np.arange(int(new.sum()))
        at = np.asarray(at, np.int64)
        place = at[coded.indices.to_numpy()]
        counts = self.sizes[place]
        out = take_runs(self.flat, self.starts[place], counts), counts
        if self.keys.nbytes + self.flat.nbytes + 2 * self.sizes.nbytes > self.limit:
            self._keep(coded.dictionary, take_runs(self.flat, self.starts[at], self.sizes[at]), self.sizes[at])
            if self.keys.nbytes + self.flat.nbytes > self.limit:
                self._keep(self.keys[:0], self.flat[:0], self.sizes[:0])
        return out


def spans(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The byte spans between neighbouring edges as a binary column."""
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])


def encode_column(column: pa.Array, cut: Callable, table: PieceTable, slice_bytes: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows one after another, number of ids of each row). A null text is an empty one.

    ``cut`` gives the pieces' first bytes and, for some cutters, which of these are markers that the piece itself goes without.
    """
    data, offsets = texts(column)
    out, counts = [], [np.zeros(0, np.int64)]
    for lo, hi in slices(offsets, slice_bytes):
        own, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if not len(own):
            counts.append(np.zeros(hi - lo, np.int64))
            continue
        starts, marked = cut(own, at)
        first = np.searchsorted(starts, at)
        if marked is not None:
            own, starts = np.delete(own, starts[marked]), starts - (np.cumsum(marked) - marked)
        ids, sizes = table.ids(spans(own, np.append(starts, len(own))))
        out.append(ids)
        counts.append(np.diff(np.append(0, np.cumsum(sizes))[first]))
    return (np.concatenate(out) if out else np.zeros(0, "<u4")), np.concatenate(counts)


def whole_texts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, None]:
    """Each text is one piece."""
    return np.unique(offsets[:-1][np.diff(offsets) > 0]), None


def give_back() -> None:
    """Free memory that this process keeps goes back to the system, where the C library knows how."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def id_lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view("<i4"), pa.int32()))


def flat_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, row offsets) of a list column; a null list is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    counts = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    return np.asarray(column.flatten(), np.int64), np.append(0, np.cumsum(counts))

"""SentencePiece encoding and decoding over tables of distinct marked words.

The library turns each space into a marker and puts one before the text. Where no piece of the model has a marker after another character, no piece
crosses from a word into the marker behind it, so a text falls into chunks (a run of markers and the word after them) that are segmented
independently. The chunks of a slice of texts form a table of distinct ones; each is segmented once and the ids are joined back by position.

Each task has tables of its own: only texts and ids pass through, nothing is shuffled, and a lost executor costs its tasks alone. A table over all
texts would have to send every occurrence of every word through a shuffle twice, ten times the bytes of the texts.

A model whose pieces do cross markers, or that changes texts before segmenting them, is met by encoding whole texts with the library.

Cases: a null text is an empty one and has no ids; null ids decode to an empty text; a text of spaces has ids for its markers; a marker character in a
text counts as a space, as in the library, and comes back as one; very long texts, words and runs of spaces are encoded whole; repeated rows are
encoded each for itself; an empty table gives an empty result; other columns are passed by; a null document id stays null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from pixelquarry.llm.pieces import PieceTable, encode_column, flat_ids, id_lists, take_runs, whole_texts

MARKER = "▁"
_SPACE = 0x20
_MODELS: dict[bytes, Model] = {}
#: Piece types of the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def marked_cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of chunks: texts' begins, and spaces behind other characters, which are markers of their chunk.

    The library puts a marker before what it encodes, so a chunk goes without its first one; a text's first chunk already does.
    """
    space = data == _SPACE
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    inner = np.zeros(len(data) + 1, bool)
    inner[1:-1] = space[1:] & ~space[:-1] & ~cut[1:-1]
    starts = np.flatnonzero((cut | inner)[:-1])
    return starts, inner[starts]


class Model:
    def __init__(self, content: bytes) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_proto=content)
        proto = sentencepiece_model_pb2.ModelProto.FromString(content)
        form, trained = proto.normalizer_spec, proto.trainer_spec
        plain = not form.precompiled_charsmap and form.add_dummy_prefix and not form.remove_extra_whitespaces and form.escape_whitespaces
        crossing = any(MARKER in p.piece.lstrip(MARKER) for p in proto.pieces if p.type in (NORMAL, UNUSED))
        own = any(p.type == USER_DEFINED for p in proto.pieces)
        self.by_chunks = plain and not crossing and not own and not trained.treat_whitespace_as_suffix
        self.table = PieceTable(self._segment)
        self.cut = marked_cuts if self.by_chunks else whole_texts
        kinds = np.array([p.type for p in proto.pieces], np.int64)
        raw = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(MARKER, " ").encode() for p in proto.pieces]
        self.sizes = np.array(list(map(len, raw)), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.spelled = (kinds != CONTROL) & (kinds != UNKNOWN)
        self.is_byte = kinds == BYTE
        self.marked = np.array([p.piece.startswith(MARKER) for p in proto.pieces], bool)
        self.plain_decoding = plain

    def _segment(self, chunks: list[bytes]) -> list[bytes]:
        found = self.library.encode([c.decode() for c in chunks], num_threads=1)
        if self.by_chunks:  # the library gives nothing for an empty text, but here it is a marker alone
            alone = [self.library.piece_to_id(MARKER)]
            found = [ids if chunk else alone for chunk, ids in zip(chunks, found, strict=True)]
        return [np.asarray(ids, "<u4").tobytes() for ids in found]

    def encode(self, column: pa.Array) -> pa.Array:
        if self.by_chunks:
            column = pc.replace_substring(column, MARKER, " ")
        return id_lists(*encode_column(column, self.cut, self.table))

    def decode(self, column: pa.Array) -> pa.Array:
        """Texts of id lists: the pieces' bytes without the first marker; rows that take more than that go to the library."""
        ids, offsets = flat_ids(column)
        out, rows = [], len(offsets) - 1
        for lo in range(0, rows, 256):
            hi = min(lo + 256, rows)
            own, at = ids[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            good = (own >= 0) & (own < len(self.sizes))
            own_good = np.where(good, own, 0)
            good &= self.spelled[own_good]
            ends = np.append(0, np.cumsum(self.sizes[own_good]))[at]
            data = take_runs(self.flat, self.starts[own_good], self.sizes[own_good]).tobytes()
            bad = np.diff(np.append(0, np.cumsum(~good))[at]) > 0
            by_bytes = np.diff(np.append(0, np.cumsum(self.is_byte[own_good]))[at]) > 0
            for r in range(hi - lo):
                a, b = int(at[r]), int(at[r + 1])
                if a == b:
                    out.append(b"")
                    continue
                raw = data[ends[r] : ends[r + 1]]
                simple = self.plain_decoding and not bad[r] and not self.is_byte[own[a]]
                if simple and by_bytes[r]:
                    simple = _is_utf8(raw)
                if simple:
                    out.append(raw[1:] if self.marked[own[a]] else raw)
                else:
                    out.append(self.library.decode(own[a:b].tolist()).encode())
        return pa.array(out, pa.binary()).cast(pa.string())


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def _model(content: bytes) -> Model:
    """One model for each worker and file."""
    key = hashlib.sha256(content).digest()
    if key not in _MODELS:
        _MODELS[key] = Model(content)
    return _MODELS[key]


def model_functions(spark, model_file: str) -> tuple[Callable, Callable]:
    """Column functions (encode: text to array of ids, decode: array of ids to text). The model file's size is the vocabulary's, not the data's."""
    with open(model_file, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def encode(column: pa.Array) -> pa.Array:
        return _model(shared.value).encode(column)

    def decode(column: pa.Array) -> pa.Array:
        return _model(shared.value).decode(column)

    return F.arrow_udf(encode, "array<int>"), F.arrow_udf(decode, "string")


def encode_texts(docs: DataFrame, model_file: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` in a new column."""
    return docs.withColumn(ids, model_functions(docs.sparkSession, model_file)[0](F.col(text)))


def decode_ids(docs: DataFrame, model_file: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the text that the ids stand for in a new column."""
    return docs.withColumn(decoded, model_functions(docs.sparkSession, model_file)[1](F.col(ids)))

"""Token ids as flat binary files.

Documents are ordered by id over all partitions; each task encodes its range with the tokenizers library and writes three files: ``.bin`` (ids as
unsigned 16-bit or 32-bit integers, little-endian, whichever the vocabulary needs), ``.off`` (64-bit offsets of its documents, and the end) and
``.doc`` (64-bit document ids). Special tokens spelled in a text are the library's to judge: it gives them their own ids. A manifest has one row per partition; prefix sums over its counts give each partition its base, so a document starts
at base plus own offset. Local files are read by memory map, others by ranges.

File names are unique to the attempt that wrote them and only finished ones get into the manifest, so a task may run twice or be lost. What other
attempts left is never read.

Cases: a null or empty text has the end id only; null ids come first (in the manifest: how many); equal ids stand in the order of their texts;
repeated rows are written each; an empty table gives files for no document; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelquarry.llm.pieces import PLAIN, PieceTable, byte_level_cuts, encode_column, whole_texts
from pixelquarry.session import materialise, shared_folder

MANIFEST = "part int, name string, n_docs bigint, n_null bigint, n_tokens bigint"
READ_IDS = 1 << 20
_LIBRARIES: dict[bytes, Library] = {}
#: Texts encoded at once.
ROWS = 2048


#: Bytes as byte-level vocabularies spell them (fixed values): printable ones stand for themselves, others follow from code point 256 on.
_SELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SPELLED = {b: b for b in _SELF} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _SELF)}


class Library:
    """The tokenizers library behind a table of distinct pieces.

    Texts are cut into pieces only where the tokenizer's own pre-tokens are the byte-level ones; a text that spells one of its added tokens stays whole,
    since the library takes these out first. Plain words are single pre-tokens and go straight to the library's model; all else takes its whole way.
    """

    def __init__(self, content: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(content)
        stage = self.tokenizer.pre_tokenizer
        self.by_pieces = self.tokenizer.normalizer is None and isinstance(stage, pre_tokenizers.ByteLevel) and not stage.add_prefix_space and stage.use_regex
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(map(re.escape, added))).search if added else lambda raw: None
        self.table = PieceTable(self._encode)
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(vocabulary.values(), default=0) < 1 << 16 else "<u4")
        self.lengths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():  # each character of a byte-level token stands for one byte
            self.lengths[i] = len(token)

    def _encode(self, pieces: list[bytes]) -> list[bytes]:
        tokenize, encode, out = self.tokenizer.model.tokenize, self.tokenizer.encode, []
        for piece in pieces:
            if self.by_pieces and PLAIN(piece):
                ids = [t.id for t in tokenize(piece.decode("latin-1").translate(_SPELLED))]
            else:
                ids = encode(piece.decode(), add_special_tokens=False).ids
            out.append(struct.pack(f"<{len(ids)}I", *ids))
        return out

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, None]:
        if not self.by_pieces:
            return whole_texts(data, offsets)
        starts, _ = byte_level_cuts(data, offsets)
        raw = data.tobytes()
        if self.added(raw):
            keep = np.ones(len(starts), bool)
            first = np.searchsorted(starts, offsets)
            for r in range(len(offsets) - 1):
                if self.added(raw[offsets[r] : offsets[r + 1]]):
                    keep[first[r] + 1 : first[r + 1]] = False
            starts = starts[keep]
        return starts, None

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another, number of ids of each row)."""
        return encode_column(column, self._cut, self.table)


def library(content: str) -> Library:
    """One for each worker and vocabulary."""
    key = hashlib.sha256(content.encode()).digest()
    if key not in _LIBRARIES:
        _LIBRARIES[key] = Library(content)
    return _LIBRARIES[key]


def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with its file system, as Spark itself resolves it, so that tasks that open files meet the same place."""
    mark = f"{folder}/where-{uuid.uuid4().hex}"
    spark.range(1).write.parquet(mark)
    return spark.read.parquet(mark).inputFiles()[0].split("/where-")[0]


def write_token_files(docs: DataFrame, tokenizer_file: str, end_id: int, folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """Write the files and return (manifest with ``base``, folder)."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens/{uuid.uuid4().hex}"
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    folder = qualified(spark, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = library(shared.value)
        kind = encoder.kind if end_id < 1 << 16 else np.dtype("<u4")
        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, root = _file_system(folder)
        tokens = docs = nulls = 0
        end = np.array([end_id], kind)
        with fs.open_output_stream(f"{root}/{name}.bin") as ids_out, fs.open_output_stream(f"{root}/{name}.off") as off_out, fs.open_output_stream(f"{root}/{name}.doc") as doc_out:
            off_out.write(np.zeros(1, "<u8").tobytes())
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    rows = batch.slice(at, ROWS)
                    ids, counts = encoder.ids(rows.column(1))
                    own = rows.column(0)
                    ends = np.cumsum(counts + 1)
                    closed = np.full(int(ends[-1]), end_id, kind)
                    inside = np.ones(len(closed), bool)
                    inside[ends - 1] = False
                    closed[inside] = ids
                    ids_out.write(closed.tobytes())
                    off_out.write((tokens + ends).astype("<u8").tobytes())
                    doc_out.write(own.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    tokens, docs, nulls = tokens + int(ends[-1]), docs + rows.num_rows, nulls + own.null_count
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (f"{name}{kind.itemsize}", pa.string()), (docs, pa.int64()), (nulls, pa.int64()), (tokens, pa.int64()))], ["part", "name", "n_docs", "n_null", "n_tokens"])

    ordered = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = materialise(ordered.mapInArrow(write, MANIFEST))
    # one row per partition, whatever the number of documents
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), folder


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it) and its ids as little-endian unsigned 32-bit integers."""

    def whole(fs: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
        if isinstance(fs, pafs.LocalFileSystem):
            return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
        with fs.open_input_file(path) as f:
            return np.frombuffer(f.read(), kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                name, size = row["name"][:-1], int(row["name"][-1])
                offsets, doc = whole(fs, f"{root}/{name}.off", "<u8").astype(np.int64), whole(fs, f"{root}/{name}.doc", "<i8")
                with fs.open_input_file(f"{root}/{name}.bin") as far:
                    local = whole(fs, f"{root}/{name}.bin", f"<u{size}") if isinstance(fs, pafs.LocalFileSystem) else None
                    lo = 0
                    while lo < len(doc):
                        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + READ_IDS, "right")) - 1)
                        a, b = int(offsets[lo]), int(offsets[hi])
                        ids = local[a:b] if local is not None else np.frombuffer(far.read_at((b - a) * size, a * size), f"<u{size}")
                        raw = pa.py_buffer(ids.astype("<u4").tobytes())
                        ends = pa.py_buffer(((offsets[lo : hi + 1] - a) * 4).astype(np.int32).tobytes())
                        null = np.arange(lo, hi) < row["n_null"]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.asarray(doc[lo:hi]), pa.int64(), mask=null), pa.array(row["base"] + offsets[lo:hi], pa.int64()), pa.Array.from_buffers(pa.binary(), hi - lo, [None, ends, raw])],
                            ["doc_id", "start", "ids"],
                        )
                        lo = hi

    return manifest.repartition(F.col("part")).mapInArrow(read, "doc_id bigint, start bigint, ids binary")

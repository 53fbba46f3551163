"""SentencePiece tables against the library itself."""

import hashlib
import random

import pyarrow as pa
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from pixelquarry.llm import queries, sentences

CONTENT = open(queries.PIECES, "rb").read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=CONTENT)
PARTS = ["a", "b", " ", "  ", "▁", "▁▁", "\n", "é", "中", "🙂", "\0", "\t", "   ", "the ", "word", "　", "<s>", "</s>", "<unk>", "<0x41>", "�", "\xa0", "é"]


def odd_texts(count, seed):
    rng = random.Random(seed)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 14))) for _ in range(count)]
    return [*made, "", " ", "  ", "a ", " a", "▁", "▁ ▁", " \n ", " " * 1000, "x" * 20000, "é" * 5000 + " " * 40 + "end "]


def test_ids_and_texts_are_the_librarys():
    model = sentences.Model(CONTENT)
    assert model.by_chunks
    model.table.limit = 30_000
    texts = odd_texts(6000, 1)
    want = LIBRARY.encode(texts)
    assert model.encode(pa.array([*texts, None])).to_pylist() == [*want, []]
    assert model.decode(pa.array([*want, None], pa.list_(pa.int32()))).to_pylist() == [*map(LIBRARY.decode, want), ""]


def test_any_ids_decode_as_in_the_library():
    rng = random.Random(2)
    ids = [[rng.choice([0, 1, 2, 3, 5, 68, 200, 240, 259, 260, 300, 5000, 29871, 29872]) for _ in range(rng.randrange(0, 6))] for _ in range(5000)]
    got = sentences.Model(CONTENT).decode(pa.array(ids, pa.list_(pa.int32()))).to_pylist()
    assert got == [LIBRARY.decode(x) for x in ids]


def test_each_distinct_chunk_is_segmented_once(monkeypatch):
    model, seen = sentences.Model(CONTENT), []
    segment = model._segment
    model.table.encode = lambda chunks: seen.extend(chunks) or segment(chunks)
    model.encode(pa.array(["one two two", "two one  two", "one"]))
    model.encode(pa.array(["two two", "three"]))
    assert sorted(seen) == [b" two", b"one", b"three", b"two"]


def test_models_whose_pieces_cross_markers_encode_whole_texts():
    proto = sentencepiece_model_pb2.ModelProto.FromString(CONTENT)
    proto.pieces[500].piece = "e▁t"
    content = proto.SerializeToString()
    model, library = sentences.Model(content), sentencepiece.SentencePieceProcessor(model_proto=content)
    texts = ["the tree the tree", "", " x", "e t", *odd_texts(300, 3)]
    assert not model.by_chunks and model.encode(pa.array(texts)).to_pylist() == library.encode(texts)


def test_query_on_odd_rows(spark, tmp_path):
    texts = [None, "", " ", "a b  c ", "a b  c ", "x" * 30000, "é 中🙂 ▁ \n"]
    rows = [(None if i == 3 else i, t, "r") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = LIBRARY.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids))))
    got = [tuple(r) for r in queries.op11_sentencepiece(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    coded = sentences.decode_ids(sentences.encode_texts(docs, queries.PIECES, ids="own"), queries.PIECES, ids="own")
    assert coded.columns == ["doc_id", "text", "ids", "own", "decoded"] and coded.filter("doc_id = 4").first().decoded == "a b  c "
    assert sentences.encode_texts(docs.limit(0), queries.PIECES).count() == 0


def test_whole_table_against_the_library(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in queries.op11_sentencepiece(spark, folder).collect():
        ids = LIBRARY.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()

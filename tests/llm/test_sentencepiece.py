import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstrata.llm import sentencepiece_codec as codec
from inkstrata.llm.queries import QUERIES, piece_model

MODEL = piece_model()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
SEGMENTER = codec.Segmenter(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=" \n\t▁abé😀</s>.,0　\x00\r中", max_size=30))
def test_same_ids_as_the_library(text):
    ids = LIBRARY.encode(text, add_eos=True)
    table = codec.ChunkTable(SEGMENTER)
    for got, decoded in table.whole([text, None, text]):
        assert (got, decoded) in ((" ".join(map(str, ids)), LIBRARY.decode(ids)), ("2", ""))


def test_query(spark, sf, library):
    out = QUERIES["op7_sentencepiece"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(out) == len(texts)
    for r in out:
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_tables(spark, library):
    long = "lorem ipsum " * 20_000
    docs = spark.createDataFrame([(1, None, 9), (1, None, 9), (None, "", 9), (2, long, 9)], "doc_id long, text string, n_tokens int")
    out = codec.encode_texts(docs, MODEL, with_ids=True).collect()
    assert [list(r.ids) for r in out if r.doc_id != 2] == [[2]] * 3
    (r,) = [r for r in out if r.doc_id == 2]
    assert list(r.ids) == library.encode(long, add_eos=True) and r.decoded == library.decode(list(r.ids))
    assert codec.encode_texts(docs.limit(0), MODEL).count() == 0


def test_frequent_chunks_are_segmented_once_and_change_nothing(spark):
    rows = [(i, " ".join(f"w{j % 7}" for j in range(i)) + ("  two▁marks" if i % 3 else "") + "x" * 70) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keys, ids, surfaces = codec.frequent_chunks(docs, MODEL, "text", 5)
    assert len(keys) == 5 == len(set(keys)) and set(keys) <= {f"w{j}" for j in range(7)}
    assert [list(map(int, i.split())) for i in ids] == LIBRARY.encode(keys) and surfaces == [f" {k}" for k in keys]
    want = {i: LIBRARY.encode(t, add_eos=True) for i, t in rows}
    for most in (1, 50_000):
        assert {r.doc_id: list(r.ids) for r in codec.encode_texts(docs, MODEL, with_ids=True, frequent=most).collect()} == want


def test_blocks_end_and_begin_anew():
    table = codec.ChunkTable(SEGMENTER, most=0)
    texts = ["one two one", "two three", "one  two "]
    got = [ids for t in texts for ids, _ in table.whole([t])]
    assert got == [" ".join(map(str, LIBRARY.encode(t, add_eos=True))) for t in texts]


def test_extra_columns(spark):
    docs = spark.createDataFrame([(str(i), f"text {i} of some", i, "c") for i in range(40)], "doc_id string, text string, ids long, chunk string")
    got = {r.doc_id: (r.n_tokens, r.chunk) for r in codec.encode_texts(docs, MODEL, keep=("doc_id", "chunk")).collect()}
    assert got == {str(i): (len(LIBRARY.encode(f"text {i} of some", add_eos=True)), "c") for i in range(40)}

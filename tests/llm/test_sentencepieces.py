"""SentencePiece encoding and decoding against the library over whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from spendgrid.llm import q_pieces, sentencepieces
from spendgrid.llm.sentencepieces import decode, encode, unpack
from spendgrid.session import read_table

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path(q_pieces.PIECES)
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def library(text):
    return SP.encode(text or "", add_bos=True, add_eos=True)


def odd_texts(n=400):
    rng = random.Random(5)
    alphabet = "ab ▁\n\t\0éλ中😀　 .,<>0x1sunk/ABC  thering"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(n)]
    return [*texts, None, "", " ", "  ", "▁", "▁ ▁", "\n", "<s> </s> <unk> <0x41>", "x" * 30_000, "ab " * 40_000, "中" * 5_000, "tail  ", "  head"]


@pytest.mark.parametrize(("texts", "words"), [(256, 1 << 18), (3, 7)])
def test_ids_and_texts_equal_the_library(make_docs, monkeypatch, texts, words):
    monkeypatch.setattr(sentencepieces, "TEXTS_AT_A_TIME", texts)
    monkeypatch.setattr(sentencepieces, "TABLE_WORDS", words)
    rows = list(enumerate(odd_texts()))
    got = decode(encode(make_docs(rows), MODEL), MODEL).collect()
    assert sorted(r.doc_id for r in got) == [i for i, _ in rows]
    text_of = dict(rows)
    for r in got:
        ids = library(text_of[r.doc_id])
        assert np.frombuffer(r.ids, "<u4").tolist() == ids, text_of[r.doc_id]
        assert r.decoded == SP.decode(ids)


@pytest.mark.parametrize(("limit", "times"), [(1 << 18, 1), (1, 4)])
def test_every_word_of_a_table_is_segmented_once(monkeypatch, limit, times):
    calls = []

    class Counting(sentencepiece.SentencePieceProcessor):
        def encode(self, words, **options):
            calls.extend(words)
            return super().encode(words, **options)

    monkeypatch.setattr(sentencepieces.sentencepiece, "SentencePieceProcessor", Counting)
    monkeypatch.setattr(sentencepieces.SparkFiles, "get", lambda file: MODEL)
    monkeypatch.setattr(sentencepieces, "TEXTS_AT_A_TIME", 2)
    monkeypatch.setattr(sentencepieces, "TABLE_WORDS", limit)
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3], "text": ["the  cat the", None, "the sat  cat "]})
    out = [r for b in sentencepieces._encode("file", b"", b"")(iter([batch, batch])) for r in b.to_pylist()]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in out] == 2 * [SP.encode("the  cat the"), [], SP.encode("the sat  cat ")]
    assert calls.count("the") == times and set(calls) == {"the", " cat", "sat", ""}


def test_options_and_repeated_rows(make_docs):
    rows = [(1, "one two"), (1, "one two"), (None, "three"), (None, None), (2, "")]
    got = encode(make_docs(rows), MODEL, begin=False, end=False)
    found = got.select("doc_id", unpack(got["ids"]).alias("n")).collect()
    assert sorted(map(str, [(r.doc_id, r.n) for r in found])) == sorted(str((i, SP.encode(t or ""))) for i, t in rows)
    assert encode(make_docs([]), MODEL).collect() == []


def test_decode_of_any_ids(spark):
    lists = [[0, 35], [1, 0, 35], [35, 35], [259, 259], [130, 35], [130, 131, 35], [2, 259], [], [1, 2]]
    rows = [(i, bytearray(np.array(ids, "<u4").tobytes())) for i, ids in enumerate(lists)] + [(99, None)]
    got = decode(spark.createDataFrame(rows, "k int, packed binary"), MODEL, "packed").collect()
    assert {r.k: r.decoded for r in got} == {i: SP.decode(ids) for i, ids in enumerate(lists)} | {99: ""}


def test_a_model_with_pieces_across_markers_is_refused(monkeypatch):
    class Crossing:
        def __init__(self, model_file):
            pass

        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return "a▁b"

    monkeypatch.setattr(sentencepieces.sentencepiece, "SentencePieceProcessor", Crossing)
    with pytest.raises(ValueError):
        sentencepieces.load(MODEL)


def test_query(spark):
    texts = {r.doc_id: r.text for r in read_table(spark, SF, "documents").collect()}
    got = q_pieces.op12_sentencepiece(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library(texts[r.doc_id])
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(SP.decode(ids).encode()).hexdigest())
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want

"""Token counts against the tokenizer library."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spendgrid.llm import token_count
from spendgrid.llm.token_count import CHUNK, compile_tokenizer, count_texts, count_tokens, piece_starts, splitter

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = [
    "", " ", "  ", "\n", "a\n\nb", "don't we'll 've 'r 'l 're're 'rex I'M", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", " <|endoftext|> ", "''s", "'s's",
    "x  y   z ", "日本語テキスト", "a" * 5000, " " * 300 + "x", "!!!!!???", "aaa aaaa aaaaa", "'", "it'r", "x'll'v", "\u2028 \u00a0a", "\x1c \x1d", "1½²Ⅷ٣", "e\u0301",
]


@pytest.fixture(scope="module")
def tables():
    return compile_tokenizer(PATH)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def noise(seed, n):
    rng = random.Random(seed)
    alphabet = [*"aab'  \n\t'srtlvemd.,!é0½9²ß\u00a0\u3000中文😀ñ\x00\x1cć", "<|endoftext|>"]
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(n)]


def test_hard_texts(tables, library):
    texts = HARD + noise(1, 1500)
    assert count_texts(texts, tables) == library(texts)


def test_groups_chunks_and_full_table_change_nothing(tables, library, monkeypatch):
    texts = HARD + noise(2, 200) + [" ".join(noise(3, 60)), "x" * 3000 + " " + "y z  " * 900]
    for name, value in (("GROUP_CHARS", 50), ("MAX_STATES", 40), ("MAX_PAIRS", 30), ("LOCKSTEP", 3), ("CHUNK", 8)):
        monkeypatch.setattr(token_count, name, value)
    assert count_texts(texts, tables) == library(texts)


def test_prefix_scan_equals_a_plain_walk():
    to, out = splitter()
    cls = np.random.default_rng(0).integers(0, 12, 5 * CHUNK + 17).astype(np.uint8)
    state, starts = 0, set()
    for i, c in enumerate(cls):
        said = out[state, c]
        starts |= {i} if said & 1 else set()
        starts |= {i - 1} if said & 2 else set()
        state = to[state, c]
    if out[state, 11] & 2:
        starts.add(len(cls) - 1)
    assert set(np.flatnonzero(piece_starts(cls, to, out)).tolist()) == starts


def test_documents_and_edges(spark, make_docs, library):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + HARD[:6] + ["long text " * 100_000]
    rows = list(enumerate(texts)) + [(7, None), (7, None), (None, "a b")]
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(make_docs(rows), PATH).collect()), key=str)
    counts = library([t or "" for _, t in rows])
    assert got == sorted(((i, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(rows, counts)), key=str)
    assert count_tokens(make_docs([]), PATH).collect() == []


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        compile_tokenizer(public_tokenizers.path("word_bpe_49k.json"))

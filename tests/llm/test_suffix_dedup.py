"""Repeated passages against a table of all 200-byte windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from spendgrid.llm import suffix_dedup
from spendgrid.llm.suffix_dedup import multikey_quicksort, remove_repeats


def brute(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, texts):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = [s for s in bytes(gone).split(b"\0") if s]
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9)))
    passage = lambda n: " ".join(word() for _ in range(n))
    shared = [passage(60) for _ in range(4)]
    rows = []
    for i in range(40):
        parts = [passage(rng.randint(0, 60)) for _ in range(rng.randint(1, 3))]
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            cut = rng.randint(0, 40)
            parts.insert(rng.randint(0, len(parts)), s[cut : len(s) - rng.randint(0, 120)])
        rows.append((i, " ".join(parts)))
    base = passage(120)
    for i in range(12):  # near copies: one change each
        at = rng.randrange(len(base))
        rows.append((100 + i, base[:at] + "#" + base[at + 1 :]))
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, None), (203, ""), (204, "a" * 199), (205, "b" * 201), (206, "c" * 1000), (207, "d" * 200)]
    inside = passage(50)
    return rows + [(208, inside + " ! " + inside), (None, passage(50)), (209, "z" * 50 + passage(40)), (209, "z" * 50 + passage(40)), (210, "\0" * 400 + "x")]


@pytest.mark.parametrize("bucket_rows", [32_768, 20])
def test_matches_all_windows(make_docs, monkeypatch, bucket_rows):
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", bucket_rows)  # small: grams are cut by splitters
    rows = rows_of(bucket_rows)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(make_docs(rows)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_long_text_across_stretches(make_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", 1000)
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    rows = [(1, text), (2, "x" + text[700:2600] + "y"), (3, text[5000:5300] + text[:150])]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(make_docs(rows)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_spans_rebuild_the_kept_bytes(make_docs):
    rows = rows_of(9)
    for r in remove_repeats(make_docs(rows), spans=True).join(make_docs(rows).select("doc_id", "text"), "doc_id").collect():
        data = (r.text or "").encode()
        for s in reversed(r.spans or []):
            data = data[: s.start] + data[s.stop :]
        if r.doc_id not in (209,):  # two texts share this id
            assert hashlib.sha256(data).hexdigest() == r.kept_sha256


def test_empty_table(make_docs):
    assert remove_repeats(make_docs([])).collect() == []


def test_multikey_quicksort_sorts():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    got = words[multikey_quicksort(words)]
    assert (got == words[np.lexsort(words.T[::-1])]).all()


def test_string_not_longer_than_a_gram(make_docs):
    with pytest.raises(ValueError):
        suffix_dedup.Grams(suffix_dedup.GRAM)

"""Packing: boundaries against all choices, batches within the budget."""

import random
from collections import defaultdict
from itertools import combinations

import pytest

from spendgrid.llm import packing
from spendgrid.llm.packing import optimal_boundaries, pack


def padding(hist, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in hist)


@pytest.mark.parametrize("seed", range(8))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    hist = [(x, rng.randint(1, 50)) for x in rng.sample(range(100), rng.randint(1, 9))]
    for k in (1, 2, 3, 4, 12):
        bounds = optimal_boundaries(hist, k)
        lengths = sorted(x for x, _ in hist)
        best = min(padding(hist, [*c, lengths[-1]]) for r in range(min(k, len(lengths))) for c in combinations(lengths[:-1], r))
        assert len(bounds) <= k and bounds == sorted(bounds) and padding(hist, bounds) == best


def test_no_lengths():
    assert optimal_boundaries([], 4) == []


@pytest.mark.parametrize("part_rows", [50_000, 10])
def test_batches_fit_the_budget(make_docs, monkeypatch, part_rows):
    monkeypatch.setattr(packing, "PART_ROWS", part_rows)
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 400)) for i in range(300)] + [(1000, None), (1001, "w " * 50_000), (7, "again"), (7, "again"), (None, "x y")]
    docs = make_docs(rows)
    got = pack(docs, buckets=6, token_budget=2048, multiple_of=8).collect()
    assert sorted(str((r.doc_id, r.n_tokens)) for r in got) == sorted(str((i, len((t or "").split()))) for i, t in rows)
    batches = defaultdict(list)
    for r in got:
        assert r.bucket_len % 8 == 0 and r.n_padding == r.bucket_len - r.n_tokens >= 0
        batches[r.batch].append(r)
    for members in batches.values():
        assert len({r.bucket for r in members}) == 1
        assert len(members) * members[0].bucket_len <= 2048 or len(members) == 1 or members[0].bucket_len == 0
        assert sorted(r.slot for r in members) == list(range(len(members)))
    hist = defaultdict(int)
    for r in got:
        hist[-(-r.n_tokens // 8) * 8] += 1
    chosen = sum(r.bucket_len - -(-r.n_tokens // 8) * 8 for r in got)
    assert chosen == padding(hist.items(), optimal_boundaries(list(hist.items()), 6))


def test_empty_table(make_docs):
    assert pack(make_docs([])).collect() == []

"""Whitening against a dense eigendecomposition."""

import math
from fractions import Fraction

import numpy as np
import pytest

from spendgrid.llm import q_embed, whitening
from spendgrid.llm.whitening import whiten
from spendgrid.session import read_table

SF = "/root/testdata/sf0.001"


def table(spark, vectors, parts=4):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], "clash", 1) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, x string, n int").repartition(parts)


def check(got, ids, vectors, k=8):
    x = np.floor(1024 * np.array(vectors, dtype=np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    values, basis = np.linalg.eigh(c.T @ c / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    want = c @ basis / np.sqrt(values)
    assert sorted((r.vec_id, r.component) for r in got) == [(i, j) for i in sorted(ids) for j in range(1, len(values) + 1)]
    place = {i: at for at, i in enumerate(ids)}
    found = np.zeros_like(want)
    for r in got:
        found[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == int(((n * x[place[r.vec_id]] - s) ** 2).sum())
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(c.T @ c / n), rel=1e-9)
        assert r.identity_error < 1e-9
    sign = np.sign((found * want).sum(axis=0))
    assert np.abs(found * sign - want).max() < 1e-9


@pytest.mark.parametrize("dim", [3, 8, 60])
def test_against_dense(spark, dim):
    rng = np.random.default_rng(dim)
    scale = 1.15 ** -np.arange(dim)
    vectors = list(rng.standard_normal((500, dim)) * scale + rng.standard_normal(dim))
    bad = [None, [], [None] + [0.0] * (dim - 1), [math.nan] * dim, [math.inf] + [0.0] * (dim - 1), [1.0]]
    got = whiten(table(spark, bad + vectors)).collect()
    check(got, range(len(bad), len(bad) + len(vectors)), vectors, min(dim, 8))


def test_query(spark):
    rows = [r for r in read_table(spark, SF, "embeddings").collect() if r.embedding]
    check(q_embed.op13_whitening(spark, SF).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_degenerate_tables(spark):
    assert whiten(table(spark, [])).collect() == [] == whiten(table(spark, [None, [math.nan]])).collect()
    one = whiten(table(spark, [[0.5, 0.25]])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)]
    flat = whiten(table(spark, [[1.0, i] for i in range(5)])).collect()  # the first dimension does not vary
    assert {r.component: r.whitened is None for r in flat} == {1: False, 2: True} and flat[0].identity_error < 1e-12


def test_deviations_are_exact_or_null():
    x = np.array([[100_000, 100_500], [99_000, 100_001]], dtype=np.int64)
    for n in (2, 10**6, 10**15):
        sums = [100_003 * n // 2 + 1, 100_007 * n // 2 + n // 3]
        centre = whitening.Centre(n, sums)
        for got, row in zip(centre.deviations(x), x.tolist(), strict=True):
            want = sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True))
            assert got == (want if want < 1 << 63 else None)
        exact = [[float(Fraction(v) - Fraction(s, n)) for v, s in zip(row, sums, strict=True)] for row in x.tolist()]
        assert np.allclose(centre.rows(x), exact, rtol=1e-15, atol=1e-9)


def test_null_ids_and_repeats_stay_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(None if i % 3 == 0 else i % 5, rng.standard_normal(4).tolist()) for i in range(60)]
    got = whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(str(i) for i, _ in rows for _ in range(4))


def test_uncertified_raises(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MAX_ROUNDS", 1)
    vectors = list(np.random.default_rng(0).standard_normal((200, 64)))
    with pytest.raises(RuntimeError):
        whiten(table(spark, vectors))

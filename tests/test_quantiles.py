"""Quantiles by histogram selection against numpy."""

import math

import numpy as np
import pytest

from spendgrid.functions import windows as W


def groups(rng):
    return {
        "normal": rng.standard_normal(1000).tolist(),
        "ties": rng.integers(0, 3, 500).astype(float).tolist(),
        "one": [4.25],
        "two": [1.0, 2.0],
        "same": [0.1] * 77,
        "scales": (10.0 ** rng.uniform(-300, 300, 300) * rng.choice([-1, 1], 300)).tolist(),
        "widest": [-1.7e308, 1.7e308, 0.0, 1.0, 5e-324, 0.0],
        "near": [1.0 + i * 2.3e-16 for i in range(40)],
        None: rng.exponential(size=101).tolist(),
    }


@pytest.mark.parametrize("bins", [4096, 16])
def test_against_numpy(spark, monkeypatch, bins):
    monkeypatch.setattr(W, "BINS", bins)
    data = groups(np.random.default_rng(1))
    if bins == 16:
        data = {k: v for k, v in data.items() if k in ("two", "ties", "same", "near", None)}
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("ties", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    qs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.99, "e": 1.0}
    got = {r.g: r for r in W.exact_percentiles(df, ["g"], "v", qs).collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        s = sorted(vs)
        for name, q in qs.items():
            at = q * (len(s) - 1)
            lo, hi = s[math.floor(at)], s[math.ceil(at)]
            want = lo if lo == hi else lo + (hi - lo) * (at - math.floor(at))
            assert got[k][name] == want, (k, name)


def test_infinities_and_nan_are_ordered(spark):
    vs = [float("-inf"), float("-inf"), -1.0, 0.0, 3.0, float("inf"), float("nan")]
    df = spark.createDataFrame([(1, v) for v in vs], "g int, v double")
    qs = {f"q{i}": i / 6 for i in range(7)}
    r = W.exact_percentiles(df, ["g"], "v", qs).first()
    got = [r[f"q{i}"] for i in range(7)]
    assert got[:6] == vs[:6] and math.isnan(got[6])


def test_values_are_not_shuffled(spark, monkeypatch):
    """In every pass the scan is joined and counted where it lies: only counts cross an exchange."""
    plans = []
    keep = W.stored

    def seen(df, name):
        out = keep(df, name)
        plans.append((name, df))
        return out

    monkeypatch.setattr(W, "stored", seen)
    df = spark.range(20_000).selectExpr("id % 3 AS g", "sin(id) AS v")
    assert W.exact_percentiles(df, ["g"], "v", {"m": 0.5}).count() == 3
    passes = [d for name, d in plans if name == "quantile-state"]
    assert 2 <= len(passes) <= 5
    for d in passes[1:]:
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin [g" not in plan
    assert W.exact_percentile(df, "v", 0.25) == pytest.approx(np.quantile(np.sin(np.arange(20_000)), 0.25), abs=1e-12)
    assert W.exact_percentile(df.limit(0), "v", 0.5) is None

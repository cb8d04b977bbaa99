"""Matching pursuit and the cascaded tree."""

import numpy as np
from pyspark.sql import functions as F

from spendgrid.operators import ml as ML


def frame(spark, x, y):
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)]
    names = [f"x{i}" for i in range(x.shape[1])]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in (*names, "y"))), names


def plain(x, y, k):
    """Orthogonal matching pursuit by least squares at each step."""
    taken, r = [], y
    while len(taken) < k and r @ r > 1e-12 * (y @ y):
        taken.append(int(np.argmax(np.abs(x.T @ r) / np.linalg.norm(x, axis=0))))
        r = y - x[:, taken] @ np.linalg.lstsq(x[:, taken], y, rcond=None)[0]
    w = np.zeros(x.shape[1])
    w[taken] = np.linalg.lstsq(x[:, taken], y, rcond=None)[0]
    return w


def test_matching_pursuit(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((80, 30)) * rng.uniform(0.1, 9, 30)
    true = np.zeros(30)
    true[[2, 11, 17, 29]] = [5.0, -3.0, 2.0, 0.5]
    df, names = frame(spark, x, x @ true)
    assert np.allclose(ML.matching_pursuit(df, "y", names, 10), true, atol=1e-9)
    noisy = x @ true + 0.3 * rng.standard_normal(80)
    df, names = frame(spark, x, noisy)
    for k in (1, 3, 6):
        got = ML.matching_pursuit(df, "y", names, k)
        assert np.allclose(got, plain(x, noisy, k), atol=1e-8) and np.count_nonzero(got) == k


def test_matching_pursuit_edges(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((20, 4))
    x[:, 1], x[:, 2] = 2 * x[:, 0], 0.0  # the same direction twice, and an empty column
    df, names = frame(spark, x, x[:, 0] + 0.1 * rng.standard_normal(20))
    got = ML.matching_pursuit(df.unionByName(df.limit(1).withColumn("x3", F.lit(None).cast("double"))), "y", names, 4)
    assert np.count_nonzero(got) == 2 and got[2] == 0 and got[0] * got[1] == 0
    assert not ML.matching_pursuit(df.limit(0), "y", names, 4).any()


def test_tree_levels_add_up_without_copies_of_the_facts(spark, monkeypatch):
    from spendgrid.functions.measures import Period
    from spendgrid.operators import rollup as R
    from spendgrid.plans import bindings as B

    seen = []
    keep = R.stored
    monkeypatch.setattr(R, "stored", lambda df, name: (seen.append((name, df)), keep(df, name))[1])
    facts, hier = B.facts(spark, "/root/testdata/sf0.001"), ["agrupa1", "division", "territorio"]
    tree = R.rollup_tree(facts, hier, Period(1, 30), smr=B.SMR)
    plan = dict(seen)["tree-deepest"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "Expand" not in tree._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.level, r.agrupa1, r.division): r.real for r in tree.collect() if r.level < 3}
    total = sum(v for (level, *_), v in got.items() if level == 1)
    assert abs(total - got[0, None, None]) < 0.05
    assert R.rollup_tree(facts.limit(0), hier, Period(1, 30), smr=B.SMR).collect() == []

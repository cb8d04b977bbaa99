"""Blocked Gram products against numpy, with gaps, and without rows of pairs."""

import numpy as np
import pandas as pd
import pytest

from spendgrid.operators import risk as RK


def panel(spark, dates, assets, gaps, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((dates, assets)) @ (np.eye(assets) + 0.3 * rng.standard_normal((assets, assets))) * 0.01 + 5.0
    x[:, 0] = 0.1
    x[rng.random(x.shape) < gaps] = np.nan
    d, a = np.nonzero(~np.isnan(x))
    frame = pd.DataFrame({"date": d, "asset": [f"a{i:04d}" for i in a], "ret": x[d, a]})
    return pd.DataFrame(x, columns=[f"a{i:04d}" for i in range(assets)]), spark.createDataFrame(frame)


@pytest.mark.parametrize(("block", "dates"), [(256, 1024), (3, 7)])
def test_against_pairwise_complete(spark, monkeypatch, block, dates):
    monkeypatch.setattr(RK, "ASSET_BLOCK", block)
    monkeypatch.setattr(RK, "DATE_BLOCK", dates)
    x, ret = panel(spark, 40, 8, 0.5)
    x.iloc[:, 7] = np.nan
    x.iloc[3, 7] = 1.0  # one date only
    ret = ret.filter("asset <> 'a0007'").unionByName(spark.createDataFrame([(3, "a0007", 1.0)], ret.schema))
    got = {(r.asset_i, r.asset_j): r for r in RK.cov_corr_matrix(ret, rounded=False).collect()}
    cov, corr = x.cov(min_periods=2), x.corr(min_periods=2)
    for i in x.columns:
        for j in x.columns:
            r = got.pop((i, j), None)
            if r is None:
                assert (x[i].notna() & x[j].notna()).sum() == 0
                continue
            assert (r.cov is None) == np.isnan(cov.loc[i, j]) and (r.cov is None or r.cov == pytest.approx(cov.loc[i, j], abs=1e-13))
            if "a0000" in (i, j) or np.isnan(cov.loc[i, j]):
                assert r["corr"] is None  # a constant asset
            else:
                assert r["corr"] == pytest.approx(corr.loc[i, j], abs=1e-9)
    assert not got


def test_two_thousand_assets_without_rows_of_pairs(spark):
    x, ret = panel(spark, 30, 2000, 0.0, 1)
    out = RK.cov_corr_matrix(ret, rounded=False)
    assert out.count() == 2000 * 2000
    want = np.cov(x.to_numpy().T)
    for r in out.filter("asset_i IN ('a0003', 'a1999') AND asset_j IN ('a0001', 'a0300', 'a1999')").collect():
        assert r.cov == pytest.approx(want[int(r.asset_i[1:]), int(r.asset_j[1:])], abs=1e-14)


def test_empty(spark):
    assert RK.cov_corr_matrix(spark.createDataFrame([], "date int, asset string, ret double")).collect() == []

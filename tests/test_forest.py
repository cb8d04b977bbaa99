"""Forests grown from sums per cell: trees by hand, and Spark ML's forests on the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendgrid.operators import forest as FO
from spendgrid.operators import ml as ML


def panel(spark, n=6000, copies=1):
    rng = np.random.default_rng(3)
    x, x2 = rng.integers(1, 51, n).astype(float), rng.normal(size=n)
    t = 0.1 * np.sin(x / 8) + 0.05 * (x2 > 0) + rng.normal(0, 0.1, n)
    y = 30 * x + 5 * np.abs(x2) + 40 * t + rng.normal(0, 20, n)
    rows = [(int(i % 5), float(a), float(b), float(c), float(d)) for i, (a, b, c, d) in enumerate(zip(y, t, x, x2, strict=True))]
    return spark.createDataFrame(rows * copies, "fold int, y double, t double, x double, x2 double")


def test_a_tree_splits_where_squared_deviations_fall_most():
    bins = [np.array([0, 0, 1, 1, 2, 2])]
    w, y = np.array([2.0, 1, 1, 2, 3, 0]), np.array([1.0, 1, 1, 1, 9, 0])
    assert FO._tree(w, w * y, w * y * y, bins, [0]).tolist() == [1.0, 1.0, 1.0, 1.0, 9.0, 9.0]
    one = np.array([0.0, 0, 0, 0, 0, 4])
    assert FO._tree(one, one * 3, one * 9, bins, [0]).tolist() == [3.0] * 6  # nothing to split


def test_bags_hold_every_row_about_once_a_tree(spark):
    d = panel(spark, 2000)
    cuts = FO.thresholds(d, ["x", "x2"])
    assert len(cuts[0]) == 31 and len(cuts[1]) == 31
    few = FO.thresholds(d.withColumn("x", F.col("x") % 3), ["x"])[0]
    assert few.tolist() == [0.5, 1.5]
    cells = 32 * 32
    rows = d.select("fold", "y", "t", "x", "x2").mapInArrow(FO._sums(cuts, cells, 50, 1), "fold int, s array<double>").collect()
    s = sum(np.array(r["s"]).reshape(5, cells, 50) for r in rows)
    weights = s[0].sum(axis=0)
    assert abs(weights.mean() - 2000) < 30 and 20 < weights.std() < 80 and (weights == weights.round()).all()
    assert s[1].sum() / 50 == pytest.approx(d.agg(F.sum("y")).first()[0], rel=0.02)


def test_forests_from_sums_estimate_as_spark_forests_do(spark, monkeypatch):
    """Beyond the bound no Spark forest is fitted; effect and error agree within the bags' noise."""
    from pyspark.ml.regression import RandomForestRegressor

    d, xs = panel(spark), ["x", "x2"]
    fitted = ML.double_ml(d, "y", "t", xs, 5, "forest").first()
    monkeypatch.setattr(ML, "FITTED_ROWS", 100, raising=False)
    monkeypatch.setattr(RandomForestRegressor, "fit", None)
    grown, again = (ML.double_ml(d, "y", "t", xs, 5, "forest").first() for _ in range(2))
    assert grown == again and grown.n == fitted.n == 6000
    assert abs(grown.tau - fitted.tau) < fitted.se / 2 and grown.se == pytest.approx(fitted.se, rel=0.1)
    assert grown.ci_lo < 40 < grown.ci_hi


def test_rows_of_other_folds_train_and_are_not_predicted(spark):
    d = panel(spark, 1000)
    more = d.withColumn("fold", F.lit(9)).unionByName(d.withColumn("fold", F.lit(None).cast("int"))).unionByName(d)
    assert FO.residuals(more, ["x", "x2"], 5, trees=3).count() == 1000


def test_missing_numbers_raise(spark):
    with pytest.raises(Exception, match="null or NaN"):
        FO.residuals(panel(spark, 200).withColumn("x2", F.when(F.col("x") > 9, F.col("x2"))), ["x", "x2"], 5, trees=2).count()

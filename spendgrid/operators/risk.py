"""Market risk over a long price panel (W1, R1-R9, A22) and portfolios.

Inputs are long frames: ``prices(date, asset, price)``, ``ret(date, asset, ret)``,
``weights(asset, w)``. Quantiles are exact (linear interpolation), taken by distributed row
numbers: no task holds all returns of an asset.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendgrid.functions.windows import exact_percentiles, global_index
from spendgrid.session import stored

DP = 10  # output rounding for ratios of returns


def log_returns(prices: DataFrame) -> DataFrame:
    """``ln(p / lag(p))`` per asset on complete-case dates (a date is kept only when
    every asset of the panel has a price); the first date of each asset is dropped."""
    n_assets = prices.select(F.countDistinct("asset")).scalar()
    complete = prices.groupBy("date").agg(F.countDistinct("asset").alias("k")).filter(F.col("k") == n_assets)
    p = prices.join(complete.select("date"), "date", "left_semi")
    # a window partition is one asset's dates: already aggregated, it grows with time only
    w = Window.partitionBy("asset").orderBy("date")
    r = p.withColumn("ret", F.log(F.col("price") / F.lag("price").over(w)))
    return r.filter(F.col("ret").isNotNull()).select("date", "asset", "ret")


def _z(level: float, tail: str) -> float:
    return NormalDist().inv_cdf(1 - level if tail == "lower" else level)


def var_historical(ret: DataFrame, level: float = 0.95, tail: str = "lower", by: str = "asset") -> DataFrame:
    """Historical VaR = quantile of returns at 1-level (lower tail) or level (upper,
    as the source notebook does)."""
    q = 1 - level if tail == "lower" else level
    return exact_percentiles(ret, [by], "ret", {"var_hist": q})


def var_parametric(ret: DataFrame, level: float = 0.95, tail: str = "lower", by: str = "asset") -> DataFrame:
    """R2: mean + z * sample sd, z from the normal quantile of the tail."""
    z = _z(level, tail)
    return ret.groupBy(by).agg((F.avg("ret") + F.lit(z) * F.stddev_samp("ret")).alias("var_param"))


def cvar(ret: DataFrame, thresholds: DataFrame, col: str, by: str = "asset") -> DataFrame:
    """Mean of returns at or below each group's threshold ``col``."""
    j = ret.join(thresholds.select(by, col), by)
    return j.filter(F.col("ret") <= F.col(col)).groupBy(by).agg(F.avg("ret").alias("cvar"))


def risk_table(ret: DataFrame, level: float = 0.95, tail: str = "lower") -> DataFrame:
    """Per asset mean, sample sd, historical and parametric VaR, historical CVaR. The returns
    are stored once for the four readers."""
    ret = stored(ret.select("date", "asset", "ret"), "returns")
    base = ret.groupBy("asset").agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"))
    vh = var_historical(ret, level, tail)
    vp = var_parametric(ret, level, tail)
    cv = cvar(ret, vh, "var_hist")
    out = base.join(vh, "asset").join(vp, "asset").join(cv, "asset", "left")
    return out.select("asset", *[F.round(c, DP).alias(c) for c in ("mean", "sd", "var_hist", "var_param", "cvar")])


def portfolio_returns(ret: DataFrame, weights: DataFrame) -> DataFrame:
    """Portfolio return per date = sum of w * r (weights joined on asset)."""
    return ret.join(weights, "asset").groupBy("date").agg(F.sum(F.col("w") * F.col("ret")).alias("ret"))


def equal_weights(ret: DataFrame) -> DataFrame:
    n = ret.select(F.countDistinct("asset")).scalar()
    return ret.select("asset").distinct().withColumn("w", F.lit(1.0) / n)


def portfolio_risk(ret: DataFrame, weights: DataFrame, level: float = 0.95, tail: str = "lower") -> DataFrame:
    """Portfolio mean, sd, historical VaR, parametric VaR and parametric CVaR
    (mean of portfolio returns at or below the parametric VaR)."""
    pr = portfolio_returns(ret, weights).withColumn("asset", F.lit("portfolio"))
    stats = pr.agg(
        F.avg("ret").alias("mean"),
        F.stddev_samp("ret").alias("sd"),
        (F.avg("ret") + F.lit(_z(level, tail)) * F.stddev_samp("ret")).alias("var_param"),
    )
    stats = stats.withColumn("var_hist", var_historical(pr, level, tail).select("var_hist").scalar())
    thr = stats.select("var_param").scalar()
    cv = pr.filter(F.col("ret") <= thr).agg(F.avg("ret").alias("cvar"))
    stats = stats.withColumn("cvar", cv.select("cvar").scalar())
    return stats.select(*[F.round(c, DP).alias(c) for c in ("mean", "sd", "var_hist", "var_param", "cvar")])


#: Assets of a block of the Gram matrix, and dates of one on average.
ASSET_BLOCK, DATE_BLOCK = 256, 1024
GRAMS = ("n", "si", "sj", "sii", "sjj", "sij")


def _gram_block(size: int):
    """Partial sums of the pairs of two blocks of ``size`` assets over a block of dates, each over the dates that both assets have."""

    def sums_of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, a, b = key
        at, dates = pd.factorize(rows["date"])
        assets, column = np.unique(rows["k"].to_numpy(), return_inverse=True)
        x, here = np.zeros((len(dates), len(assets))), np.zeros((len(dates), len(assets)))
        x[at, column], here[at, column] = rows["x"].to_numpy(), 1.0
        one, two = assets // size == a, assets // size == b
        xa, ma, xb, mb = x[:, one], here[:, one], x[:, two], here[:, two]
        sums = dict(zip(GRAMS, (ma.T @ mb, xa.T @ mb, ma.T @ xb, (xa * xa).T @ mb, ma.T @ (xb * xb), xa.T @ xb), strict=True))
        i, j = np.nonzero((assets[one][:, None] <= assets[two][None, :]) & (sums["n"] > 0))
        return pd.DataFrame({"i": assets[one][i], "j": assets[two][j], **{c: m[i, j] for c, m in sums.items()}})

    return sums_of


def cov_corr_matrix(ret: DataFrame, rounded: bool = True) -> DataFrame:
    """Sample covariance and correlation for every asset pair; long output.

    ``ret`` has one return per date and asset; dates on which one of two assets has none do not
    count for the pair. Blocked Gram products: a task multiplies the returns of two blocks of
    assets over a block of dates, and beside them the matrices of which are there; only the half
    with i <= j is computed. The partial sums of a pair are then added over the date blocks. A
    return is copied once per asset block and no rows of pairs of returns exist. Returns are taken
    less their asset's mean, so that large means cancel nothing. Fewer than two common dates give
    no covariance, and a variance of zero no correlation.
    """
    r = stored(ret.select("date", "asset", F.col("ret").cast("double").alias("ret")).filter("ret IS NOT NULL"), "gram-returns")
    names = r.groupBy("asset").agg(F.avg("ret").alias("mean"), F.min("ret").alias("lo"), F.max("ret").alias("hi"))
    names = names.select("asset", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("mean")).alias("mean"))
    names = stored(global_index(names, [F.col("asset")], "k"), "gram-assets")
    assets, dates = names.count(), r.select(F.countDistinct("date")).first()[0]
    blocks, parts = -(-assets // ASSET_BLOCK), -(-dates // DATE_BLOCK)
    x = r.join(names, "asset").select("date", "k", (F.col("ret") - F.col("mean")).alias("x"))
    x = x.withColumn("part", F.pmod(F.xxhash64("date"), F.lit(max(parts, 1)))).withColumn("own", F.expr(f"k div {ASSET_BLOCK}"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(blocks, 1) - 1).cast("bigint"))))
    x = x.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))
    schema = "i bigint, j bigint, " + ", ".join(f"{c} double" for c in GRAMS)
    grams = x.select("part", "a", "b", "date", "k", "x").groupBy("part", "a", "b").applyInPandas(_gram_block(ASSET_BLOCK), schema)
    g = grams.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in GRAMS])
    n = F.col("n")
    less = lambda square, s: square - s * s / n
    spread = lambda square, s: F.when(less(square, s) > square * 1e-12, less(square, s))
    both = F.col("sij") - F.col("si") * F.col("sj") / n
    cov = F.when(n > 1, both / F.nullif(n - 1, F.lit(0.0)))
    corr = F.when(n > 1, both / F.sqrt(spread(F.col("sii"), F.col("si")) * spread(F.col("sjj"), F.col("sj"))))
    corr = F.when(corr.isNotNull(), F.least(F.greatest(corr, F.lit(-1.0)), F.lit(1.0)))
    g = stored(g.select("i", "j", cov.alias("cov"), corr.alias("corr")), "grams")
    g = g.unionByName(g.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "cov", "corr"))
    one = names.select(F.col("k").alias("i"), F.col("asset").alias("asset_i"))
    two = names.select(F.col("k").alias("j"), F.col("asset").alias("asset_j"))
    out = g.join(one, "i").join(two, "j").select("asset_i", "asset_j", "cov", "corr")
    if not rounded:
        return out
    return out.select("asset_i", "asset_j", F.round("cov", 12).alias("cov"), F.round("corr", DP).alias("corr"))


def vol_comparison(ret: DataFrame, weights: DataFrame) -> DataFrame:
    """Each asset's sample sd next to the portfolio's."""
    a = ret.groupBy("asset").agg(F.stddev_samp("ret").alias("sd"))
    p = portfolio_returns(ret, weights).agg(F.stddev_samp("ret").alias("sd")).select(F.lit("portfolio").alias("asset"), "sd")
    return a.unionByName(p).select("asset", F.round("sd", DP).alias("sd"))


def histogram(df: DataFrame, col: str, bins: int = 50, by: str = "asset") -> DataFrame:
    """Equal-width bins over each group's [min, max]; last bin closed; empty bins kept."""
    mm = df.groupBy(by).agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    j = df.join(mm, by)
    b = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(col) - F.col("lo")) / width), F.lit(bins - 1)))
    counts = j.groupBy(by, b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = mm.select(by, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, [by, "bin"], "left").fillna(0, ["n"])
    return out.select(
        by, "bin",
        F.round(F.col("lo") + F.col("bin") * width, DP).alias("bin_lo"),
        F.round(F.col("lo") + (F.col("bin") + 1) * width, DP).alias("bin_hi"),
        F.col("n").cast("bigint").alias("n"),
    )


def shrink_cov(cov: DataFrame) -> DataFrame:
    """Blend the sample covariance with mean-variance x I:
    alpha = clip((tr(S)/n - tr(S^2)/n) / max((1+1/n) tr(S)/n - tr(S^2)/n, 1e-8), 0, 1),
    with tr(S^2) = sum of squared entries (S symmetric)."""
    s = cov.agg(
        F.countDistinct("asset_i").alias("n"),
        F.sum(F.when(F.col("asset_i") == F.col("asset_j"), F.col("cov"))).alias("trs"),
        F.sum(F.col("cov") * F.col("cov")).alias("trss"),
    )
    n, trs, trss = (s.select(c).scalar() for c in ("n", "trs", "trss"))
    num = trs / n - trss / n
    den = F.greatest((1 + 1 / n) * (trs / n) - trss / n, F.lit(1e-8))
    alpha = F.greatest(F.lit(0.0), F.least(F.lit(1.0), num / den))
    target = F.when(F.col("asset_i") == F.col("asset_j"), trs / n).otherwise(F.lit(0.0))
    return cov.select(
        "asset_i", "asset_j",
        F.round((1 - alpha) * F.col("cov") + alpha * target, 12).alias("cov_shrunk"),
        F.round(alpha, DP).alias("alpha"),
    )


def describe_by(df: DataFrame, group: str, col: str) -> DataFrame:
    """Count, mean, sample sd, min, quartiles (linear interpolation), max."""
    q = exact_percentiles(df, [group], col, {"q25": 0.25, "q50": 0.5, "q75": 0.75}).withColumnRenamed(group, "_group")
    g = df.groupBy(group).agg(
        F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"), F.max(col).alias("max"),
    )
    g = g.join(q, F.col(group).eqNullSafe(F.col("_group")), "left")
    return g.select(group, "count", *[F.round(c, DP).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


RF_ANNUAL = 0.02  # fixed value: risk-free rate of the source


def score_portfolios(weights: DataFrame, ret: DataFrame, buckets: int = 20) -> DataFrame:
    """Score candidate portfolios ``weights(portfolio, asset, w)`` with mean returns
    and the sample covariance: ret = w.mu, var = w'Sw, sharpe = (ret - 0.02) / sqrt(var +
    1e-8); the lowest-variance portfolio of each of ``buckets`` equal return buckets is on
    the empirical frontier.

    The variance joins each holding to its asset's covariances and those to the portfolio's
    other holdings, so a portfolio costs the pairs it holds, whatever the number of assets.
    """
    mu = ret.groupBy("asset").agg(F.avg("ret").alias("mu"))
    cov = cov_corr_matrix(ret, rounded=False)  # unrounded: rounded inputs make exact ties
    per = weights.join(mu, "asset").groupBy("portfolio").agg(F.sum(F.col("w") * F.col("mu")).alias("ret"))
    one = weights.select("portfolio", F.col("asset").alias("asset_i"), F.col("w").alias("wi"))
    two = weights.select("portfolio", F.col("asset").alias("asset_j"), F.col("w").alias("wj"))
    # the portfolio's own pairs first: at most its holdings squared, then one covariance each
    pairs = one.join(two, "portfolio").join(cov, ["asset_i", "asset_j"])
    var = pairs.groupBy("portfolio").agg(F.sum(F.col("wi") * F.col("wj") * F.col("cov")).alias("var"))
    s = per.join(var, "portfolio")
    s = s.withColumn("sharpe", (F.col("ret") - RF_ANNUAL) / F.sqrt(F.col("var") + 1e-8))
    lo, hi = s.select(F.min("ret")).scalar(), s.select(F.max("ret")).scalar()
    width = (hi - lo) / buckets
    b = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("ret") - lo) / width), F.lit(buckets - 1))).cast("int")
    s = s.withColumn("bucket", b)
    best = s.groupBy("bucket").agg(F.min_by("portfolio", F.struct(F.round("var", 10), "portfolio")).alias("portfolio")).withColumn("on_frontier", F.lit(True))
    out = s.join(best, ["bucket", "portfolio"], "left").fillna(False, ["on_frontier"])
    return out.select(
        "portfolio", F.round("ret", DP).alias("ret"), F.round("var", 10).alias("var"), F.round("sharpe", 6).alias("sharpe"),
        "bucket", "on_frontier",
    )


def evaluate_weights(ret: DataFrame, weights: DataFrame) -> DataFrame:
    """Daily mean, population sd, Sharpe vs 0.02/252, and annualised figures."""
    pr = portfolio_returns(ret, weights)
    g = pr.agg(F.avg("ret").alias("m"), F.stddev_pop("ret").alias("v"))
    sharpe = F.when(F.col("v") > 0, (F.col("m") - RF_ANNUAL / 252) / F.col("v")).otherwise(0.0)
    return g.select(
        F.round("m", DP).alias("mean"), F.round("v", DP).alias("vol"), F.round(sharpe, 8).alias("sharpe"),
        F.round(F.col("m") * 252, DP).alias("mean_annual"), F.round(F.col("v") * F.sqrt(F.lit(252.0)), DP).alias("vol_annual"),
        F.round(sharpe * F.sqrt(F.lit(252.0)), 8).alias("sharpe_annual"),
    )

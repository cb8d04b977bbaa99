"""Execution schedules, paths and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Model parameters of the source notebook.
S0, GAMMA, LAMBDA, ETA, N_INTERVALS = 100.0, 1e-6, 1e-5, 1e-6, 50


def schedules(orders: DataFrame, n: int = N_INTERVALS) -> DataFrame:
    """Per (asset, Q) three schedules over ``n`` intervals, normalised to Q:
    uniform, rising ``(i+1)/n`` and falling ``1 - i/n`` (both sum to (n+1)/2)."""
    i = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")
    base = orders.select("asset", "Q", i)
    half = (n + 1) / 2
    kinds = F.explode(F.array(F.lit("uniform"), F.lit("rising"), F.lit("falling"))).alias("kind")
    b = base.select("asset", "Q", "i", kinds)
    w = (
        F.when(F.col("kind") == "uniform", F.col("Q") / n)
        .when(F.col("kind") == "rising", (F.col("i") + 1) / n / half * F.col("Q"))
        .otherwise((1 - F.col("i") / n) / half * F.col("Q"))
    )
    return b.withColumn("v", w)


def execution_path(sched: DataFrame, s0: float = S0, gamma: float = GAMMA) -> DataFrame:
    """Cumulative executed quantity and price path ``S0 + gamma * v_i * (i+1)``.
    A schedule has n (= 50) rows, so the window per schedule is bounded."""
    w = Window.partitionBy("asset", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return sched.select(
        "asset", "kind", "i",
        F.round("v", 6).alias("v"),
        F.round(F.sum("v").over(w), 6).alias("x_cum"),
        F.round(F.lit(s0) + F.lit(gamma) * F.col("v") * (F.col("i") + 1), 9).alias("price"),
    )


GAMMA_GRID = [10 ** (-7 + 2 * k / 19) for k in range(20)]  # logspace(-7, -5, 20)


def schedule_cost(sched: DataFrame, lam: float = LAMBDA, eta: float = ETA, gammas=None) -> DataFrame:
    """cost = sum(lam |v|^1.5 + gamma v) + eta (Q - sum v)^2 for each schedule and
    each gamma of a sensitivity grid; saving % of each schedule vs the best one of its
    (asset, gamma). The grid is a literal array exploded per schedule (no join)."""
    gammas = GAMMA_GRID if gammas is None else gammas
    g = sched.groupBy("asset", "kind", "Q").agg(
        F.sum(F.lit(lam) * F.pow(F.abs("v"), 1.5)).alias("temp"), F.sum("v").alias("sv")
    )
    g = g.select("*", F.explode(F.array(*[F.lit(x) for x in gammas])).alias("gamma"))
    cost = F.col("temp") + F.col("gamma") * F.col("sv") + F.lit(eta) * F.pow(F.col("Q") - F.col("sv"), 2)
    g = g.withColumn("cost", cost)
    best = Window.partitionBy("asset", "gamma")
    g = g.withColumn("best", F.min("cost").over(best))
    return g.select(
        "asset", "kind", F.round("gamma", 15).alias("gamma"), F.round("cost", 6).alias("cost"),
        F.round((F.col("cost") - F.col("best")) / F.col("cost") * 100, 6).alias("saving_pct"),
    )


"""Forecast allocation and forecast reports (A5 with J1, A15, A16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendgrid.functions.measures import Period, weighted


def allocate_forecast(
    facts: DataFrame,
    forecast: DataFrame,
    gcols: list[str],
    period: Period = Period(1, 30),
    smr: int = 30,
    account: str = "account_id",
) -> DataFrame:
    """A5: account forecast spread over the result groups without fan-out.

    1. forecast weighted like the plan and summed per account **before** any join (J1);
    2. per (account, group): weighted current-year actual ``r``;
    3. a group's share of its account = ``|r| / sum|r|`` over the account, or ``1/n``
       when the account has no actual (single-group accounts get 1, i.e. kept whole);
    4. ``forecast_alloc`` per group = sum of account forecast x share; accounts with no
       group are dropped; groups with no forecast are filled with 0.0 by the caller.

    Returns ``(gcols..., forecast_alloc DOUBLE)``. Shuffles: one aggregate per side and
    a window partitioned by account over the already aggregated (account, group) rows.
    """
    fc = forecast.withColumn("real_py", F.lit(0)).withColumn("new_plan", F.lit(0)).withColumn("real", F.lit(0))
    fc = weighted(fc.withColumnRenamed("forecast", "plan"), period, smr)
    fc_acct = fc.groupBy(account).agg(F.sum("w_plan").alias("fc"))
    w = weighted(facts.select(account, *gcols, "sem", "real_py", "plan", "new_plan", "real"), period, smr)
    per_group = w.groupBy(account, *gcols).agg(F.sum("w_real").alias("r"))
    by_acct = Window.partitionBy(account)
    per_group = per_group.withColumns(
        {
            "tot": F.sum(F.abs("r")).over(by_acct),
            "n": F.count(F.lit(1)).over(by_acct),
        }
    )
    share = F.when(F.col("tot") > 0, F.abs("r").cast("double") / F.col("tot").cast("double")).otherwise(
        F.lit(1.0) / F.col("n")
    )
    div = period.divisor
    fc_d = F.col("fc").cast("double") if div == 1 else F.col("fc").cast("double") / div
    j = per_group.join(fc_acct, account, "inner").withColumn("alloc", fc_d * share)
    return j.groupBy(*gcols).agg(F.sum("alloc").alias("forecast_alloc"))


def forecast_range(fc: DataFrame, si: int, sf: int, smr: int = 30, individual: bool = False) -> DataFrame:
    """Actual (capped at SMR) and forecast by (group, account) over weeks lo..sf.

    ``fc(grupo, cuenta, sem, real, forecast)``; % is null when the forecast is 0.
    """
    lo = sf if individual else si
    real_hi = min(sf, smr)
    f = fc.filter((F.col("sem") >= lo) & (F.col("sem") <= sf))
    g = f.groupBy("grupo", "cuenta").agg(
        F.sum(F.when(F.col("sem") <= real_hi, F.col("real")).otherwise(F.lit(0).cast(fc.schema["real"].dataType))).alias("r"),
        F.sum("forecast").alias("f"),
    )
    vs = F.col("r") - F.col("f")
    return g.select(
        "grupo",
        "cuenta",
        F.round("r", 2).cast("double").alias("real"),
        F.round("f", 2).cast("double").alias("forecast"),
        F.round(vs, 2).cast("double").alias("vs_forecast_abs"),
        F.when(F.col("f") != 0, F.round(vs.cast("double") / F.abs(F.col("f").cast("double")) * 100, 4)).alias(
            "vs_forecast_pct"
        ),
    )


def forecast_weekly(fc: DataFrame, smr: int = 30) -> DataFrame:
    """Weekly actual vs forecast; actual is null after SMR."""
    g = fc.groupBy("sem").agg(F.sum("real").alias("r"), F.sum("forecast").alias("f"))
    return g.select(
        "sem",
        F.when(F.col("sem") <= smr, F.round("r", 2).cast("double")).alias("real"),
        F.round("f", 2).cast("double").alias("forecast"),
    ).orderBy("sem")

"""Weekly measures, period weights and the variance block.

A fact row carries four money measures for one week ``sem``:

* ``real_py``  - prior-year actual
* ``plan``     - current-year plan
* ``new_plan`` - current-year revised plan
* ``real``     - current-year actual (only up to the last closed week, SMR)

Money is summed as DECIMAL (exact, order independent) and only turned into DOUBLE for
ratios and for output, rounded to 2 dp. Ratios follow the pinned rules: percentages
divide by ``abs(den)`` and give 0.0 on a zero denominator; compliance divides by the
signed plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendgrid.functions.calendar import month_days_by_week
from spendgrid.session import stored

MEASURES = ("real_py", "plan", "new_plan", "real")
MONEY_TYPE = "decimal(18,5)"

# Label texts of the variance block (kept as in the source system).
LABEL_SAVING = "Ahorro"
LABEL_EXTRA = "Gasto extra"
LABEL_UNDER_PLAN = "Bajo plan"
LABEL_OVER_PLAN = "Sobre plan"


@dataclass(frozen=True)
class Period:
    """A period choice.

    mode ``range``: weeks lo..hi; ``individual``: the single week ``hi``; ``set``: the
    weeks in ``weeks`` that are <= hi (lo ignored); ``months``: own-year day fractions of
    the chosen ``months`` (lo/hi ignored), each measure in its own year's calendar.
    """

    lo: int = 1
    hi: int = 53
    mode: str = "range"
    weeks: tuple = field(default_factory=tuple)
    months: tuple = field(default_factory=tuple)
    prior_year: int = 1997
    current_year: int = 1998

    @property
    def divisor(self) -> int:
        return 7 if self.mode == "months" else 1

    def first(self) -> int:
        return self.hi if self.mode == "individual" else self.lo


def _in_weeks(period: Period, hi: int) -> Column:
    sem = F.col("sem")
    if period.mode == "set":
        return sem.isin([int(w) for w in period.weeks]) & (sem <= hi)
    return (sem >= period.first()) & (sem <= hi)


def weighted(facts: DataFrame, period: Period, smr: int) -> DataFrame:
    """P2 + P4: add decimal columns ``w_real_py, w_plan, w_new_plan, w_real, w_plan_rest``.

    For ``months`` mode the weights are own-year day counts (divide sums by 7 later);
    the two 53-row day tables are broadcast (fixed size), not a 53-branch CASE.
    """
    zero = F.lit(0).cast(MONEY_TYPE)
    sem = F.col("sem")
    plan_rest = F.when(sem > smr, F.col("plan")).otherwise(zero)
    if period.mode != "months":
        both = _in_weeks(period, period.hi)
        real_ok = _in_weeks(period, min(period.hi, smr))
        return facts.withColumns(
            {
                "w_real_py": F.when(both, F.col("real_py")).otherwise(zero),
                "w_plan": F.when(both, F.col("plan")).otherwise(zero),
                "w_new_plan": F.when(both, F.col("new_plan")).otherwise(zero),
                "w_real": F.when(real_ok, F.col("real")).otherwise(zero),
                "w_plan_rest": plan_rest,
            }
        )
    spark = facts.sparkSession
    d_py = month_days_by_week(spark, period.prior_year, period.months).withColumnRenamed("days", "d_py")
    d_cur = month_days_by_week(spark, period.current_year, period.months).withColumnRenamed("days", "d_cur")
    days = d_py.join(d_cur, "sem", "full")
    f = facts.join(F.broadcast(days), "sem", "left").fillna(0, ["d_py", "d_cur"])
    # plan_rest is a week total, bring it to the same x7 scale as the month weights
    return f.withColumns(
        {
            "w_real_py": F.col("real_py") * F.col("d_py"),
            "w_plan": F.col("plan") * F.col("d_cur"),
            "w_new_plan": F.col("new_plan") * F.col("d_cur"),
            "w_real": F.when(sem <= smr, F.col("real") * F.col("d_cur")).otherwise(zero),
            "w_plan_rest": plan_rest * 7,
        }
    ).drop("d_py", "d_cur")


def sum_weighted() -> list[Column]:
    """Aggregate expressions over :func:`weighted` columns (decimal sums)."""
    return [
        F.sum("w_real_py").alias("s_real_py"),
        F.sum("w_plan").alias("s_plan"),
        F.sum("w_new_plan").alias("s_new_plan"),
        F.sum("w_real").alias("s_real"),
        F.sum("w_plan_rest").alias("s_plan_rest"),
    ]


def money(dec: Column, divisor: int = 1) -> Column:
    """Output money: exact decimal rounding to 2 dp (or /7 then round for months)."""
    if divisor == 1:
        return F.round(dec, 2).cast("double")
    return F.round(dec.cast("double") / divisor, 2)


def as_double(dec: Column, divisor: int = 1) -> Column:
    d = dec.cast("double")
    return d if divisor == 1 else d / divisor


def pct_abs(num: Column, den: Column) -> Column:
    """(num / abs(den)) * 100, 0.0 when den is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / F.abs(den) * 100)


def pct_signed(num: Column, den: Column) -> Column:
    """(num / den) * 100, 0.0 when den is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den * 100)


def variance_columns(
    g: DataFrame,
    keys: list[str],
    divisor: int = 1,
    forecast: str | None = None,
    shares: bool = True,
    extra_keys: list[str] | None = None,
    total_rows: Column | None = None,
) -> DataFrame:
    """P5: the measure block per row from decimal sums ``s_*``.

    Shares divide by the total over *all* rows of ``g`` (or those where ``total_rows`` holds):
    one row, attached to every row by a broadcast. The grouped sums are stored first, so both
    the rows and their total read them back and the facts are scanned exactly once; there is no
    global window and no shuffle of the rows into one task.
    ``forecast`` names a column holding an allocated forecast (A5); without it the
    forecast is ``real + plan_rest``.
    """
    d = {m: as_double(F.col(f"s_{m}"), divisor) for m in MEASURES}
    cols: list[Column] = [F.col(k) for k in keys + (extra_keys or [])]
    if shares:
        g = stored(g, "grouped-sums")
        src = g if total_rows is None else g.filter(total_rows)
        tot = src.agg(*[F.sum(f"s_{m}").alias(f"_t_{m}") for m in MEASURES])  # one row
        g = g.crossJoin(F.broadcast(tot))
        totals = {m: as_double(F.col(f"_t_{m}"), divisor) for m in MEASURES}
    vs_py = F.col("s_real") - F.col("s_real_py")
    vs_plan = F.col("s_real") - F.col("s_plan")
    vs_new = F.col("s_real") - F.col("s_new_plan")
    if forecast is None:
        fc_dec = F.col("s_real") + F.col("s_plan_rest")
        fc_d = as_double(fc_dec, divisor)
        fc_out = money(fc_dec, divisor)
        vs_fc_dec = -F.col("s_plan_rest")
        vs_fc_d = as_double(vs_fc_dec, divisor)
        vs_fc_out = money(vs_fc_dec, divisor)
    else:
        fc_d = F.col(forecast)
        fc_out = F.round(fc_d, 2)
        vs_fc_d = d["real"] - fc_d
        vs_fc_out = F.round(vs_fc_d, 2)
    for m in MEASURES:
        cols.append(money(F.col(f"s_{m}"), divisor).alias(m))
        if shares:
            cols.append(F.round(pct_signed(d[m], totals[m]), 4).alias(f"pct_{m}"))
    cols += [
        money(F.col("s_plan_rest"), divisor).alias("plan_rest"),
        F.round(pct_signed(d["real"], d["plan"]), 4).alias("compliance"),
        money(vs_py, divisor).alias("vs_py_abs"),
        F.round(pct_abs(as_double(vs_py, divisor), d["real_py"]), 4).alias("vs_py_pct"),
        F.when(vs_py <= 0, F.lit(LABEL_SAVING)).otherwise(F.lit(LABEL_EXTRA)).alias("label_py"),
        money(vs_plan, divisor).alias("vs_plan_abs"),
        F.round(pct_abs(as_double(vs_plan, divisor), d["plan"]), 4).alias("vs_plan_pct"),
        F.when(vs_plan <= 0, F.lit(LABEL_UNDER_PLAN)).otherwise(F.lit(LABEL_OVER_PLAN)).alias("label_plan"),
        money(vs_new, divisor).alias("vs_new_plan_abs"),
        F.round(pct_abs(as_double(vs_new, divisor), d["new_plan"]), 4).alias("vs_new_plan_pct"),
        fc_out.alias("forecast"),
        F.round(pct_signed(fc_d, d["plan"]), 4).alias("forecast_compliance"),
        vs_fc_out.alias("vs_forecast_abs"),
        F.round(pct_abs(vs_fc_d, fc_d), 4).alias("vs_forecast_pct"),
        # kept for P6 (materiality is decided on the unrounded sums)
        (F.abs("s_real_py") + F.abs("s_plan") + F.abs("s_new_plan") + F.abs("s_real")).alias("_mass"),
    ]
    return g.select(*cols)


def drop_immaterial(df: DataFrame, eps: float = 0.5, divisor: int = 1) -> DataFrame:
    """Keep rows whose sum of abs(measures) exceeds ``eps`` (after shares)."""
    if divisor == 1:
        cond = F.col("_mass") > F.lit(eps)
    else:
        cond = F.col("_mass").cast("double") / divisor > F.lit(eps)
    return df.filter(cond).drop("_mass")


def flag_rows(df: DataFrame) -> DataFrame:
    """Live / has-plan / over-plan flags."""
    return df.withColumns(
        {
            "is_live": (F.col("plan") != 0) | (F.col("real") != 0),
            "has_plan": F.col("plan") != 0,
            "over_plan": F.col("vs_plan_abs") > 0,
        }
    )


def format_money(c: Column, dp: int = 1) -> Column:
    """Millions with ``dp`` decimals; positive spend in parentheses; null -> em dash."""
    m = F.format_number(F.abs(c) / 1e6, dp)
    return (
        F.when(c.isNull(), F.lit("—"))
        .when(c > 0, F.concat(F.lit("("), m, F.lit(")")))
        .when(c < 0, F.concat(F.lit("-"), m))
        .otherwise(m)
    )


def any_of(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, preds) if preds else F.lit(False)

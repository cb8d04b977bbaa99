"""Variance roll-ups over the weekly fact.

Every operator is one DataFrame plan: filter (pushed to the scan) -> weighted decimal
columns -> partial/final hash aggregate on the group keys -> per-row ratio block.
Shares divide by a one-row total of the stored sums, never by a global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendgrid.functions.dims import DIMS, group_columns
from spendgrid.functions.measures import (
    MEASURES,
    Period,
    drop_immaterial,
    money,
    pct_abs,
    sum_weighted,
    variance_columns,
    weighted,
)
from spendgrid.operators.filters import apply_filters
from spendgrid.session import stored

# Display order of divisions (anything else sorts after, by name).
DIVISION_ORDER = [
    "Division Norte",
    "Division Centro",
    "Division Sur",
    "Concentrador",
    "Cerrados y Cancelados",
    "Corporativo",
    "Expansión",
    "Fuerza Proactiva",
    "Otros",
]

# Quarter week ranges of the 53-week fiscal year (Q4 takes week 53).
QUARTERS = {"Q1": (1, 13), "Q2": (14, 26), "Q3": (27, 39), "Q4": (40, 53), "FY": (1, 53)}


def _aggregate(facts: DataFrame, gcols: list[str], period: Period, smr: int) -> DataFrame:
    w = weighted(facts.select(*gcols, "sem", *MEASURES), period, smr)
    if gcols:
        return w.groupBy(*gcols).agg(*sum_weighted())
    return w.agg(*sum_weighted())


def rollup_variance(
    facts: DataFrame,
    dim: str = "division",
    period: Period = Period(1, 30),
    filters=(),
    exclude_parents=(),
    smr: int = 30,
    forecast: DataFrame | None = None,
    group_order: DataFrame | None = None,
) -> DataFrame:
    """A1: filter -> weights -> sums by parents+child -> variance block -> P6 -> O1.

    ``dim='global'`` gives one row and no materiality drop. ``forecast`` is an optional
    ``(keys..., forecast)`` frame from :func:`spendgrid.operators.forecast.allocate_forecast`.
    """
    facts = apply_filters(facts, filters)
    gcols = group_columns(dim, facts.columns, exclude_parents)
    g = _aggregate(facts, gcols, period, smr)
    fc_col = None
    if forecast is not None:
        g = g.join(forecast, gcols, "left").fillna(0.0, ["forecast_alloc"])
        fc_col = "forecast_alloc"
    out = variance_columns(g, gcols, period.divisor, forecast=fc_col)
    if not gcols:
        return out.drop("_mass")
    out = drop_immaterial(out, divisor=period.divisor)
    return order_result(out, gcols, group_order)


def rollup_by(facts: DataFrame, cols: list[str], period: Period = Period(1, 30), filters=(), smr: int = 30) -> DataFrame:
    """A2: the same roll-up over explicit columns that may cross hierarchies."""
    facts = apply_filters(facts, filters)
    g = _aggregate(facts, list(cols), period, smr)
    out = drop_immaterial(variance_columns(g, list(cols), period.divisor), divisor=period.divisor)
    return order_result(out, list(cols))


def rollup_tree(facts: DataFrame, hier: list[str], period: Period = Period(1, 30), filters=(), smr: int = 30) -> DataFrame:
    """A3: one roll-up per prefix of ``hier``, each summed from the next finer one.

    The facts are summed once, to the deepest level, which is stored; every level above adds up the
    rows of the level below it, so no fact is copied per level.
    ``level`` = number of grouped columns (0 is the total row). Shares divide by the
    grand total; P6 applies to every level except the total, whose shares are 100.
    Deeper levels keep their full parent path in the key columns.
    """
    facts = apply_filters(facts, filters)
    w = weighted(facts.select(*hier, "sem", *MEASURES), period, smr)
    deepest = stored(w.groupBy(*hier).agg(*sum_weighted()), "tree-deepest")
    sums = [f for f in deepest.schema.fields if f.name not in hier]
    below, g = deepest, deepest.withColumn("level", F.lit(len(hier)))
    for depth in range(len(hier) - 1, -1, -1):
        keys = [F.col(c) for c in hier[:depth]] or [F.lit(0).alias("all")]
        below = below.groupBy(*keys).agg(*[F.sum(f.name).cast(f.dataType).alias(f.name) for f in sums])
        gone = {c: F.lit(None).cast(deepest.schema[c].dataType) for c in hier[depth:]}
        g = g.unionByName(below.withColumns(gone | {"level": F.lit(depth)}).select(*g.columns))
    out = variance_columns(g, list(hier), period.divisor, extra_keys=["level"], total_rows=F.col("level") == 0)
    out = out.withColumns(
        {f"pct_{m}": F.when(F.col("level") == 0, F.lit(100.0)).otherwise(F.col(f"pct_{m}")) for m in MEASURES}
    )
    div = period.divisor
    mass = F.col("_mass") if div == 1 else F.col("_mass").cast("double") / div
    return out.filter((F.col("level") == 0) | (mass > 0.5)).drop("_mass")


def drill(facts: DataFrame, cols: list[str], parents: tuple, period: Period = Period(1, 30), filters=(), smr: int = 30) -> DataFrame:
    """A4: restrict to the given parent values and group by the next column only."""
    facts = apply_filters(facts, filters)
    for c, v in zip(cols, parents):
        if c in facts.columns:
            facts = facts.filter(F.col(c) == F.lit(v))
    nxt = cols[len(parents)]
    g = _aggregate(facts, [nxt], period, smr)
    out = drop_immaterial(variance_columns(g, [nxt], period.divisor), divisor=period.divisor)
    return order_result(out, [nxt])


def with_total(df: DataFrame, label_col: str, label: str = "TOTAL") -> DataFrame:
    """Append a total row (sums of measures; variances recomputed; shares 100)."""
    sums = df.agg(*[F.sum(m).alias(m) for m in ("real_py", "plan", "new_plan", "real", "forecast")])
    r25, p26, nvo, r26, fc = (F.col(c) for c in ("real_py", "plan", "new_plan", "real", "forecast"))
    tot = sums.select(
        F.lit(label).alias(label_col),
        F.round(r25, 2).alias("real_py"),
        F.round(p26, 2).alias("plan"),
        F.round(nvo, 2).alias("new_plan"),
        F.round(r26, 2).alias("real"),
        F.round(fc, 2).alias("forecast"),
        F.round(r26 - r25, 2).alias("vs_py_abs"),
        F.round(pct_abs(r26 - r25, r25), 4).alias("vs_py_pct"),
        F.round(r26 - p26, 2).alias("vs_plan_abs"),
        F.round(pct_abs(r26 - p26, p26), 4).alias("vs_plan_pct"),
        F.round(r26 - nvo, 2).alias("vs_new_plan_abs"),
        F.round(pct_abs(r26 - nvo, nvo), 4).alias("vs_new_plan_pct"),
        F.round(r26 - fc, 2).alias("vs_forecast_abs"),
        F.round(pct_abs(r26 - fc, fc), 4).alias("vs_forecast_pct"),
        F.round(F.when(p26 == 0, 0.0).otherwise(r26 / p26 * 100), 4).alias("compliance"),
        *[F.lit(100.0).alias(f"pct_{m}") for m in MEASURES],
    )
    body = df.select(*tot.columns).withColumn(label_col, F.col(label_col).cast("string"))
    return body.unionByName(tot)


def weekly(facts: DataFrame, filters=(), smr: int = 30) -> DataFrame:
    """Weekly sums; current-year actual is null after the last closed week."""
    facts = apply_filters(facts, filters)
    g = facts.groupBy("sem").agg(*[F.sum(m).alias(m) for m in MEASURES])
    return g.select(
        "sem",
        *[
            (F.when(F.col("sem") > smr, F.lit(None)).otherwise(money(F.col(m))) if m == "real" else money(F.col(m))).alias(m)
            for m in MEASURES
        ],
    ).orderBy("sem")


def monthly(weekly_df: DataFrame, prior_year: int = 1997, current_year: int = 1998) -> DataFrame:
    """Weekly -> monthly by own-year day proration (each measure in its own year).

    A month that receives no non-null week stays null (SQL ``sum`` of all nulls).
    """
    from spendgrid.functions.calendar import week_calendar

    spark = weekly_df.sparkSession
    cal = (
        week_calendar(spark, prior_year).select("sem", "month", F.col("days").alias("d_py"))
        .join(week_calendar(spark, current_year).select("sem", "month", F.col("days").alias("d_cur")), ["sem", "month"], "full")
    )
    j = weekly_df.join(F.broadcast(cal), "sem", "inner")
    aggs = []
    for m in MEASURES:
        d = F.col("d_py") if m == "real_py" else F.col("d_cur")
        aggs.append(F.round(F.sum(F.col(m) * d) / 7, 2).alias(m))
    return j.groupBy("month").agg(*aggs).orderBy("month")


def quarter_matrix(facts: DataFrame, cols: list[str], periods=("Q1", "FY"), smr: int = 30) -> DataFrame:
    """The A2 roll-up on fixed quarter ranges, periods side by side, in one pass over the
    facts: every period's weighted measures are columns of the same aggregate."""
    shown = ("real_py", "plan", "real", "vs_plan_abs", "vs_plan_pct", "vs_py_abs", "vs_py_pct")
    w = facts.select(*cols, "sem", *MEASURES)
    parts = (*MEASURES, "plan_rest")
    for q in periods:
        lo, hi = QUARTERS[q]
        w = weighted(w, Period(lo, hi), smr).withColumnsRenamed({f"w_{m}": f"{q}_{m}" for m in parts})
    g = w.groupBy(*cols).agg(*[F.sum(f"{q}_{m}").alias(f"{q}_{m}") for q in periods for m in parts])
    done: list[str] = []
    for q in periods:
        g = g.withColumnsRenamed({f"{q}_{m}": f"s_{m}" for m in parts})
        rest = [c for c in g.columns if c not in cols and not c.startswith("s_")]
        g = variance_columns(g, list(cols), shares=False, extra_keys=rest)
        new = {c: f"{q.lower()}_{c}" for c in shown}
        g = g.select(*cols, *rest, *[F.col(c).alias(n) for c, n in new.items()])
        done += new.values()
    return g.select(*cols, *done)


def quarterly(weekly_df: DataFrame, smr: int = 30) -> DataFrame:
    """A10: week -> quarter sums; year-end forecast (actual to SMR + plan after) on each row.

    An all-null quarter sums to 0.0. Percentages are recomputed from the sums.
    """
    q = F.when(F.col("sem") <= 13, "Q1").when(F.col("sem") <= 26, "Q2").when(F.col("sem") <= 39, "Q3").otherwise("Q4")
    ye = weekly_df.select(
        (F.coalesce(F.sum(F.when(F.col("sem") <= smr, F.col("real"))), F.lit(0.0))
         + F.coalesce(F.sum(F.when(F.col("sem") > smr, F.col("plan"))), F.lit(0.0))).alias("ye")
    ).scalar()
    g = weekly_df.groupBy(q.alias("quarter")).agg(
        *[F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in MEASURES]
    )
    r25, p26, r26 = F.col("real_py"), F.col("plan"), F.col("real")
    return g.select(
        "quarter",
        *[F.round(F.col(m), 2).alias(m) for m in MEASURES],
        F.round(r26 - r25, 2).alias("vs_py_abs"),
        F.round(pct_abs(r26 - r25, r25), 4).alias("vs_py_pct"),
        F.round(r26 - p26, 2).alias("vs_plan_abs"),
        F.round(pct_abs(r26 - p26, p26), 4).alias("vs_plan_pct"),
        F.round(ye, 2).alias("forecast_ye"),
    ).orderBy("quarter")


def closures_range(facts: DataFrame, keys: list[str], period: Period = Period(1, 30), smr: int = 30) -> DataFrame:
    """The weighted sums by the closure keys, without the ratio block."""
    g = _aggregate(facts, list(keys), period, smr)
    d = period.divisor
    return g.select(*keys, *[money(F.col(f"s_{m}"), d).alias(m) for m in MEASURES], money(F.col("s_plan_rest"), d).alias("plan_rest"))


def ytd(facts: DataFrame, cols: list[str], smr: int = 30) -> DataFrame:
    """Year-to-date (weeks <= SMR) sums by ``cols``, sorted by actual desc."""
    g = facts.filter(F.col("sem") <= smr).groupBy(*cols).agg(*[F.sum(m).alias(m) for m in MEASURES])
    return g.select(*cols, *[money(F.col(m)).alias(m) for m in MEASURES]).orderBy(F.col("real").desc(), *cols)


def running_totals(series: DataFrame, order_col: str, cols=("real", "plan"), partition: list[str] | None = None) -> DataFrame:
    """Running sums along ``order_col``; a null row stays null (skipped in the sum).

    The window is partitioned by ``partition`` when given; the usual input (a weekly,
    monthly or quarterly series) is already aggregated to <= 53 rows per partition.
    """
    w = Window.orderBy(order_col) if not partition else Window.partitionBy(*partition).orderBy(order_col)
    w = w.rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumns(
        {f"cum_{c}": F.when(F.col(c).isNotNull(), F.round(F.sum(c).over(w), 2)) for c in cols}
    )


def order_result(df: DataFrame, keys: list[str], group_order: DataFrame | None = None) -> DataFrame:
    """O1: result order, emitted as a ``sort_key`` column plus a distributed sort.

    * keys == [account group]: catalog order number (missing 999), then name;
    * first key is the division: the fixed division list (missing 999), then name;
    * otherwise: abs(actual) descending.
    """
    grp = DIMS["grupo_cuentas"]
    if keys == [grp] and group_order is not None:
        j = df.join(group_order.select(F.col("group").alias(grp), "ord"), grp, "left")
        j = j.withColumn("sort_key", F.coalesce(F.col("ord"), F.lit(999)).cast("double")).drop("ord")
        return j.orderBy("sort_key", grp)
    if keys and keys[0] == DIMS["division"]:
        m = F.create_map(*[x for i, name in enumerate(DIVISION_ORDER) for x in (F.lit(name), F.lit(i))])
        j = df.withColumn("sort_key", F.coalesce(m[F.col(keys[0])], F.lit(999)).cast("double"))
        return j.orderBy("sort_key", keys[0])
    j = df.withColumn("sort_key", -F.abs(F.col("real")))
    return j.orderBy("sort_key", *keys)



"""Registered variance queries over V1 (A1-A4, A6-A10, A20, A21, W2, O1-O3) and twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendgrid.functions.measures import Period
from spendgrid.operators import rollup as R
from spendgrid.plans import bindings as B
from spendgrid.plans.sqlparts import FACTS_CTE, calendar_sql, mass, money, totals, variance_select, weighted_sums
from spendgrid.plans.registry import register

# --- A1: flagship roll-up by division, weeks 1-30 -------------------------------------
A1_SQL = f"""WITH {FACTS_CTE},
g AS (SELECT agrupa1, division,
    {weighted_sums(1, 30)}
  FROM facts GROUP BY agrupa1, division),
t AS ({totals()})
SELECT agrupa1, division,
  {variance_select()},
  -abs({'CAST(ROUND(s_real, 2) AS DOUBLE)'}) AS sort_key
FROM g CROSS JOIN t
WHERE {mass()}"""


@register("a01_rollup_variance", A1_SQL)
def a01(spark, sf_dir):
    return R.rollup_variance(B.facts(spark, sf_dir), "division", Period(1, 30), smr=B.SMR)


# --- A2: roll-up over columns that cross hierarchies (brand x nation) --------------------
@register(
    "a02_rollup_by",
    f"""WITH {FACTS_CTE},
g AS (SELECT grupo, division, {weighted_sums(1, 30)} FROM facts GROUP BY grupo, division),
t AS ({totals()})
SELECT grupo, division, {variance_select()}, -abs(CAST(ROUND(s_real, 2) AS DOUBLE)) AS sort_key
FROM g CROSS JOIN t WHERE {mass()}""",
)
def a02(spark, sf_dir):
    return R.rollup_by(B.facts(spark, sf_dir), ["grupo", "division"], Period(1, 30), smr=B.SMR)


# --- A3: the six-level territorial hierarchy as one ROLLUP --------------------------------
_HIER = ["agrupa1", "division", "territorio", "zona", "region", "pdc"]


@register(
    "a03_rollup_tree",
    f"""WITH {FACTS_CTE},
g AS (SELECT {', '.join(_HIER)}, {weighted_sums(1, 30)},
        CAST(6 - ({' + '.join(f'GROUPING({c})' for c in _HIER)}) AS INTEGER) AS level
      FROM facts GROUP BY ROLLUP ({', '.join(_HIER)})),
t AS ({totals()} WHERE level = 0)
SELECT {', '.join(_HIER)}, level, {variance_select(pct_level0=True)}
FROM g CROSS JOIN t WHERE level = 0 OR {mass()}""",
)
def a03(spark, sf_dir):
    return R.rollup_tree(B.facts(spark, sf_dir), _HIER, Period(1, 30), smr=B.SMR)


# --- A4: drill one level under a parent ---------------------------------------------------
@register(
    "a04_drill",
    f"""WITH {FACTS_CTE},
g AS (SELECT division, {weighted_sums(1, 30)} FROM facts WHERE agrupa1 = 'EUROPE' GROUP BY division),
t AS ({totals()})
SELECT division, {variance_select()}, CAST(999 AS DOUBLE) AS sort_key
FROM g CROSS JOIN t WHERE {mass()}""",
)
def a04(spark, sf_dir):
    return R.drill(B.facts(spark, sf_dir), ["agrupa1", "division"], ("EUROPE",), Period(1, 30), smr=B.SMR)


# --- A6: table with a TOTAL row ------------------------------------------------------------
_A6_COLS = (
    "real_py, plan, new_plan, real, forecast, vs_py_abs, vs_py_pct, vs_plan_abs, vs_plan_pct, "
    "vs_new_plan_abs, vs_new_plan_pct, vs_forecast_abs, vs_forecast_pct, compliance, "
    "pct_real_py, pct_plan, pct_new_plan, pct_real"
)


@register(
    "a06_with_total",
    f"""WITH {FACTS_CTE},
g AS (SELECT division, {weighted_sums(1, 30)} FROM facts GROUP BY division),
t AS ({totals()}),
v AS (SELECT division, {variance_select()} FROM g CROSS JOIN t WHERE {mass()}),
s AS (SELECT SUM(real_py) AS a, SUM(plan) AS p, SUM(new_plan) AS n, SUM(real) AS r, SUM(forecast) AS f FROM v)
SELECT CAST(division AS VARCHAR) AS division, {_A6_COLS} FROM v
UNION ALL
SELECT 'TOTAL', ROUND(a, 2), ROUND(p, 2), ROUND(n, 2), ROUND(r, 2), ROUND(f, 2),
  ROUND(r - a, 2), ROUND(CASE WHEN a = 0 THEN 0.0 ELSE (r - a) / abs(a) * 100 END, 4),
  ROUND(r - p, 2), ROUND(CASE WHEN p = 0 THEN 0.0 ELSE (r - p) / abs(p) * 100 END, 4),
  ROUND(r - n, 2), ROUND(CASE WHEN n = 0 THEN 0.0 ELSE (r - n) / abs(n) * 100 END, 4),
  ROUND(r - f, 2), ROUND(CASE WHEN f = 0 THEN 0.0 ELSE (r - f) / abs(f) * 100 END, 4),
  ROUND(CASE WHEN p = 0 THEN 0.0 ELSE r / p * 100 END, 4), 100.0, 100.0, 100.0, 100.0
FROM s""",
)
def a06(spark, sf_dir):
    base = R.rollup_variance(B.facts(spark, sf_dir), "division", Period(1, 30), exclude_parents=("agrupa1",), smr=B.SMR)
    return R.with_total(base, "division")


# --- A7: weekly series ---------------------------------------------------------------------
_WEEKLY_SQL = f"""{FACTS_CTE},
wk AS (SELECT sem, CAST(ROUND(SUM(real_py), 2) AS DOUBLE) AS real_py, CAST(ROUND(SUM(plan), 2) AS DOUBLE) AS plan,
         CAST(ROUND(SUM(new_plan), 2) AS DOUBLE) AS new_plan,
         CASE WHEN sem > 30 THEN NULL ELSE CAST(ROUND(SUM(real), 2) AS DOUBLE) END AS real
       FROM facts GROUP BY sem)"""


@register("a07_weekly", f"WITH {_WEEKLY_SQL} SELECT * FROM wk")
def a07(spark, sf_dir):
    return R.weekly(B.facts(spark, sf_dir), smr=B.SMR)


# --- A8: weekly -> monthly by day proration --------------------------------------------------
@register(
    "a08_monthly",
    f"""WITH {_WEEKLY_SQL},
cal AS (SELECT coalesce(a.sem, b.sem) AS sem, coalesce(a.month, b.month) AS month, a.days AS d_py, b.days AS d_cur
        FROM {calendar_sql(1997)} a FULL JOIN {calendar_sql(1998)} b ON a.sem = b.sem AND a.month = b.month)
SELECT cal.month,
  ROUND(SUM(real_py * d_py) / 7, 2) AS real_py, ROUND(SUM(plan * d_cur) / 7, 2) AS plan,
  ROUND(SUM(new_plan * d_cur) / 7, 2) AS new_plan, ROUND(SUM(real * d_cur) / 7, 2) AS real
FROM wk JOIN cal ON wk.sem = cal.sem GROUP BY cal.month""",
)
def a08(spark, sf_dir):
    return R.monthly(R.weekly(B.facts(spark, sf_dir), smr=B.SMR))


# --- A9: quarter matrix, Q1 and FY side by side ----------------------------------------------
def _qcols(q):
    return ", ".join(
        f"{c} AS {q}_{c}" for c in ("real_py", "plan", "real", "vs_plan_abs", "vs_plan_pct", "vs_py_abs", "vs_py_pct")
    )


@register(
    "a09_quarter_matrix",
    f"""WITH {FACTS_CTE},
g1 AS (SELECT division, {weighted_sums(1, 13)} FROM facts GROUP BY division),
g2 AS (SELECT division, {weighted_sums(1, 53)} FROM facts GROUP BY division),
v1 AS (SELECT division, {_qcols('q1')} FROM (SELECT division, {variance_select(shares=False)} FROM g1)),
v2 AS (SELECT division, {_qcols('fy')} FROM (SELECT division, {variance_select(shares=False)} FROM g2))
SELECT coalesce(v1.division, v2.division) AS division, v1.* EXCLUDE (division), v2.* EXCLUDE (division)
FROM v1 FULL JOIN v2 ON v1.division = v2.division""",
)
def a09(spark, sf_dir):
    return R.quarter_matrix(B.facts(spark, sf_dir), ["division"], ("Q1", "FY"), smr=B.SMR)


# --- A10: quarterly table with year-end forecast ----------------------------------------------
@register(
    "a10_quarterly",
    f"""WITH {_WEEKLY_SQL},
ye AS (SELECT coalesce(SUM(CASE WHEN sem <= 30 THEN real END), 0.0)
            + coalesce(SUM(CASE WHEN sem > 30 THEN plan END), 0.0) AS ye FROM wk),
q AS (SELECT CASE WHEN sem <= 13 THEN 'Q1' WHEN sem <= 26 THEN 'Q2' WHEN sem <= 39 THEN 'Q3' ELSE 'Q4' END AS quarter,
        coalesce(SUM(real_py), 0.0) AS a, coalesce(SUM(plan), 0.0) AS p, coalesce(SUM(new_plan), 0.0) AS n,
        coalesce(SUM(real), 0.0) AS r FROM wk GROUP BY 1)
SELECT quarter, ROUND(a, 2) AS real_py, ROUND(p, 2) AS plan, ROUND(n, 2) AS new_plan, ROUND(r, 2) AS real,
  ROUND(r - a, 2) AS vs_py_abs, ROUND(CASE WHEN a = 0 THEN 0.0 ELSE (r - a) / abs(a) * 100 END, 4) AS vs_py_pct,
  ROUND(r - p, 2) AS vs_plan_abs, ROUND(CASE WHEN p = 0 THEN 0.0 ELSE (r - p) / abs(p) * 100 END, 4) AS vs_plan_pct,
  ROUND(ye, 2) AS forecast_ye
FROM q CROSS JOIN ye""",
)
def a10(spark, sf_dir):
    return R.quarterly(R.weekly(B.facts(spark, sf_dir), smr=B.SMR), smr=B.SMR)


# --- A20: closures roll-up (no ratio block) ---------------------------------------------------
@register(
    "a20_closures_range",
    f"""WITH {FACTS_CTE},
g AS (SELECT grupo, pdc, division, territorio, {weighted_sums(1, 30)} FROM facts GROUP BY grupo, pdc, division, territorio)
SELECT grupo, pdc, division, territorio, {money('s_real_py')} AS real_py, {money('s_plan')} AS plan,
  {money('s_new_plan')} AS new_plan, {money('s_real')} AS real, {money('s_plan_rest')} AS plan_rest FROM g""",
)
def a20(spark, sf_dir):
    return R.closures_range(B.facts(spark, sf_dir), ["grupo", "pdc", "division", "territorio"], Period(1, 30), smr=B.SMR)


# --- A21: YTD by division ----------------------------------------------------------------------
@register(
    "a21_ytd",
    f"""WITH {FACTS_CTE}
SELECT division, {money('SUM(real_py)')} AS real_py, {money('SUM(plan)')} AS plan,
  {money('SUM(new_plan)')} AS new_plan, {money('SUM(real)')} AS real
FROM facts WHERE sem <= 30 GROUP BY division""",
)
def a21(spark, sf_dir):
    return R.ytd(B.facts(spark, sf_dir), ["division"], smr=B.SMR)


# --- W2: running totals along the week axis -----------------------------------------------------
@register(
    "w02_running_totals",
    f"""WITH {_WEEKLY_SQL}
SELECT *, CASE WHEN real IS NOT NULL THEN ROUND(SUM(real) OVER (ORDER BY sem ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) END AS cum_real,
  CASE WHEN plan IS NOT NULL THEN ROUND(SUM(plan) OVER (ORDER BY sem ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) END AS cum_plan
FROM wk""",
)
def w02(spark, sf_dir):
    return R.running_totals(R.weekly(B.facts(spark, sf_dir), smr=B.SMR), "sem")


# --- O1: result order by a group catalog (brand number), missing -> 999 ---------------------------
@register(
    "o01_order_result",
    f"""WITH {FACTS_CTE},
g AS (SELECT grupo, {weighted_sums(1, 30)} FROM facts GROUP BY grupo),
t AS ({totals()}),
o AS (SELECT DISTINCT p_brand AS grp, CAST(regexp_extract(p_brand, '#([0-9]+)', 1) AS INTEGER) AS ord FROM part)
SELECT grupo, {variance_select()}, CAST(coalesce(o.ord, 999) AS DOUBLE) AS sort_key
FROM g CROSS JOIN t LEFT JOIN o ON g.grupo = o.grp WHERE {mass()}""",
)
def o01(spark, sf_dir):
    order = (
        B.table(spark, sf_dir, "part")
        .select(F.col("p_brand").alias("group"), F.regexp_extract("p_brand", r"#(\d+)", 1).cast("int").alias("ord"))
        .distinct()
    )
    return R.rollup_variance(
        B.facts(spark, sf_dir), "grupo_cuentas", Period(1, 30), exclude_parents=("agrupa1",), smr=B.SMR, group_order=order
    )


# --- O2: top/bottom 25 points by variance vs plan -------------------------------------------------
_PDC_SQL = f"""{FACTS_CTE},
g AS (SELECT agrupa1, division, territorio, pdc, {weighted_sums(1, 30)} FROM facts GROUP BY agrupa1, division, territorio, pdc),
t AS ({totals()}),
v AS (SELECT agrupa1, division, territorio, pdc, {variance_select()} FROM g CROSS JOIN t WHERE {mass()})"""
_O2_KEYS = "agrupa1, division, territorio, pdc"


@register(
    "o02_top_bottom",
    f"""WITH {_PDC_SQL},
live AS (SELECT * FROM v WHERE plan <> 0 OR real <> 0),
tp AS (SELECT 'top' AS side, *, ROW_NUMBER() OVER (ORDER BY vs_plan_abs DESC, {_O2_KEYS}) AS rank FROM live),
bt AS (SELECT 'bottom' AS side, *, ROW_NUMBER() OVER (ORDER BY vs_plan_abs ASC, {_O2_KEYS}) AS rank FROM live)
SELECT side, {_O2_KEYS}, plan, real, vs_plan_abs, vs_plan_pct, CAST(rank AS INTEGER) AS rank FROM tp WHERE rank <= 25
UNION ALL
SELECT side, {_O2_KEYS}, plan, real, vs_plan_abs, vs_plan_pct, CAST(rank AS INTEGER) AS rank FROM bt WHERE rank <= 25""",
)
def o02(spark, sf_dir):
    from spendgrid.operators.points import top_bottom

    v = R.rollup_variance(B.facts(spark, sf_dir), "pdc", Period(1, 30), smr=B.SMR)
    keys = ["agrupa1", "division", "territorio", "pdc"]
    return top_bottom(v.select(*keys, "plan", "real", "vs_plan_abs", "vs_plan_pct"), "vs_plan_abs", keys, 25)


# --- O3: top 10 accounts by absolute variance vs plan -----------------------------------------------
@register(
    "o03_top_abs",
    f"""WITH {FACTS_CTE},
g AS (SELECT agrupa1, grupo, cuenta, {weighted_sums(1, 30)} FROM facts GROUP BY agrupa1, grupo, cuenta),
t AS ({totals()}),
v AS (SELECT agrupa1, grupo, cuenta, {variance_select()} FROM g CROSS JOIN t WHERE {mass()})
SELECT agrupa1, grupo, cuenta, vs_plan_abs, plan, real, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, ROW_NUMBER() OVER (ORDER BY abs(vs_plan_abs) DESC, agrupa1, grupo, cuenta) AS rank FROM v) WHERE rank <= 10""",
)
def o03(spark, sf_dir):
    from spendgrid.operators.points import top_abs

    v = R.rollup_variance(B.facts(spark, sf_dir), "cuentas", Period(1, 30), smr=B.SMR)
    keys = ["agrupa1", "grupo", "cuenta"]
    return top_abs(v.select(*keys, "vs_plan_abs", "plan", "real"), "vs_plan_abs", keys, 10)


# --- A1 with the null group: one global row (no materiality drop, no ordering) -------------------------
@register(
    "a01_rollup_variance_global",
    f"""WITH {FACTS_CTE},
g AS (SELECT {weighted_sums(1, 30)} FROM facts),
t AS ({totals()})
SELECT {variance_select()} FROM g CROSS JOIN t""",
)
def a01g(spark, sf_dir):
    return R.rollup_variance(B.facts(spark, sf_dir), "global", Period(1, 30), smr=B.SMR)

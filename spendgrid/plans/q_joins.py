"""Registered queries: forecast allocation, catalog/snapshot joins, points, calendar and
predicate operators (A5, A15-A18, J2-J4, J6, J10, S7, F1-F4, P1-P14, O6, U2) and twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendgrid.functions import calendar as C
from spendgrid.functions.measures import Period, flag_rows, format_money
from spendgrid.operators import catalog as K
from spendgrid.operators import filters as FL
from spendgrid.operators import forecast as FC
from spendgrid.operators import grains as G
from spendgrid.operators import points as PT
from spendgrid.operators import rollup as R
from spendgrid.operators import snapshots as SN
from spendgrid.plans import bindings as B
from spendgrid.plans.sqlparts import (
    ACCOUNT_CATALOG_CTE,
    FACTS_CTE,
    FORECAST_ACCT_CTE,
    FORECAST_ID_CTE,
    SNAPSHOT_CTE,
    mass,
    money,
    totals,
    variance_select,
    weighted_sums,
)
from spendgrid.plans.registry import register
from spendgrid.session import scratch_path, stored

def _a1_sql(keys: str, where: str = "", lo: int = 1, hi: int = 30, weeks=None, sort_key: str | None = None) -> str:
    sk = sort_key or "-abs(CAST(ROUND(s_real, 2) AS DOUBLE))"
    return f"""WITH {FACTS_CTE},
g AS (SELECT {keys}, {weighted_sums(lo, hi, weeks=weeks)} FROM facts {where} GROUP BY {keys}),
t AS ({totals()})
SELECT {keys}, {variance_select()}, {sk} AS sort_key
FROM g CROSS JOIN t WHERE {mass()}"""


# --- A5 (+J1): forecast allocated to divisions by share of actual within each account ---------
@register(
    "a05_allocate_forecast",
    f"""WITH {FACTS_CTE}, {FORECAST_ID_CTE},
fa AS (SELECT account_id, SUM(CASE WHEN sem >= 1 AND sem <= 30 THEN forecast ELSE CAST(0 AS DECIMAL(18,5)) END) AS fc
       FROM fc GROUP BY account_id),
pg AS (SELECT account_id, agrupa1, division,
         SUM(CASE WHEN sem >= 1 AND sem <= 30 THEN real ELSE CAST(0 AS DECIMAL(18,5)) END) AS r
       FROM facts GROUP BY account_id, agrupa1, division),
pw AS (SELECT *, SUM(abs(r)) OVER (PARTITION BY account_id) AS tot, COUNT(*) OVER (PARTITION BY account_id) AS n FROM pg),
al AS (SELECT agrupa1, division,
         SUM(CAST(fa.fc AS DOUBLE) * CASE WHEN tot > 0 THEN CAST(abs(r) AS DOUBLE) / CAST(tot AS DOUBLE)
                                           ELSE CAST(1.0 AS DOUBLE) / n END) AS forecast_alloc
       FROM pw JOIN fa ON pw.account_id = fa.account_id GROUP BY agrupa1, division),
g0 AS (SELECT agrupa1, division, {weighted_sums(1, 30)} FROM facts GROUP BY agrupa1, division),
g AS (SELECT g0.*, coalesce(al.forecast_alloc, 0.0) AS forecast_alloc FROM g0 LEFT JOIN al
        ON g0.agrupa1 = al.agrupa1 AND g0.division = al.division),
t AS ({totals()})
SELECT agrupa1, division, {variance_select(forecast='forecast_alloc')},
  -abs(CAST(ROUND(s_real, 2) AS DOUBLE)) AS sort_key
FROM g CROSS JOIN t WHERE {mass()}""",
)
def a05(spark, sf_dir):
    facts = stored(B.facts(spark, sf_dir), "weekly-facts")  # the fact table is read by the allocation and the roll-up
    fc = FC.allocate_forecast(facts, B.forecast_by_account_id(spark, sf_dir, facts), ["agrupa1", "division"], Period(1, 30), B.SMR)
    return R.rollup_variance(facts, "division", Period(1, 30), smr=B.SMR, forecast=fc)


# --- A15: forecast range by account -------------------------------------------------------------
@register(
    "a15_forecast_range",
    f"""WITH {FACTS_CTE}, {FORECAST_ACCT_CTE},
g AS (SELECT grupo, cuenta, SUM(CASE WHEN sem <= 30 THEN real ELSE CAST(0 AS DECIMAL(18,5)) END) AS r,
        SUM(forecast) AS f FROM fca WHERE sem >= 1 AND sem <= 30 GROUP BY grupo, cuenta)
SELECT grupo, cuenta, CAST(ROUND(r, 2) AS DOUBLE) AS real, CAST(ROUND(f, 2) AS DOUBLE) AS forecast,
  CAST(ROUND(r - f, 2) AS DOUBLE) AS vs_forecast_abs,
  CASE WHEN f <> 0 THEN ROUND(CAST(r - f AS DOUBLE) / abs(CAST(f AS DOUBLE)) * 100, 4) END AS vs_forecast_pct
FROM g""",
)
def a15(spark, sf_dir):
    return FC.forecast_range(B.forecast_by_account(spark, sf_dir), 1, 30, B.SMR)


# --- A16: weekly actual vs forecast ---------------------------------------------------------------
@register(
    "a16_forecast_weekly",
    f"""WITH {FACTS_CTE}, {FORECAST_ACCT_CTE}
SELECT sem, CASE WHEN sem <= 30 THEN CAST(ROUND(SUM(real), 2) AS DOUBLE) END AS real,
  CAST(ROUND(SUM(forecast), 2) AS DOUBLE) AS forecast FROM fca GROUP BY sem""",
)
def a16(spark, sf_dir):
    return FC.forecast_weekly(B.forecast_by_account(spark, sf_dir), B.SMR)


# --- catalog cleaning shared by J2/J3/J10 -----------------------------------------------------------
_CC = """cc AS (SELECT account_id, grupo, cuenta, pos FROM (
    SELECT trim(account_raw) AS account_id, grupo, cuenta, pos,
           ROW_NUMBER() OVER (PARTITION BY trim(account_raw) ORDER BY pos) AS rn FROM cat) WHERE rn = 1)"""
_CLEAN = lambda c: f"coalesce(nullif(trim(CAST(cc.{c} AS VARCHAR)), ''), '(Sin dato)')"


@register(
    "j02_attach_catalog",
    f"""WITH {FACTS_CTE}, {SNAPSHOT_CTE}, {ACCOUNT_CATALOG_CTE}, {_CC}
SELECT sr.snapshot, {_CLEAN('grupo')} AS grupo, {_CLEAN('cuenta')} AS cuenta,
  CAST(ROUND(SUM(sr.amount), 2) AS DOUBLE) AS amount
FROM sr LEFT JOIN cc ON trim(sr.account_raw) = cc.account_id GROUP BY 1, 2, 3""",
)
def j02(spark, sf_dir):
    real, _ = B.snapshots(spark, sf_dir)
    cat = SN.clean_catalog(B.account_catalog(spark, sf_dir))
    agg = SN.snapshot_aggregate(real, cat, "amount")
    return agg.select("snapshot", "grupo", "cuenta", F.round("amount", 2).cast("double").alias("amount"))


@register(
    "j03_dedupe_first",
    f"""WITH {ACCOUNT_CATALOG_CTE}, {_CC} SELECT account_id, pos, grupo, cuenta FROM cc""",
)
def j03(spark, sf_dir):
    c = B.account_catalog(spark, sf_dir).withColumn("account_id", F.trim("account_raw"))
    return K.dedupe_first(c, "account_id", ["pos"]).select("account_id", "pos", "grupo", "cuenta")


@register(
    "j04_outer_align",
    f"""WITH {FACTS_CTE},
a AS (SELECT pdc, grupo, SUM(real_py) AS real_py FROM facts WHERE yr = 1997 GROUP BY pdc, grupo),
b AS (SELECT pdc, grupo, SUM(plan) AS plan FROM facts WHERE yr = 1998 GROUP BY pdc, grupo)
SELECT coalesce(a.pdc, b.pdc) AS pdc, coalesce(a.grupo, b.grupo) AS grupo,
  CAST(ROUND(coalesce(a.real_py, 0), 2) AS DOUBLE) AS real_py, CAST(ROUND(coalesce(b.plan, 0), 2) AS DOUBLE) AS plan
FROM a FULL JOIN b ON a.pdc = b.pdc AND a.grupo = b.grupo""",
)
def j04(spark, sf_dir):
    f = B.facts(spark, sf_dir)
    a = f.filter(F.col("yr") == B.PRIOR_YEAR).groupBy("pdc", "grupo").agg(F.sum("real_py").alias("real_py"))
    b = f.filter(F.col("yr") == B.CURRENT_YEAR).groupBy("pdc", "grupo").agg(F.sum("plan").alias("plan"))
    m = K.outer_align(a, b, ["pdc", "grupo"])
    return m.select("pdc", "grupo", *[F.round(c, 2).cast("double").alias(c) for c in ("real_py", "plan")])


@register(
    "j06_only_official",
    f"""WITH {FACTS_CTE},
g AS (SELECT pdc, {weighted_sums(1, 30)} FROM facts GROUP BY pdc)
SELECT pdc, {money('s_real_py')} AS real_py, {money('s_plan')} AS plan, {money('s_new_plan')} AS new_plan,
  {money('s_real')} AS real, {money('s_plan_rest')} AS plan_rest
FROM g WHERE pdc IN (SELECT c_name FROM customer WHERE c_acctbal > 0)""",
)
def j06(spark, sf_dir):
    official = B.table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 0).select(F.col("c_name").alias("pdc"))
    return FL.only_official(R.closures_range(B.facts(spark, sf_dir), ["pdc"], Period(1, 30), B.SMR), official, "pdc")


_SNAP_AGG = lambda src, name, where="": f"""{name} AS (SELECT {src}.snapshot, {_CLEAN('grupo')} AS grupo, {_CLEAN('cuenta')} AS cuenta,
    SUM({src}.amount) AS v FROM {src} LEFT JOIN cc ON trim({src}.account_raw) = cc.account_id {where} GROUP BY 1, 2, 3)"""  # noqa: E731


@register(
    "j10_compare_snapshots",
    f"""WITH {FACTS_CTE}, {SNAPSHOT_CTE}, {ACCOUNT_CATALOG_CTE}, {_CC},
{_SNAP_AGG('sr', 'ra')},
{_SNAP_AGG('sp', 'pa', 'WHERE sp.snapshot = 30')},
act AS (SELECT grupo, cuenta, v AS real_cur FROM ra WHERE snapshot = 30),
old AS (SELECT grupo, cuenta, v AS real_cmp FROM ra WHERE snapshot = 29),
m1 AS (SELECT coalesce(pa.grupo, act.grupo) AS grupo, coalesce(pa.cuenta, act.cuenta) AS cuenta,
         coalesce(pa.v, 0) AS plan, coalesce(act.real_cur, 0) AS real_cur
       FROM pa FULL JOIN act ON pa.grupo = act.grupo AND pa.cuenta = act.cuenta),
m AS (SELECT coalesce(m1.grupo, old.grupo) AS grupo, coalesce(m1.cuenta, old.cuenta) AS cuenta,
        coalesce(m1.plan, 0) AS plan, coalesce(m1.real_cur, 0) AS real_cur, coalesce(old.real_cmp, 0) AS real_cmp
      FROM m1 FULL JOIN old ON m1.grupo = old.grupo AND m1.cuenta = old.cuenta),
g AS (SELECT grupo, cuenta, CAST(2 - (GROUPING(grupo) + GROUPING(cuenta)) AS INTEGER) AS level,
        SUM(plan) AS plan, SUM(real_cur) AS real_cur, SUM(real_cmp) AS real_cmp FROM m GROUP BY ROLLUP (grupo, cuenta))
SELECT grupo, cuenta, level, CAST(ROUND(plan, 2) AS DOUBLE) AS plan, CAST(ROUND(real_cur, 2) AS DOUBLE) AS real_cur,
  CAST(ROUND(real_cmp, 2) AS DOUBLE) AS real_cmp, CAST(ROUND(real_cur - real_cmp, 2) AS DOUBLE) AS var_abs,
  ROUND(CASE WHEN CAST(real_cmp AS DOUBLE) = 0 THEN 0.0
             ELSE CAST(real_cur - real_cmp AS DOUBLE) / abs(CAST(real_cmp AS DOUBLE)) * 100 END, 4) AS var_pct
FROM g""",
)
def j10(spark, sf_dir):
    real, plan = B.snapshots(spark, sf_dir)
    return SN.compare_snapshots(real, plan, B.account_catalog(spark, sf_dir), 30, 29)


@register(
    "s07_snapshots_available",
    f"""WITH {FACTS_CTE}, {SNAPSHOT_CTE}
SELECT snapshot FROM (SELECT DISTINCT snapshot FROM sr INTERSECT SELECT DISTINCT snapshot FROM sp)""",
)
def s07(spark, sf_dir):
    real, plan = B.snapshots(spark, sf_dir)
    return SN.snapshots_available(real, plan)


# --- F1-F3: fiscal calendar of every order year -------------------------------------------------------
_YEARS_CAL = """cal AS (
  SELECT year, CAST(i // 7 + 1 AS INTEGER) AS sem, CAST(month(d) AS INTEGER) AS month, CAST(COUNT(*) AS INTEGER) AS days
  FROM (SELECT y.year, r.i, make_date(y.year, 1, 1) - CAST(dayofweek(make_date(y.year, 1, 1)) AS INTEGER) + CAST(r.i AS INTEGER) AS d
        FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders) y, range(0, 371) r(i)) x
  WHERE year(d) = year GROUP BY 1, 2, 3)"""


def _order_years(spark, sf_dir):
    return B.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct()


@register("f01_week_calendar", f"WITH {_YEARS_CAL} SELECT year, sem, month, days, days / 7.0 AS frac FROM cal")
def f01(spark, sf_dir):
    return C.calendar_for(_order_years(spark, sf_dir))


@register(
    "f02_month_weeks",
    f"WITH {_YEARS_CAL} SELECT year, month, min(sem) AS first_sem, max(sem) AS last_sem FROM cal GROUP BY year, month",
)
def f02(spark, sf_dir):
    return C.month_weeks(C.calendar_for(_order_years(spark, sf_dir)))


@register(
    "f03_split_weeks",
    f"""WITH {_YEARS_CAL}
SELECT year, sem, month, days, ROUND(days / 7 * 100, 4) AS pct FROM cal
WHERE (year, sem) IN (SELECT (year, sem) FROM cal GROUP BY year, sem HAVING count(*) > 1)""",
)
def f03(spark, sf_dir):
    return C.split_weeks(C.calendar_for(_order_years(spark, sf_dir)))


# --- F4: homologation of case variants, learned over two text tables ---------------------------------
@register(
    "f04_learn_canonical",
    r"""WITH part AS (SELECT unnest(string_split(text, ' ')) AS p FROM documents UNION SELECT unnest(string_split(text, ' ')) FROM conversations),
w AS (SELECT DISTINCT 'word' AS "column", unnest(regexp_extract_all(p, '\pL+')) AS value FROM part),
r AS (SELECT "column", value, lower(value) AS lv, length(value) - length(regexp_replace(value, '\p{Lu}', '', 'g')) AS nu FROM w),
least AS (SELECT "column", lv, min(nu) AS nu FROM r GROUP BY ALL),
b AS (SELECT r."column", r.lv, min(value) AS canonical FROM r JOIN least USING ("column", lv, nu) GROUP BY ALL)
SELECT r."column", r.value, b.canonical FROM r JOIN b USING ("column", lv)""",
)
def f04(spark, sf_dir):
    def words(t):
        return (
            B.table(spark, sf_dir, t)
            .select(F.explode(F.split("text", r"[^\p{L}]+")).alias("word"))
            .filter(F.col("word") != "")
        )

    return K.learn_canonical([words("documents"), words("conversations")], ["word"])


# --- P1: filter list (tuple -> IN, scalar -> =, missing column skipped) --------------------------------
@register(
    "p01_apply_filters",
    _a1_sql("agrupa1, division, territorio", "WHERE agrupa1 IN ('EUROPE', 'ASIA') AND territorio = 'BUILDING'"),
)
def p01(spark, sf_dir):
    filters = [("agrupa1", ("EUROPE", "ASIA")), ("territorio", "BUILDING"), ("no_such_column", 1)]
    return R.rollup_variance(B.facts(spark, sf_dir), "territorio", Period(1, 30), filters=filters, smr=B.SMR)


# --- P2: week weights, months mode (each measure in its own year's calendar) ----------------------------
def _cal_sql(year):
    a = f"(make_date({year}, 1, 1) - CAST(dayofweek(make_date({year}, 1, 1)) AS INTEGER))"
    return f"""(SELECT CAST(i // 7 + 1 AS INTEGER) AS sem, CAST(SUM(1) AS INTEGER) AS days
  FROM (SELECT i, {a} + CAST(i AS INTEGER) AS d FROM range(0, 371) r(i)) x
  WHERE year(d) = {year} AND month(d) IN (3, 4) GROUP BY 1)"""


@register(
    "p02_week_weight_months",
    f"""WITH {FACTS_CTE},
days AS (SELECT coalesce(a.sem, b.sem) AS sem, coalesce(a.days, 0) AS d_py, coalesce(b.days, 0) AS d_cur
         FROM {_cal_sql(1997)} a FULL JOIN {_cal_sql(1998)} b ON a.sem = b.sem),
g AS (SELECT agrupa1, division,
        SUM(real_py * coalesce(d_py, 0)) AS s_real_py, SUM(plan * coalesce(d_cur, 0)) AS s_plan,
        SUM(new_plan * coalesce(d_cur, 0)) AS s_new_plan,
        SUM(CASE WHEN facts.sem <= 30 THEN real * coalesce(d_cur, 0) ELSE CAST(0 AS DECIMAL(18,5)) END) AS s_real,
        SUM(CASE WHEN facts.sem > 30 THEN plan ELSE CAST(0 AS DECIMAL(18,5)) END * 7) AS s_plan_rest
      FROM facts LEFT JOIN days ON facts.sem = days.sem GROUP BY agrupa1, division),
t AS ({totals()})
SELECT agrupa1, division, {variance_select(div=7)}, -abs(ROUND(CAST(s_real AS DOUBLE) / 7, 2)) AS sort_key
FROM g CROSS JOIN t WHERE {mass(7)}""",
)
def p02(spark, sf_dir):
    return R.rollup_variance(B.facts(spark, sf_dir), "division", Period(mode="months", months=(3, 4)), smr=B.SMR)


@register("p02_week_weight_set", _a1_sql("agrupa1, division", hi=30, weeks=(1, 5, 9, 13, 29, 40)))
def p02b(spark, sf_dir):
    return R.rollup_variance(B.facts(spark, sf_dir), "division", Period(hi=30, mode="set", weeks=(1, 5, 9, 13, 29, 40)), smr=B.SMR)


# --- P3: grain routing gives the same answer as the leaf ---------------------------------------------------
@register("p03_pick_grain", _a1_sql("agrupa1, division"))
def p03(spark, sf_dir):
    leaf = stored(B.facts(spark, sf_dir), "leaf-grain")
    spec = {"division": ["agrupa1", "division"], "pdc": ["agrupa1", "division", "territorio", "pdc"]}
    paths = G.write_grains(leaf, spec, scratch_path(spark, "grains"))
    grains = {name: spark.read.parquet(path) for name, path in paths.items()} | {"leaf": leaf}
    _, grain = G.pick_grain(["agrupa1", "division", "sem"], grains)
    return R.rollup_variance(grain, "division", Period(1, 30), smr=B.SMR)


# --- P4: actual cut-off inside a range that crosses the last closed week -----------------------------------
@register("p04_apply_cutoff", _a1_sql("agrupa1, division", lo=25, hi=40))
def p04(spark, sf_dir):
    return R.rollup_variance(B.facts(spark, sf_dir), "division", Period(25, 40), smr=B.SMR)


# --- P5: measure block at account level -------------------------------------------------------------------
@register("p05_variance_columns", _a1_sql("agrupa1, grupo, cuenta"))
def p05(spark, sf_dir):
    return R.rollup_variance(B.facts(spark, sf_dir), "cuentas", Period(1, 30), smr=B.SMR)


# --- P6: materiality drop on a single week (individual mode) ------------------------------------------------
@register("p06_drop_immaterial", _a1_sql("agrupa1, division, territorio, pdc", lo=5, hi=5))
def p06(spark, sf_dir):
    return R.rollup_variance(B.facts(spark, sf_dir), "pdc", Period(hi=5, mode="individual"), smr=B.SMR)


# --- P7/P8: text searches ------------------------------------------------------------------------------------
@register(
    "p07_search_contains",
    "SELECT p_partkey, p_name FROM part WHERE coalesce(contains(lower(p_name), 'gear'), false)",
)
def p07(spark, sf_dir):
    return FL.search_contains(B.table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "Gear")


@register(
    "p08_search_any",
    """SELECT DISTINCT c_name, c_mktsegment, c_custkey FROM customer
WHERE coalesce(contains(lower(c_name), '0001'), false) OR coalesce(contains(lower(c_mktsegment), '0001'), false)
   OR coalesce(CAST(c_custkey AS VARCHAR) = '0001', false)""",
)
def p08(spark, sf_dir):
    return FL.search_any(B.table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"], "0001", id_col="c_custkey")


# --- P9: wide -> long ------------------------------------------------------------------------------------------
_LONG_COLS = "division, territorio, pdc, grupo, cuenta, centre, sem"


@register(
    "p09_to_long",
    f"""WITH {FACTS_CTE}
SELECT {_LONG_COLS}, serie, CAST(monto AS DOUBLE) AS monto FROM (
  SELECT {_LONG_COLS}, 'R25' AS serie, real_py AS monto FROM facts UNION ALL
  SELECT {_LONG_COLS}, 'P26', plan FROM facts UNION ALL
  SELECT {_LONG_COLS}, 'NVO', new_plan FROM facts UNION ALL
  SELECT {_LONG_COLS}, 'R26', real FROM facts)""",
)
def p09(spark, sf_dir):
    from spendgrid.operators.longfact import to_long

    long = to_long(B.facts(spark, sf_dir), _LONG_COLS.split(", "))
    return long.withColumn("monto", F.col("monto").cast("double"))


# --- P10: cascading options ----------------------------------------------------------------------------------
@register(
    "p10_options",
    f"WITH {FACTS_CTE} SELECT DISTINCT division FROM facts WHERE agrupa1 = 'EUROPE' AND division IS NOT NULL",
)
def p10(spark, sf_dir):
    return FL.options(B.facts(spark, sf_dir), "division", given=[("agrupa1", "EUROPE")])


# --- P12 + O6: "<id> · <name>" labels and ordering by the id inside the label ------------------------------------
_LABEL_SQL = f"""WITH {FACTS_CTE},
j AS (SELECT f.pdc, c.id FROM (SELECT DISTINCT pdc FROM facts) f
      LEFT JOIN (SELECT trim(CAST(c_name AS VARCHAR)) AS nm, CAST(c_custkey AS VARCHAR) AS id FROM customer) c
      ON trim(f.pdc) = c.nm),
l AS (SELECT pdc, CASE
    WHEN pdc IS NULL OR trim(pdc) IN ('', '0', '0.0', 'nan', 'NaN', 'None') THEN 'Sin agrupar'
    WHEN id IS NULL OR trim(id) IN ('', '0', '0.0', 'nan', 'NaN', 'None') THEN trim(pdc)
    ELSE CASE WHEN TRY_CAST(trim(id) AS DOUBLE) IS NOT NULL AND TRY_CAST(trim(id) AS DOUBLE) = floor(TRY_CAST(trim(id) AS DOUBLE))
                   AND TRY_CAST(trim(id) AS DOUBLE) > 0
              THEN CAST(CAST(floor(TRY_CAST(trim(id) AS DOUBLE)) AS BIGINT) AS VARCHAR) ELSE trim(id) END
         || ' · ' || trim(pdc) END AS label FROM j)"""


def _labels(spark, sf_dir):
    cat = B.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    return K.label_with_id(B.facts(spark, sf_dir).select("pdc").distinct(), "pdc", cat)


@register("p12_label_with_id", f"{_LABEL_SQL} SELECT pdc, label FROM l")
def p12(spark, sf_dir):
    return _labels(spark, sf_dir)


@register(
    "o06_order_by_label_id",
    rf"""{_LABEL_SQL}
SELECT pdc, label, CASE WHEN regexp_extract(label, '^\s*(\d+)', 1) <> ''
  THEN CAST(regexp_extract(label, '^\s*(\d+)', 1) AS BIGINT) END AS label_id FROM l""",
)
def o06(spark, sf_dir):
    return PT.order_by_label_id(_labels(spark, sf_dir), "label")


# --- P13: money display ---------------------------------------------------------------------------------------------
def _fmt_sql(x, dp):
    f = f"format('{{:,.{dp}f}}', abs({x}) / 1e6)"
    return f"CASE WHEN {x} IS NULL THEN '—' WHEN {x} > 0 THEN '(' || {f} || ')' WHEN {x} < 0 THEN '-' || {f} ELSE {f} END"


@register(
    "p13_format_money",
    f"""WITH v AS ({_a1_sql('agrupa1, division')})
SELECT division, {_fmt_sql('real', 1)} AS real_fmt, {_fmt_sql('vs_plan_abs', 2)} AS vs_plan_fmt FROM v""",
)
def p13(spark, sf_dir):
    v = R.rollup_variance(B.facts(spark, sf_dir), "division", Period(1, 30), smr=B.SMR)
    return v.select("division", format_money(F.col("real"), 1).alias("real_fmt"), format_money(F.col("vs_plan_abs"), 2).alias("vs_plan_fmt"))


# --- P14: live / plan / over-plan flags ----------------------------------------------------------------------------
@register(
    "p14_flag_rows",
    f"""WITH v AS ({_a1_sql('agrupa1, division, territorio, pdc')})
SELECT pdc, division, plan, real, vs_plan_abs, (plan <> 0) OR (real <> 0) AS is_live, plan <> 0 AS has_plan,
  vs_plan_abs > 0 AS over_plan FROM v""",
)
def p14(spark, sf_dir):
    v = R.rollup_variance(B.facts(spark, sf_dir), "pdc", Period(1, 30), smr=B.SMR)
    return flag_rows(v.select("pdc", "division", "plan", "real", "vs_plan_abs"))


# --- A17/A18: point deviation KPIs and histogram ------------------------------------------------------------------
@register(
    "a17_deviation_kpis",
    f"""WITH {FACTS_CTE},
g AS (SELECT division, pdc, SUM(CASE WHEN sem >= 1 AND sem <= 30 THEN plan ELSE CAST(0 AS DECIMAL(18,5)) END) AS plan,
        SUM(CASE WHEN sem >= 1 AND sem <= 30 THEN real ELSE CAST(0 AS DECIMAL(18,5)) END) AS real
      FROM facts GROUP BY division, pdc),
p AS (SELECT pdc, SUM(plan) AS plan, SUM(real) AS real FROM g GROUP BY pdc),
d AS (SELECT *, CAST(real - plan AS DOUBLE) / abs(CAST(plan AS DOUBLE)) * 100 AS dev_pct FROM p WHERE plan <> 0),
k AS (SELECT COUNT(*) AS n, SUM(CASE WHEN real > plan THEN 1 ELSE 0 END) AS n_over,
        SUM(CASE WHEN real <= plan THEN 1 ELSE 0 END) AS n_under, SUM(plan) AS plan, SUM(real) AS real,
        quantile_cont(dev_pct, 0.5) AS med FROM d)
SELECT CAST(n AS BIGINT) AS n_points, CAST(n_over AS BIGINT) AS n_over, CAST(n_under AS BIGINT) AS n_under,
  ROUND(n_over / n * 100, 4) AS pct_over, ROUND(n_under / n * 100, 4) AS pct_under,
  CAST(ROUND(plan, 2) AS DOUBLE) AS plan, CAST(ROUND(real, 2) AS DOUBLE) AS real,
  CASE WHEN real > plan THEN 'Sobre plan' ELSE 'Bajo plan' END AS status, ROUND(med, 4) AS median_dev_pct FROM k""",
)
def a17(spark, sf_dir):
    g = R._aggregate(B.facts(spark, sf_dir), ["division", "pdc"], Period(1, 30), B.SMR)
    return PT.deviation_kpis(g.select("division", "pdc", F.col("s_plan").alias("plan"), F.col("s_real").alias("real")))


_PDC_V = f"""{FACTS_CTE},
g AS (SELECT agrupa1, division, territorio, pdc, {weighted_sums(1, 30)} FROM facts GROUP BY agrupa1, division, territorio, pdc),
t AS ({totals()}),
v AS (SELECT agrupa1, division, territorio, pdc, {variance_select()} FROM g CROSS JOIN t WHERE {mass()})"""


@register(
    "a18_deviation_histogram",
    f"""WITH {_PDC_V},
x AS (SELECT vs_plan_abs / 1e6 AS x FROM v WHERE vs_plan_abs IS NOT NULL),
l AS (SELECT least(greatest(1.0, CAST(ceil(quantile_cont(abs(x), 0.99)) AS DOUBLE)),
                   greatest(2.0, CAST(ceil(max(abs(x))) AS DOUBLE))) AS lim FROM x),
k AS (SELECT x.x FROM x, l WHERE x.x >= -l.lim AND x.x <= l.lim),
sd AS (SELECT CASE WHEN stddev_samp(x) IS NULL OR stddev_samp(x) = 0 THEN 1.0 ELSE stddev_samp(x) END AS sigma FROM k),
c AS (SELECT CAST(least(floor((k.x + l.lim) / (l.lim * 2 / 40)), 39) AS INTEGER) AS bin, COUNT(*) AS n FROM k, l GROUP BY 1),
b AS (SELECT CAST(i AS INTEGER) AS bin FROM range(0, 40) r(i))
SELECT b.bin, ROUND(-l.lim + b.bin * (l.lim * 2 / 40), 6) AS lo, ROUND(-l.lim + (b.bin + 1) * (l.lim * 2 / 40), 6) AS hi,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n,
  CASE WHEN abs(-l.lim + (b.bin + 0.5) * (l.lim * 2 / 40)) < (l.lim * 2 / 40) THEN 'plan'
       WHEN abs(-l.lim + (b.bin + 0.5) * (l.lim * 2 / 40)) / sd.sigma <= 1 THEN '1s'
       WHEN abs(-l.lim + (b.bin + 0.5) * (l.lim * 2 / 40)) / sd.sigma <= 2 THEN '2s' ELSE '3s' END AS band
FROM b CROSS JOIN l CROSS JOIN sd LEFT JOIN c ON b.bin = c.bin""",
)
def a18(spark, sf_dir):
    v = R.rollup_variance(B.facts(spark, sf_dir), "pdc", Period(1, 30), smr=B.SMR)
    return PT.deviation_histogram(v, "vs_plan_abs", 40)


# --- U2: point search by name, by id text and by order (centre) id -------------------------------------------------
@register(
    "u02_find_points",
    """SELECT c_name AS name, c_custkey AS point_id FROM customer WHERE contains(lower(c_name), '12')
UNION SELECT c_name, c_custkey FROM customer WHERE contains(CAST(c_custkey AS VARCHAR), '12')
UNION SELECT c.c_name, c.c_custkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
      WHERE CAST(o.o_orderkey AS VARCHAR) = '12'""",
)
def u02(spark, sf_dir):
    cust = B.table(spark, sf_dir, "customer")
    catalog = cust.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("point_id"))
    centres = B.table(spark, sf_dir, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_name").alias("name"), F.col("o_orderkey").alias("centre_id")
    )
    return PT.find_points(catalog, centres, "12")


# --- P11: name cleaning with missing-category fill -------------------------------------------------
@register(
    "p11_clean_category",
    """SELECT doc_id, coalesce(nullif(trim(CAST(source AS VARCHAR)), ''), '(Sin dato)') AS source,
  coalesce(nullif(trim(CAST(quality AS VARCHAR)), ''), '(Sin dato)') AS quality
FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def p11(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select("doc_id", "source")
    lab = B.table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = d.join(lab, "doc_id", "left")
    return j.select("doc_id", K.clean_category(F.col("source")).alias("source"), K.clean_category(F.col("quality")).alias("quality"))

"""Building blocks for the DuckDB twins of each query (the correctness oracle).

The twins are plain ANSI SQL over the driver's views. These helpers only spell the
same arithmetic the Spark operators use (decimal sums, double ratios, rounding) so the
two engines produce bit-identical values.
"""

from __future__ import annotations

MEASURES = ("real_py", "plan", "new_plan", "real")
DEC = "DECIMAL(18,5)"

FACTS_CTE = f"""facts AS (
  SELECT r.r_name AS agrupa1, n.n_name AS division, c.c_mktsegment AS territorio,
         'Zona ' || CAST(c.c_custkey % 7 AS VARCHAR) AS zona, 'Region ' || CAST(c.c_custkey % 21 AS VARCHAR) AS region,
         c.c_name AS pdc, p.p_brand AS grupo, p.p_type AS cuenta,
         p.p_brand || '/' || p.p_type AS account_id, c.c_custkey AS centre, f.l_linenumber AS line, f.yr, f.sem,
         CASE WHEN f.yr = 1997 THEN f.net ELSE CAST(0 AS {DEC}) END AS real_py,
         CASE WHEN f.yr = 1998 THEN f.gross ELSE CAST(0 AS {DEC}) END AS plan,
         CASE WHEN f.yr = 1998 THEN f.np ELSE CAST(0 AS {DEC}) END AS new_plan,
         CASE WHEN f.yr = 1998 AND f.sem <= 30 THEN f.net ELSE CAST(0 AS {DEC}) END AS real
  FROM (
    SELECT l.l_partkey, l.l_linenumber, o.o_custkey, year(o.o_orderdate) AS yr,
           CAST(datediff('day',
                make_date(year(o.o_orderdate), 1, 1)
                  - CAST(dayofweek(make_date(year(o.o_orderdate), 1, 1)) AS INTEGER),
                CAST(o.o_orderdate AS DATE)) // 7 + 1 AS INTEGER) AS sem,
           CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS {DEC}) AS net,
           CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) AS {DEC}) AS gross,
           CAST(CAST(l.l_extendedprice AS DECIMAL(18,2))
                * (1 - CAST(l.l_discount AS DECIMAL(4,2)) * CAST(0.5 AS DECIMAL(2,1))) AS {DEC}) AS np
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
    WHERE o.o_orderdate >= TIMESTAMP '1997-01-01' AND o.o_orderdate < TIMESTAMP '1999-01-01'
  ) f
  JOIN customer c ON f.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON f.l_partkey = p.p_partkey
)"""


def money(e: str, div: int = 1) -> str:
    if div == 1:
        return f"CAST(ROUND({e}, 2) AS DOUBLE)"
    return f"ROUND(CAST({e} AS DOUBLE) / {div}, 2)"


def dbl(e: str, div: int = 1) -> str:
    return f"CAST({e} AS DOUBLE)" if div == 1 else f"(CAST({e} AS DOUBLE) / {div})"


def pct_abs(n: str, d: str) -> str:
    return f"CASE WHEN {d} = 0 THEN 0.0 ELSE {n} / abs({d}) * 100 END"


def pct_signed(n: str, d: str) -> str:
    return f"CASE WHEN {d} = 0 THEN 0.0 ELSE {n} / {d} * 100 END"


def weighted_sums(lo: int, hi: int, smr: int = 30, weeks: tuple | None = None) -> str:
    """SUM(CASE ...) list for range / individual / set periods (decimal sums)."""
    if weeks is not None:
        inw = f"sem IN ({', '.join(str(w) for w in weeks)})"
        both = f"{inw} AND sem <= {hi}"
        real = f"{inw} AND sem <= {min(hi, smr)}"
    else:
        both = f"sem >= {lo} AND sem <= {hi}"
        real = f"sem >= {lo} AND sem <= {min(hi, smr)}"
    z = f"CAST(0 AS {DEC})"
    return ",\n    ".join(
        [
            f"SUM(CASE WHEN {both} THEN real_py ELSE {z} END) AS s_real_py",
            f"SUM(CASE WHEN {both} THEN plan ELSE {z} END) AS s_plan",
            f"SUM(CASE WHEN {both} THEN new_plan ELSE {z} END) AS s_new_plan",
            f"SUM(CASE WHEN {real} THEN real ELSE {z} END) AS s_real",
            f"SUM(CASE WHEN sem > {smr} THEN plan ELSE {z} END) AS s_plan_rest",
        ]
    )


def calendar_sql(year: int) -> str:
    """(sem, month, days) of the fiscal calendar of ``year`` (own-year days only)."""
    a = f"(make_date({year}, 1, 1) - CAST(dayofweek(make_date({year}, 1, 1)) AS INTEGER))"
    return f"""(SELECT CAST(i // 7 + 1 AS INTEGER) AS sem, CAST(month(d) AS INTEGER) AS month,
         CAST(COUNT(*) AS INTEGER) AS days
  FROM (SELECT i, {a} + CAST(i AS INTEGER) AS d FROM range(0, 371) r(i)) x
  WHERE year(d) = {year} GROUP BY 1, 2)"""


def variance_select(div: int = 1, shares: bool = True, t: str = "t", forecast: str | None = None,
                    pct_level0: bool = False) -> str:
    """Select list of the P5 measure block over ``s_*`` columns (and ``t.t_*`` totals)."""
    d = {m: dbl(f"s_{m}", div) for m in MEASURES}
    cols = []
    for m in MEASURES:
        cols.append(f"{money(f's_{m}', div)} AS {m}")
        if shares:
            e = f"ROUND({pct_signed(d[m], dbl(f'{t}.t_{m}', div))}, 4)"
            if pct_level0:
                e = f"CASE WHEN level = 0 THEN 100.0 ELSE {e} END"
            cols.append(f"{e} AS pct_{m}")
    vs_py, vs_plan, vs_new = "(s_real - s_real_py)", "(s_real - s_plan)", "(s_real - s_new_plan)"
    if forecast is None:
        fc_d = dbl("(s_real + s_plan_rest)", div)
        fc_out = money("(s_real + s_plan_rest)", div)
        vs_fc_d = dbl("(-s_plan_rest)", div)
        vs_fc_out = money("(-s_plan_rest)", div)
    else:
        fc_d = forecast
        fc_out = f"ROUND({forecast}, 2)"
        vs_fc_d = f"({d['real']} - {forecast})"
        vs_fc_out = f"ROUND({vs_fc_d}, 2)"
    cols += [
        f"{money('s_plan_rest', div)} AS plan_rest",
        f"ROUND({pct_signed(d['real'], d['plan'])}, 4) AS compliance",
        f"{money(vs_py, div)} AS vs_py_abs",
        f"ROUND({pct_abs(dbl(vs_py, div), d['real_py'])}, 4) AS vs_py_pct",
        f"CASE WHEN {vs_py} <= 0 THEN 'Ahorro' ELSE 'Gasto extra' END AS label_py",
        f"{money(vs_plan, div)} AS vs_plan_abs",
        f"ROUND({pct_abs(dbl(vs_plan, div), d['plan'])}, 4) AS vs_plan_pct",
        f"CASE WHEN {vs_plan} <= 0 THEN 'Bajo plan' ELSE 'Sobre plan' END AS label_plan",
        f"{money(vs_new, div)} AS vs_new_plan_abs",
        f"ROUND({pct_abs(dbl(vs_new, div), d['new_plan'])}, 4) AS vs_new_plan_pct",
        f"{fc_out} AS forecast",
        f"ROUND({pct_signed(fc_d, d['plan'])}, 4) AS forecast_compliance",
        f"{vs_fc_out} AS vs_forecast_abs",
        f"ROUND({pct_abs(vs_fc_d, fc_d)}, 4) AS vs_forecast_pct",
    ]
    return ",\n  ".join(cols)


def mass(div: int = 1) -> str:
    e = "abs(s_real_py) + abs(s_plan) + abs(s_new_plan) + abs(s_real)"
    return f"({e}) > 0.5" if div == 1 else f"CAST(({e}) AS DOUBLE) / {div} > 0.5"


def totals(src: str = "g") -> str:
    return "SELECT " + ", ".join(f"SUM(s_{m}) AS t_{m}" for m in MEASURES) + f" FROM {src}"


FORECAST_ID_CTE = """fc AS (SELECT account_id, sem, CAST(SUM(plan) * CAST(1.02 AS DECIMAL(3,2)) AS DECIMAL(20,7)) AS forecast
  FROM facts WHERE yr = 1998 GROUP BY account_id, sem)"""

FORECAST_ACCT_CTE = """fca AS (SELECT grupo, cuenta, sem, SUM(real) AS real,
    CAST(SUM(plan) * CAST(1.02 AS DECIMAL(3,2)) AS DECIMAL(20,7)) AS forecast
  FROM facts WHERE yr = 1998 GROUP BY grupo, cuenta, sem)"""

ACCOUNT_CATALOG_CTE = """cat AS (SELECT ' ' || p_brand || '/' || p_type || ' ' AS account_raw, p_brand AS grupo,
    p_type AS cuenta, p_partkey AS pos FROM part WHERE p_size <= 40)"""

SNAPSHOT_CTE = """sr AS (
  SELECT 30 AS snapshot, sem, ' ' || account_id || ' ' AS account_raw, real AS amount FROM facts WHERE yr = 1998 AND sem <= 30
  UNION ALL SELECT 29, sem, ' ' || account_id || ' ', real FROM facts WHERE yr = 1998 AND line <= 5 AND sem <= 29
  UNION ALL SELECT 28, sem, ' ' || account_id || ' ', real FROM facts WHERE yr = 1998 AND line <= 3 AND sem <= 28),
sp AS (
  SELECT 30 AS snapshot, sem, ' ' || account_id || ' ' AS account_raw, plan AS amount FROM facts WHERE yr = 1998
  UNION ALL SELECT 29, sem, ' ' || account_id || ' ', plan FROM facts WHERE yr = 1998 AND line <= 5)"""

LONG_CTE = """long AS (
  SELECT division, territorio, pdc, grupo, cuenta, centre, sem, 'R25' AS serie, real_py AS monto FROM facts UNION ALL
  SELECT division, territorio, pdc, grupo, cuenta, centre, sem, 'P26', plan FROM facts UNION ALL
  SELECT division, territorio, pdc, grupo, cuenta, centre, sem, 'NVO', new_plan FROM facts UNION ALL
  SELECT division, territorio, pdc, grupo, cuenta, centre, sem, 'R26', real FROM facts)"""


def fold(x: str) -> str:
    return f"regexp_replace(lower(strip_accents({x})), '^\\s+|\\s+$', '', 'g')"

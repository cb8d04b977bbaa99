"""Registered queries over the long fact and the question batch (A11-A14, O4, O5, S11,
F5, F10-F12) and their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendgrid.operators import longfact as LF
from spendgrid.operators import questions as QN
from spendgrid.plans import bindings as B
from spendgrid.plans.sqlparts import FACTS_CTE, LONG_CTE, fold
from spendgrid.plans.registry import register

def _money_cols(cols):
    return [F.round(c, 2).cast("double").alias(c) for c in cols]


def _sql_money(cols):
    return ", ".join(f"CAST(ROUND({c}, 2) AS DOUBLE) AS {c}" for c in cols)


_Z = "CAST(0 AS DECIMAL(18,5))"


def _piv(codes):
    return ", ".join(f"SUM(CASE WHEN serie = '{c}' THEN monto ELSE {_Z} END) AS {c}" for c in codes)


@register(
    "a11_pivot_series",
    f"""WITH {FACTS_CTE}, {LONG_CTE},
g AS (SELECT division, grupo, {_piv(('R25', 'P26', 'R26'))} FROM long WHERE sem <= 30 GROUP BY division, grupo)
SELECT division, grupo, {_sql_money(('R25', 'P26', 'R26'))} FROM g""",
)
def a11(spark, sf_dir):
    g = LF.pivot_series(B.facts_long(spark, sf_dir), ["division", "grupo"], 30)
    return g.select("division", "grupo", *_money_cols(("R25", "P26", "R26")))


@register(
    "a12_pivot_wide",
    f"""WITH {FACTS_CTE}, {LONG_CTE},
g AS (SELECT territorio, {', '.join(f"coalesce(SUM(CASE WHEN serie = '{c}' THEN monto END), 0) AS {c}" for c in ('R25', 'P26', 'R26', 'NVO'))}
      FROM long GROUP BY territorio)
SELECT territorio, {_sql_money(('R25', 'P26', 'R26', 'NVO'))} FROM g""",
)
def a12(spark, sf_dir):
    g = LF.pivot_wide(B.facts_long(spark, sf_dir), "territorio")
    return g.select("territorio", *_money_cols(("R25", "P26", "R26", "NVO")))


@register(
    "a13_series_totals",
    f"""WITH {FACTS_CTE}, {LONG_CTE}
SELECT serie, CAST(ROUND(SUM(monto), 2) AS DOUBLE) AS total FROM long WHERE sem <= 30 GROUP BY serie""",
)
def a13(spark, sf_dir):
    g = LF.series_totals(B.facts_long(spark, sf_dir), 30)
    return g.select("serie", F.round("total", 2).cast("double").alias("total"))


@register(
    "a14_match_report",
    f"""WITH {FACTS_CTE}, {LONG_CTE}, named AS (
  SELECT * REPLACE (CASE centre % 20 WHEN 0 THEN NULL WHEN 1 THEN '0' ELSE pdc END AS pdc) FROM long)
SELECT CASE WHEN pdc IS NULL OR pdc IN ('0', '(Sin dato)', 'Sin agrupar') THEN 'generic' ELSE 'assigned' END AS match,
  COUNT(DISTINCT centre) AS n_centres,
  CAST(ROUND(SUM(CASE WHEN serie = 'R26' THEN monto ELSE {_Z} END), 2) AS DOUBLE) AS R26
FROM named WHERE sem <= 30 GROUP BY 1""",
)
def a14(spark, sf_dir):
    # some centres have no point, some a placeholder
    point = F.when(F.col("centre") % 20 == 0, None).when(F.col("centre") % 20 == 1, "0").otherwise(F.col("pdc"))
    g = LF.match_report(B.facts_long(spark, sf_dir).withColumn("pdc", point), 30)
    return g.select("match", "n_centres", F.round("R26", 2).cast("double").alias("R26"))


_O4_KEYS = "centre, pdc, division, grupo, cuenta"


@register(
    "o04_centre_detail",
    f"""WITH {FACTS_CTE}, {LONG_CTE},
g AS (SELECT {_O4_KEYS}, {_piv(('R25', 'P26', 'R26'))} FROM long
      WHERE contains(CAST(centre AS VARCHAR), '12') AND sem <= 30 GROUP BY {_O4_KEYS}),
t AS (SELECT SUM(R25) AS a, SUM(P26) AS p, SUM(R26) AS r FROM g)
SELECT {_O4_KEYS}, {_sql_money(('R25', 'P26', 'R26'))}, CAST(ROUND(a, 2) AS DOUBLE) AS total_R25,
  CAST(ROUND(p, 2) AS DOUBLE) AS total_P26, CAST(ROUND(r, 2) AS DOUBLE) AS total_R26
FROM (SELECT * FROM g ORDER BY R26 DESC, {_O4_KEYS} LIMIT 20) CROSS JOIN t""",
)
def o04(spark, sf_dir):
    g = LF.centre_detail(B.facts_long(spark, sf_dir), "12", 30)
    return g.select(*_O4_KEYS.split(", "), *_money_cols(("R25", "P26", "R26", "total_R25", "total_P26", "total_R26")))


@register(
    "o05_top_centres",
    f"""WITH {FACTS_CTE}, {LONG_CTE}
SELECT pdc, centre, division, CAST(ROUND(R26, 2) AS DOUBLE) AS R26 FROM (
  SELECT pdc, centre, division, {_piv(('R26',))} FROM long WHERE sem <= 30 GROUP BY pdc, centre, division
  ORDER BY R26 DESC, pdc, centre, division LIMIT 12)""",
)
def o05(spark, sf_dir):
    g = LF.top_centres(B.facts_long(spark, sf_dir), 30, 12)
    return g.select("pdc", "centre", "division", F.round("R26", 2).cast("double").alias("R26"))


_S11_CODES = ("R25", "P26", "R26", "NVO")


def _s11_part(col, kind):
    return f"""SELECT '{kind}' AS kind, CAST({col} AS VARCHAR) AS key, {_piv(_S11_CODES)} FROM long
      WHERE {col} IS NOT NULL AND sem <= 99 GROUP BY {col}"""


@register(
    "s11_build_fast_index",
    f"""WITH {FACTS_CTE}, {LONG_CTE},
u AS ({_s11_part('division', 'division')} UNION ALL {_s11_part('grupo', 'group')} UNION ALL
      (SELECT * FROM ({_s11_part('centre', 'centre')}) ORDER BY R26 DESC, key LIMIT 500) UNION ALL {_s11_part('sem', 'week')})
SELECT kind, key, {_sql_money(_S11_CODES)} FROM u""",
)
def s11(spark, sf_dir):
    g = LF.build_fast_index(B.facts_long(spark, sf_dir), 500)
    return g.select("kind", "key", *_money_cols(_S11_CODES))


# --- questions ---------------------------------------------------------------------------------------------
_TICKETS = """q AS (SELECT CAST(c.conv_id AS VARCHAR) || '-' || CAST(c.turn AS VARCHAR) AS id,
  CASE c.conv_id % 8 WHEN 0 THEN '¿Cuánto gastó la división ' || n.n_name || ' hasta la semana ' || CAST(c.conv_id % 53 + 1 AS VARCHAR)
    WHEN 1 THEN 'Gasto del territorio ' || u.c_mktsegment || ' en la semana ' || CAST(c.conv_id % 60 + 1 AS VARCHAR)
    WHEN 2 THEN 'Detalle del ceco ' || CAST(u.c_custkey AS VARCHAR) || ' acumulado a la semana 20'
    WHEN 3 THEN 'Evolución semanal de ' || n.n_name WHEN 4 THEN 'Match de centros sin punto'
    WHEN 5 THEN 'Total del grupo ' || p.p_brand WHEN 6 THEN 'Por semana del centro ' || CAST(u.c_custkey AS VARCHAR) || ' ' || p.p_brand
    ELSE c.text END AS question
  FROM conversations c JOIN nation n ON c.conv_id % 25 = n.n_nationkey
  JOIN customer u ON u.c_custkey = 100 + c.conv_id % ((SELECT max(c_custkey) FROM customer) - 99)
  JOIN part p ON p.p_partkey = 1 + c.conv_id % (SELECT max(p_partkey) FROM part) WHERE c.role = 'user')"""


@register(
    "f05_fold_text",
    f"WITH {_TICKETS} SELECT id, {fold('question')} AS folded FROM q",
)
def f05(spark, sf_dir):
    return B.finance_questions(spark, sf_dir).select("id", QN.fold_text(F.col("question")).alias("folded"))


def _parse_sql():
    wk = f"regexp_extract(folded, '{QN.WEEK_RE}', 2)"
    ce = f"regexp_extract(folded, '{QN.CENTRE_RE}', 2)"
    valid = f"({wk} <> '' AND TRY_CAST({wk} AS INTEGER) >= 1 AND TRY_CAST({wk} AS INTEGER) <= 53)"
    weekly = " OR ".join(f"contains(folded, '{k}')" for k in QN.WEEKLY_KEYWORDS)
    return f"""p0 AS (SELECT id, {fold('question')} AS folded FROM q),
p AS (SELECT id, folded, CASE WHEN {valid} THEN TRY_CAST({wk} AS INTEGER) ELSE 30 END AS cut,
        {valid} AS cumulative, ({weekly}) AS weekly, CASE WHEN {ce} <> '' THEN {ce} END AS centre_id FROM p0)"""


@register("f10_parse_questions", f"WITH {_TICKETS}, {_parse_sql()} SELECT id, folded, cut, cumulative, weekly, centre_id FROM p")
def f10(spark, sf_dir):
    p = QN.parse_questions(B.finance_questions(spark, sf_dir), "question", B.SMR)
    return p.select("id", "folded", "cut", "cumulative", "weekly", "centre_id")


def _tokens_sql(src, generic):
    gen = ", ".join(f"'{w}'" for w in generic)
    return f"""(SELECT name, ord, tok FROM (
    SELECT name, ord, unnest(regexp_split_to_array({fold('name')}, '\\s+')) AS tok FROM (
      SELECT name, dense_rank() OVER (ORDER BY name) AS ord FROM (SELECT DISTINCT {src}) WHERE name IS NOT NULL))
  WHERE length(tok) > 3 AND tok NOT IN ({gen}))"""


def _entities_sql():
    syn = ", ".join(f"({i}, '{k}', '{s}')" for i, (k, ss) in enumerate(QN.GROUP_SYNONYMS) for s in ss)
    return f"""dt AS {_tokens_sql('n_name AS name FROM nation', QN.GENERIC_DIVISION_WORDS)},
tt AS {_tokens_sql('c_mktsegment AS name FROM customer', QN.GENERIC_TERRITORY_WORDS)},
gg AS (SELECT name, dense_rank() OVER (ORDER BY name) AS ord, {fold('name')} AS tok FROM (SELECT DISTINCT p_brand AS name FROM part)),
syn(key_ord, key, syn) AS (VALUES {syn}),
dh AS (SELECT p.id, arg_min(dt.name, dt.ord) AS division FROM p JOIN dt ON instr(p.folded, dt.tok) > 0 GROUP BY p.id),
th AS (SELECT p.id, arg_min(tt.name, tt.ord) AS territory FROM p JOIN tt ON instr(p.folded, tt.tok) > 0 GROUP BY p.id),
gh AS (SELECT p.id, arg_min(gg.name, gg.ord) AS g_name FROM p JOIN gg ON instr(p.folded, gg.tok) > 0 GROUP BY p.id),
kh AS (SELECT DISTINCT p.id, syn.key, syn.key_ord FROM p JOIN syn ON instr(p.folded, syn.syn) > 0),
kg AS (SELECT key, arg_min(name, ord) AS s_name FROM (
         SELECT syn.key, gg.ord, gg.name FROM syn JOIN gg ON instr(gg.tok, syn.syn) > 0
         UNION ALL SELECT k.key, gg.ord, gg.name FROM (SELECT DISTINCT key FROM syn) k JOIN gg ON instr(gg.tok, k.key) > 0)
       GROUP BY key),
sh AS (SELECT kh.id, arg_min(kg.s_name, kh.key_ord) AS s_name FROM kh JOIN kg ON kh.key = kg.key GROUP BY kh.id),
e AS (SELECT p.*, dh.division, th.territory, coalesce(gh.g_name, sh.s_name) AS grupo FROM p
      LEFT JOIN dh ON p.id = dh.id LEFT JOIN th ON p.id = th.id LEFT JOIN gh ON p.id = gh.id LEFT JOIN sh ON p.id = sh.id)"""


@register(
    "f11_detect_entities",
    f"WITH {_TICKETS}, {_parse_sql()}, {_entities_sql()} SELECT id, division, territory, grupo FROM e",
)
def f11(spark, sf_dir):
    p = QN.parse_questions(B.finance_questions(spark, sf_dir), "question", B.SMR)
    t = lambda n: B.table(spark, sf_dir, n)
    e = QN.detect_entities(
        p,
        t("nation").select(F.col("n_name").alias("division")),
        t("customer").select(F.col("c_mktsegment").alias("territorio")),
        t("part").select(F.col("p_brand").alias("grupo")),
    )
    return e.select("id", "division", "territory", "grupo")


def _route_sql():
    match = " OR ".join(f"contains(folded, '{k}')" for k in QN.MATCH_KEYWORDS)
    return f"""CASE WHEN weekly THEN 'weekly' WHEN centre_id IS NOT NULL THEN 'centre' WHEN {match} THEN 'match'
  WHEN division IS NOT NULL THEN 'division' WHEN territory IS NOT NULL THEN 'territory'
  WHEN grupo IS NOT NULL THEN 'group' ELSE 'general' END"""


@register(
    "f12_answer_questions",
    f"""WITH {FACTS_CTE}, {LONG_CTE}, {_TICKETS}, {_parse_sql()}, {_entities_sql()},
r AS (SELECT *, {_route_sql()} AS route FROM e),
s AS (SELECT id, route, cut,
        CASE WHEN route IN ('weekly', 'division') THEN division END AS division_f,
        CASE WHEN route = 'territory' THEN territory END AS territorio_f,
        CASE WHEN route IN ('weekly', 'centre', 'division', 'territory', 'group') THEN grupo END AS grupo_f,
        CASE WHEN route IN ('weekly', 'centre') THEN TRY_CAST(centre_id AS BIGINT) END AS centre_f FROM r),
a AS (SELECT s.id, s.route, s.cut, s.division_f, s.territorio_f, s.grupo_f, s.centre_f,
        coalesce(SUM(CASE WHEN l.serie = 'R25' THEN l.monto ELSE {_Z} END), {_Z}) AS R25,
        coalesce(SUM(CASE WHEN l.serie = 'P26' THEN l.monto ELSE {_Z} END), {_Z}) AS P26,
        coalesce(SUM(CASE WHEN l.serie = 'R26' THEN l.monto ELSE {_Z} END), {_Z}) AS R26
      FROM s LEFT JOIN long l ON l.sem <= s.cut
        AND (s.division_f IS NULL OR l.division = s.division_f) AND (s.territorio_f IS NULL OR l.territorio = s.territorio_f)
        AND (s.grupo_f IS NULL OR l.grupo = s.grupo_f) AND (s.centre_f IS NULL OR l.centre = s.centre_f)
      GROUP BY 1, 2, 3, 4, 5, 6, 7)
SELECT id, route, cut, division_f AS division, territorio_f AS territorio, grupo_f AS grupo, centre_f AS centre,
  {_sql_money(('R25', 'P26', 'R26'))}, CAST(ROUND(R26 - P26, 2) AS DOUBLE) AS vs_plan FROM a""",
)
def f12(spark, sf_dir):
    p = QN.parse_questions(B.finance_questions(spark, sf_dir), "question", B.SMR)
    t = lambda n: B.table(spark, sf_dir, n)
    e = QN.detect_entities(
        p,
        t("nation").select(F.col("n_name").alias("division")),
        t("customer").select(F.col("c_mktsegment").alias("territorio")),
        t("part").select(F.col("p_brand").alias("grupo")),
    )
    wide = {"R25": "real_py", "P26": "plan", "R26": "real"}  # the long fact's series, read from the wide fact
    return QN.answer_questions(e, B.facts(spark, sf_dir), wide=wide)

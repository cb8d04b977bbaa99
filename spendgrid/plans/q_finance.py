"""Registered risk, portfolio, execution, auction and graph-cut queries and their twins
(W1, R1-R13, A22, W4-W6, G2)."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from spendgrid.operators import alloc as AL
from spendgrid.operators import execution as EX
from spendgrid.operators import graphcut as GC
from spendgrid.operators import risk as RK
from spendgrid.plans import bindings as B
from spendgrid.plans.registry import register

Z = NormalDist().inv_cdf(0.05)

PRICES = """prices AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, o_orderpriority AS asset,
    CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS price FROM orders GROUP BY 1, 2)"""
RET = f"""{PRICES},
cd AS (SELECT date FROM prices GROUP BY date HAVING COUNT(DISTINCT asset) = (SELECT COUNT(DISTINCT asset) FROM prices)),
r0 AS (SELECT p.date, p.asset, ln(p.price / lag(p.price) OVER (PARTITION BY p.asset ORDER BY p.date)) AS ret
       FROM prices p JOIN cd ON p.date = cd.date),
ret AS (SELECT * FROM r0 WHERE ret IS NOT NULL)"""
EQW = "eqw AS (SELECT DISTINCT asset, 1.0 / (SELECT COUNT(DISTINCT asset) FROM ret) AS w FROM ret)"
PORT = "port AS (SELECT date, SUM(w * ret) AS ret FROM ret JOIN eqw ON ret.asset = eqw.asset GROUP BY date)"


def _ret(spark, sf_dir):
    return RK.log_returns(B.prices(spark, sf_dir))


@register("w01_log_returns", f"WITH {RET} SELECT date, asset, round(ret, 10) AS ret FROM ret")
def w01(spark, sf_dir):
    return _ret(spark, sf_dir).select("date", "asset", F.round("ret", 10).alias("ret"))


@register("r01_var_historical", f"WITH {RET} SELECT asset, round(quantile_cont(ret, 0.05), 10) AS var_hist FROM ret GROUP BY asset")
def r01(spark, sf_dir):
    return RK.var_historical(_ret(spark, sf_dir)).select("asset", F.round("var_hist", 10).alias("var_hist"))


@register(
    "r02_var_parametric",
    f"WITH {RET} SELECT asset, round(avg(ret) + {Z!r} * stddev_samp(ret), 10) AS var_param FROM ret GROUP BY asset",
)
def r02(spark, sf_dir):
    return RK.var_parametric(_ret(spark, sf_dir)).select("asset", F.round("var_param", 10).alias("var_param"))


_VH = "vh AS (SELECT asset, quantile_cont(ret, 0.05) AS var_hist FROM ret GROUP BY asset)"


@register(
    "r03_cvar",
    f"""WITH {RET}, {_VH}
SELECT ret.asset, round(avg(ret.ret), 10) AS cvar FROM ret JOIN vh ON ret.asset = vh.asset WHERE ret.ret <= vh.var_hist
GROUP BY ret.asset""",
)
def r03(spark, sf_dir):
    r = _ret(spark, sf_dir)
    return RK.cvar(r, RK.var_historical(r), "var_hist").select("asset", F.round("cvar", 10).alias("cvar"))


@register(
    "r04_risk_table",
    f"""WITH {RET}, {_VH},
b AS (SELECT asset, avg(ret) AS mean, stddev_samp(ret) AS sd, avg(ret) + {Z!r} * stddev_samp(ret) AS var_param FROM ret GROUP BY asset),
cv AS (SELECT ret.asset, avg(ret.ret) AS cvar FROM ret JOIN vh ON ret.asset = vh.asset WHERE ret.ret <= vh.var_hist GROUP BY ret.asset)
SELECT b.asset, round(mean, 10) AS mean, round(sd, 10) AS sd, round(var_hist, 10) AS var_hist, round(var_param, 10) AS var_param,
  round(cvar, 10) AS cvar FROM b JOIN vh ON b.asset = vh.asset LEFT JOIN cv ON b.asset = cv.asset""",
)
def r04(spark, sf_dir):
    return RK.risk_table(_ret(spark, sf_dir))


@register(
    "r05_portfolio_risk",
    f"""WITH {RET}, {EQW}, {PORT},
s AS (SELECT avg(ret) AS mean, stddev_samp(ret) AS sd, quantile_cont(ret, 0.05) AS var_hist,
        avg(ret) + {Z!r} * stddev_samp(ret) AS var_param FROM port)
SELECT round(mean, 10) AS mean, round(sd, 10) AS sd, round(var_hist, 10) AS var_hist, round(var_param, 10) AS var_param,
  round((SELECT avg(ret) FROM port WHERE ret <= s.var_param), 10) AS cvar FROM s""",
)
def r05(spark, sf_dir):
    r = _ret(spark, sf_dir)
    return RK.portfolio_risk(r, RK.equal_weights(r))


COV = """cov AS (SELECT a.asset AS asset_i, b.asset AS asset_j, round(covar_samp(a.ret, b.ret), 12) AS cov,
    round(corr(a.ret, b.ret), 10) AS corr FROM ret a JOIN ret b ON a.date = b.date GROUP BY a.asset, b.asset)"""


COV_RAW = """covr AS (SELECT a.asset AS asset_i, b.asset AS asset_j, covar_samp(a.ret, b.ret) AS cov
    FROM ret a JOIN ret b ON a.date = b.date GROUP BY a.asset, b.asset)"""


@register("r06_cov_corr_matrix", f"WITH {RET}, {COV} SELECT * FROM cov")
def r06(spark, sf_dir):
    return RK.cov_corr_matrix(_ret(spark, sf_dir))


@register(
    "r07_vol_comparison",
    f"""WITH {RET}, {EQW}, {PORT}
SELECT asset, round(stddev_samp(ret), 10) AS sd FROM ret GROUP BY asset
UNION ALL SELECT 'portfolio', round(stddev_samp(ret), 10) FROM port""",
)
def r07(spark, sf_dir):
    r = _ret(spark, sf_dir)
    return RK.vol_comparison(r, RK.equal_weights(r))


@register(
    "r08_histogram",
    f"""WITH {RET},
mm AS (SELECT asset, min(ret) AS lo, max(ret) AS hi FROM ret GROUP BY asset),
c AS (SELECT ret.asset, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((ret - lo) / ((hi - lo) / 50)), 49) END AS INTEGER) AS bin,
        COUNT(*) AS n FROM ret JOIN mm ON ret.asset = mm.asset GROUP BY 1, 2),
g AS (SELECT mm.*, CAST(b.i AS INTEGER) AS bin FROM mm CROSS JOIN range(0, 50) b(i))
SELECT g.asset, g.bin, round(lo + g.bin * ((hi - lo) / 50), 10) AS bin_lo, round(lo + (g.bin + 1) * ((hi - lo) / 50), 10) AS bin_hi,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM g LEFT JOIN c ON g.asset = c.asset AND g.bin = c.bin""",
)
def r08(spark, sf_dir):
    return RK.histogram(_ret(spark, sf_dir), "ret", 50)


@register(
    "r09_shrink_cov",
    f"""WITH {RET}, {COV},
s AS (SELECT COUNT(DISTINCT asset_i) AS n, SUM(CASE WHEN asset_i = asset_j THEN cov END) AS trs, SUM(cov * cov) AS trss FROM cov),
a AS (SELECT *, greatest(0.0, least(1.0, (trs / n - trss / n) / greatest((1 + 1 / n) * (trs / n) - trss / n, 1e-8))) AS alpha FROM s)
SELECT asset_i, asset_j, round((1 - alpha) * cov + alpha * CASE WHEN asset_i = asset_j THEN trs / n ELSE 0.0 END, 12) AS cov_shrunk,
  round(alpha, 10) AS alpha FROM cov CROSS JOIN a""",
)
def r09(spark, sf_dir):
    return RK.shrink_cov(RK.cov_corr_matrix(_ret(spark, sf_dir)))


@register(
    "r10_score_portfolios",
    f"""WITH {RET}, {COV_RAW},
cw0 AS (SELECT o_custkey AS portfolio, o_orderpriority AS asset, COUNT(*) AS n FROM orders GROUP BY 1, 2),
cw AS (SELECT portfolio, asset, n / SUM(n) OVER (PARTITION BY portfolio) AS w FROM cw0),
mu AS (SELECT asset, avg(ret) AS mu FROM ret GROUP BY asset),
pr AS (SELECT portfolio, SUM(w * mu) AS ret FROM cw JOIN mu ON cw.asset = mu.asset GROUP BY portfolio),
pv AS (SELECT a.portfolio, SUM(a.w * b.w * covr.cov) AS var FROM cw a JOIN cw b ON a.portfolio = b.portfolio
         JOIN covr ON covr.asset_i = a.asset AND covr.asset_j = b.asset GROUP BY a.portfolio),
s AS (SELECT pr.portfolio, pr.ret, pv.var, (pr.ret - 0.02) / sqrt(pv.var + 1e-8) AS sharpe FROM pr JOIN pv ON pr.portfolio = pv.portfolio),
lim AS (SELECT min(ret) AS lo, max(ret) AS hi FROM s),
b AS (SELECT s.*, CAST(CASE WHEN (hi - lo) / 20 = 0 THEN 0 ELSE least(floor((ret - lo) / ((hi - lo) / 20)), 19) END AS INTEGER) AS bucket
      FROM s CROSS JOIN lim),
best AS (SELECT bucket, arg_min(portfolio, (round(var, 10), portfolio)) AS portfolio FROM b GROUP BY bucket)
SELECT b.portfolio, round(b.ret, 10) AS ret, round(b.var, 10) AS var, round(b.sharpe, 6) AS sharpe, b.bucket,
  best.portfolio IS NOT NULL AS on_frontier
FROM b LEFT JOIN best ON b.bucket = best.bucket AND b.portfolio = best.portfolio""",
)
def r10(spark, sf_dir):
    return RK.score_portfolios(B.candidate_weights(spark, sf_dir), _ret(spark, sf_dir), 20)


@register(
    "r11_evaluate_weights",
    f"""WITH {RET}, {EQW}, {PORT},
g AS (SELECT avg(ret) AS m, stddev_pop(ret) AS v FROM port),
h AS (SELECT *, CASE WHEN v > 0 THEN (m - 0.02 / 252) / v ELSE 0.0 END AS sh FROM g)
SELECT round(m, 10) AS mean, round(v, 10) AS vol, round(sh, 8) AS sharpe, round(m * 252, 10) AS mean_annual,
  round(v * sqrt(252.0), 10) AS vol_annual, round(sh * sqrt(252.0), 8) AS sharpe_annual FROM h""",
)
def r11(spark, sf_dir):
    r = _ret(spark, sf_dir)
    return RK.evaluate_weights(r, RK.equal_weights(r))


@register(
    "a22_describe_by",
    f"""WITH {RET}
SELECT asset, COUNT(ret) AS count, round(avg(ret), 10) AS mean, round(stddev_samp(ret), 10) AS std, round(min(ret), 10) AS min,
  round(quantile_cont(ret, 0.25), 10) AS q25, round(quantile_cont(ret, 0.5), 10) AS q50, round(quantile_cont(ret, 0.75), 10) AS q75,
  round(max(ret), 10) AS max FROM ret GROUP BY asset""",
)
def a22(spark, sf_dir):
    return RK.describe_by(_ret(spark, sf_dir), "asset", "ret")


SCHED = """q AS (SELECT o.o_orderpriority AS asset, CAST(SUM(CAST(l.l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS Q
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1),
sched AS (SELECT asset, Q, CAST(r.i AS INTEGER) AS i, k.kind,
    CASE WHEN k.kind = 'uniform' THEN Q / 50 WHEN k.kind = 'rising' THEN (r.i + 1) / 50 / 25.5 * Q
         ELSE (1 - r.i / 50) / 25.5 * Q END AS v
  FROM q CROSS JOIN range(0, 50) r(i) CROSS JOIN (VALUES ('uniform'), ('rising'), ('falling')) k(kind))"""


def _sched(spark, sf_dir):
    return EX.schedules(B.order_quantities(spark, sf_dir), 50)


@register("r12_schedules", f"WITH {SCHED} SELECT asset, kind, i, round(v, 6) AS v FROM sched")
def r12(spark, sf_dir):
    return _sched(spark, sf_dir).select("asset", "kind", "i", F.round("v", 6).alias("v"))


@register(
    "w04_execution_path",
    f"""WITH {SCHED}
SELECT asset, kind, i, round(v, 6) AS v,
  round(SUM(v) OVER (PARTITION BY asset, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS x_cum,
  round(100.0 + 1e-6 * v * (i + 1), 9) AS price FROM sched""",
)
def w04(spark, sf_dir):
    return EX.execution_path(_sched(spark, sf_dir))


_GAMMAS = ", ".join(f"({g!r})" for g in EX.GAMMA_GRID)


@register(
    "r13_schedule_cost",
    f"""WITH {SCHED},
g0 AS (SELECT asset, kind, Q, SUM(1e-5 * pow(abs(v), 1.5)) AS temp, SUM(v) AS sv FROM sched GROUP BY asset, kind, Q),
g AS (SELECT g0.*, gm.gamma, temp + gm.gamma * sv + 1e-6 * pow(Q - sv, 2) AS cost FROM g0 CROSS JOIN (VALUES {_GAMMAS}) gm(gamma)),
b AS (SELECT *, min(cost) OVER (PARTITION BY asset, gamma) AS best FROM g)
SELECT asset, kind, round(gamma, 15) AS gamma, round(cost, 6) AS cost, round((cost - best) / cost * 100, 6) AS saving_pct FROM b""",
)
def r13(spark, sf_dir):
    return EX.schedule_cost(_sched(spark, sf_dir))


BIDS = """bids AS (SELECT p_brand AS auction, p_partkey AS agent, CAST(p_retailprice AS DECIMAL(18,2)) AS bid FROM part),
tot AS (SELECT auction, SUM(bid) * CAST(0.5 AS DECIMAL(2,1)) AS total FROM bids GROUP BY auction),
al AS (SELECT b.*, tot.total,
    coalesce(SUM(bid) OVER (PARTITION BY b.auction ORDER BY bid DESC, agent ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS higher
  FROM bids b JOIN tot ON b.auction = tot.auction),
alloc AS (SELECT *, greatest(0.0, least(bid, total - higher)) AS alloc FROM al)"""


@register(
    "w05_allocate_by_bid",
    f"""WITH {BIDS}
SELECT auction, agent, CAST(bid AS DOUBLE) AS bid, CAST(higher AS DOUBLE) AS higher, CAST(alloc AS DOUBLE) AS alloc FROM alloc""",
)
def w05(spark, sf_dir):
    b, totals = B.bids(spark, sf_dir)
    a = AL.allocate_by_bid(b, totals)
    return a.select("auction", "agent", *[F.col(c).cast("double").alias(c) for c in ("bid", "higher", "alloc")])


@register(
    "w06_auction_prices",
    f"""WITH {BIDS},
rk AS (SELECT auction, agent, bid, ROW_NUMBER() OVER (PARTITION BY auction ORDER BY bid DESC, agent) AS r FROM bids),
tops AS (SELECT auction, max(CASE WHEN r = 1 THEN agent END) AS top_agent, max(CASE WHEN r = 1 THEN bid END) AS b1,
           max(CASE WHEN r = 2 THEN bid END) AS b2 FROM rk WHERE r <= 2 GROUP BY auction),
wf AS (SELECT auction, SUM(alloc) AS welfare FROM alloc GROUP BY auction),
p AS (SELECT alloc.*, tops.*, wf.welfare,
        CASE WHEN alloc.alloc > 0 THEN CASE WHEN agent = top_agent THEN coalesce(b2, 0.0) ELSE b1 END ELSE 0.0 END AS price
      FROM alloc JOIN tops ON alloc.auction = tops.auction JOIN wf ON alloc.auction = wf.auction)
SELECT auction, agent, round(CAST(bid AS DOUBLE), 6) AS bid, round(CAST(alloc AS DOUBLE), 6) AS alloc,
  round(CAST(price AS DOUBLE), 6) AS price, round(CAST(alloc * (bid - price) AS DOUBLE), 4) AS utility,
  round(CAST(welfare AS DOUBLE), 6) AS welfare FROM p""",
)
def w06(spark, sf_dir):
    b, totals = B.bids(spark, sf_dir)
    return AL.auction_prices(AL.allocate_by_bid(b, totals))


EDGES = """e AS (SELECT DISTINCT least(c.c_nationkey, s.s_nationkey) AS i, greatest(c.c_nationkey, s.s_nationkey) AS j
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE c.c_nationkey <> s.s_nationkey)"""


@register(
    "g02_cut_values",
    f"""WITH {EDGES},
cuts AS (SELECT k.k AS assignment, CAST(SUM(CASE WHEN ((e.i >> k.k) & 1) <> ((e.j >> k.k) & 1) THEN 1 ELSE 0 END) AS BIGINT) AS cut
         FROM e CROSS JOIN range(0, 5) k(k) GROUP BY k.k)
SELECT assignment, cut, cut = (SELECT max(cut) FROM cuts) AS best, (SELECT COUNT(*) FROM e) / 2.0 AS baseline FROM cuts""",
)
def g02(spark, sf_dir):
    e = B.edges(spark, sf_dir)
    nodes = e.select(F.col("i").alias("node")).union(e.select(F.col("j").alias("node"))).distinct()
    return GC.cut_values(e, GC.bit_assignments(nodes, 5)).withColumn("assignment", F.col("assignment").cast("bigint"))


def _best_cut_sql() -> str:
    nodes = range(25)  # the nations
    masks = ", ".join(f"coalesce(sum(1 << w) FILTER (WHERE v = {v}), 0)::BIGINT AS m{v}" for v in nodes)
    cut = " + ".join(f"((a >> {v}) & 1) * bit_count(m{v} & ~a)" for v in nodes)
    return f"""WITH {EDGES},
m AS (SELECT {masks} FROM (SELECT CAST(i AS BIGINT) AS v, CAST(j AS BIGINT) AS w FROM e UNION ALL SELECT j, i FROM e)),
cuts AS (SELECT a, {cut} AS cut FROM range(0, {1 << len(nodes)}) r(a) CROSS JOIN m)
SELECT CAST(cut AS BIGINT) AS best_cut, COUNT(*) AS n_optimal, min(a) AS first_optimal FROM cuts GROUP BY cut ORDER BY cut DESC LIMIT 1"""


@register("g02_best_cut", _best_cut_sql)
def g02b(spark, sf_dir):
    return GC.best_cut(spark, B.edges(spark, sf_dir))

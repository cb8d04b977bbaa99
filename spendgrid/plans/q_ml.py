"""Registered ML, causal and clustering queries and their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendgrid.operators import cluster as CL
from spendgrid.operators import ml as ML
from spendgrid.plans import bindings as B
from spendgrid.plans.registry import register
from spendgrid.session import cut_lineage

APPL = """li AS (SELECT l_orderkey, COUNT(*) AS n_lines, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
    CAST(SUM(CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) / COUNT(*) AS avg_disc,
    CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 + CAST(l_tax AS DECIMAL(4,2))) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS line_total
  FROM lineitem GROUP BY l_orderkey),
ap AS (SELECT o.o_orderkey AS id, o.o_orderpriority, c.c_mktsegment, c.c_acctbal, CAST(li.n_lines AS DOUBLE) AS n_lines, li.sum_qty,
    li.avg_disc, CAST(month(o.o_orderdate) AS DOUBLE) AS month, li.line_total, CAST(o.o_orderstatus = 'F' AS INTEGER) AS label,
    o.o_totalprice AS amount
  FROM orders o JOIN li ON o.o_orderkey = li.l_orderkey JOIN customer c ON o.o_custkey = c.c_custkey)"""

CATS = {  # fixed values: TPC-H order priorities and market segments (sorted)
    "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "c_mktsegment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
}
NUM = ["c_acctbal", "n_lines", "sum_qty", "avg_disc", "month"]


def _m01_sql():
    one_hot = [f"CAST({c} = '{lv}' AS DOUBLE) AS \"{c}={lv}\"" for c, lvs in CATS.items() for lv in lvs[1:]]
    z = [f"round((CAST({c} AS DOUBLE) - st.m_{c}) / CASE WHEN st.s_{c} = 0 THEN 1.0 ELSE st.s_{c} END, 8) AS z_{c}" for c in NUM]
    stats = ", ".join([f"avg({c}) AS m_{c}" for c in NUM] + [f"stddev_pop({c}) AS s_{c}" for c in NUM])
    return f"WITH {APPL}, st AS (SELECT {stats} FROM ap) SELECT id, {', '.join(one_hot + z)} FROM ap CROSS JOIN st"


@register("m01_credit_features", _m01_sql)
def m01(spark, sf_dir):
    a = B.applicants(spark, sf_dir)
    f = ML.credit_features(a, list(CATS), NUM, key="id")
    return f.select(*[F.round(c, 8).alias(c) if c.startswith("z_") else F.col(f"`{c}`") for c in f.columns])


@register(
    "m02_sequential_split",
    f"""WITH {APPL}, n AS (SELECT COUNT(*) AS n FROM ap)
SELECT id, ROW_NUMBER() OVER (ORDER BY id) - 1 AS idx,
  CASE WHEN ROW_NUMBER() OVER (ORDER BY id) - 1 < n - CAST(ceil(0.2 * n) AS BIGINT) THEN 'train' ELSE 'test' END AS split
FROM ap CROSS JOIN n""",
)
def m02(spark, sf_dir):
    return ML.sequential_split(B.applicants(spark, sf_dir).select("id"), ["id"], 0.2).select("id", "idx", "split")


def _features(spark, sf_dir):
    a = cut_lineage(B.applicants(spark, sf_dir))  # read by the levels, the scaling, the split and the features
    f = ML.credit_features(a, list(CATS), NUM, key="id")
    feats = [c for c in f.columns if c != "id"]
    s = ML.sequential_split(a.select("id", "label", "amount"), ["id"], 0.2)
    d = f.join(s, "id")
    # a fit reads its rows several times; a checkpoint keeps their order, which a forest's bags follow
    d = cut_lineage(d.toDF(*[c.replace(".", "_") for c in d.columns]))
    return d, [c.replace(".", "_") for c in feats]


@register("m03_fit_approval")
def m03(spark, sf_dir):
    d, feats = _features(spark, sf_dir)
    model = ML.fit_approval(d.filter(F.col("split") == "train"), feats, "label", 100, 42)
    pred = model.transform(d.filter(F.col("split") == "test"))
    from pyspark.ml.functions import vector_to_array

    return pred.select("id", "label", "prediction", F.round(vector_to_array("probability")[1] * 100, 4).alias("prob_pct"))


@register(
    "m04_classification_report",
    f"""WITH {APPL},
p AS (SELECT CAST(label AS DOUBLE) AS y, CAST(n_lines >= 4 AS DOUBLE) AS p FROM ap),
cl AS (SELECT y AS c FROM p UNION SELECT p FROM p),
cnt AS (SELECT y, p, COUNT(*) AS k FROM p GROUP BY y, p),
per AS (SELECT cl.c, coalesce((SELECT k FROM cnt WHERE cnt.y = cl.c AND cnt.p = cl.c), 0) AS tp,
          coalesce((SELECT SUM(k) FROM cnt WHERE cnt.y = cl.c), 0) AS support, coalesce((SELECT SUM(k) FROM cnt WHERE cnt.p = cl.c), 0) AS npred
        FROM cl),
m AS (SELECT c, support, CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END AS precision,
        CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM per),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m),
t AS (SELECT COUNT(*) AS total, avg(CAST(y = p AS DOUBLE)) AS acc FROM p)
SELECT CAST(c AS VARCHAR) AS class, round(precision, 10) AS precision, round(recall, 10) AS recall, round(f1, 10) AS f1,
  CAST(support AS DOUBLE) AS support FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 10), round(avg(recall), 10), round(avg(f1), 10), CAST(SUM(support) AS DOUBLE) FROM f
UNION ALL SELECT 'weighted avg', round(SUM(precision * support) / max(t.total), 10), round(SUM(recall * support) / max(t.total), 10),
  round(SUM(f1 * support) / max(t.total), 10), CAST(max(t.total) AS DOUBLE) FROM f CROSS JOIN t
UNION ALL SELECT 'accuracy', round(acc, 10), round(acc, 10), round(acc, 10), CAST(total AS DOUBLE) FROM t""",
)
def m04(spark, sf_dir):
    a = B.applicants(spark, sf_dir).select("label", (F.col("n_lines") >= 4).cast("int").alias("prediction"))
    r = ML.classification_report(a)
    return r.withColumn("class", F.when(F.col("class").rlike(r"^[0-9.]+$"), F.col("class").cast("double").cast("string")).otherwise(F.col("class")))


@register("m05_fit_amount")
def m05(spark, sf_dir):
    d, feats = _features(spark, sf_dir)
    d = d.withColumn("amount", F.col("amount").cast("double"))
    model = ML.fit_amount(d.filter(F.col("split") == "train"), feats, "amount", 1.0)
    pred = model.transform(d.filter(F.col("split") == "test"))
    return ML.regression_metrics(pred, "amount", "prediction")


@register(
    "m06_regression_metrics",
    f"""WITH {APPL}, mm AS (SELECT avg(amount) AS m FROM ap)
SELECT round(1 - SUM((amount - line_total) * (amount - line_total)) / SUM((amount - mm.m) * (amount - mm.m)), 8) AS r2,
  round(avg(abs(amount - line_total)), 6) AS mae FROM ap CROSS JOIN mm""",
)
def m06(spark, sf_dir):
    return ML.regression_metrics(B.applicants(spark, sf_dir), "amount", "line_total")


@register(
    "m07_decision_band",
    f"""WITH {APPL}, mx AS (SELECT max(sum_qty) AS mx FROM ap)
SELECT id, round(sum_qty / mx * 100, 6) AS prob_pct,
  CASE WHEN sum_qty / mx * 100 > 70 THEN 'likely_approve' WHEN sum_qty / mx * 100 > 40 THEN 'manual_review' ELSE 'reject' END AS band
FROM ap CROSS JOIN mx""",
)
def m07(spark, sf_dir):
    a = B.applicants(spark, sf_dir)
    mx = a.select(F.max("sum_qty")).scalar()
    prob = F.col("sum_qty") / mx * 100
    return a.select("id", F.round(prob, 6).alias("prob_pct"), ML.decision_band(prob).alias("band"))


PANEL = """pn AS (SELECT CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS y, CAST(CAST(l_discount AS DECIMAL(4,2)) AS DOUBLE) AS t,
    CAST(CAST(l_quantity AS DECIMAL(18,2)) AS DOUBLE) AS x, CAST(l_orderkey % 5 AS INTEGER) AS fold FROM lineitem)"""


def _sig(e, d=9):
    return f"CASE WHEN ({e}) = 0 THEN ({e}) ELSE round(({e}) / pow(10.0, floor(log10(abs({e})))), {d - 1}) * pow(10.0, floor(log10(abs({e})))) END"


def _fold_fit(target):
    return f"""(SELECT fold, b, (c_sy - b * c_sx) / c_n AS a FROM (
   SELECT fold, c_n, c_sx, c_sy, (c_sxy - c_sx * c_sy / c_n) / (c_sxx - c_sx * c_sx / c_n) AS b FROM (
     SELECT fold, tn - n AS c_n, tsx - sx AS c_sx, tsy - sy AS c_sy, tsxx - sxx AS c_sxx, tsxy - sxy AS c_sxy FROM (
       SELECT fold, COUNT(*) AS n, SUM(x) AS sx, SUM({target}) AS sy, SUM(x * x) AS sxx, SUM(x * {target}) AS sxy FROM pn GROUP BY fold) s
     CROSS JOIN (SELECT COUNT(*) AS tn, SUM(x) AS tsx, SUM({target}) AS tsy, SUM(x * x) AS tsxx, SUM(x * {target}) AS tsxy FROM pn) t)))"""


@register(
    "m08_double_ml",
    f"""WITH {PANEL},
fy AS {_fold_fit('y')}, ft AS {_fold_fit('t')},
r AS (SELECT pn.y - (fy.a + fy.b * pn.x) AS ry, pn.t - (ft.a + ft.b * pn.x) AS rt
      FROM pn JOIN fy ON pn.fold = fy.fold JOIN ft ON pn.fold = ft.fold),
s AS (SELECT SUM(rt * ry) AS sty, SUM(rt * rt) AS stt, COUNT(*) AS n FROM r),
e AS (SELECT avg((ry - s.sty / s.stt * rt) * (ry - s.sty / s.stt * rt)) AS e2 FROM r CROSS JOIN s)
SELECT {_sig('sty / stt')} AS tau, {_sig('sqrt(e2 / stt)')} AS se, {_sig('sty / stt - 1.96 * sqrt(e2 / stt)')} AS ci_lo,
  {_sig('sty / stt + 1.96 * sqrt(e2 / stt)')} AS ci_hi, n FROM s CROSS JOIN e""",
)
def m08(spark, sf_dir):
    return ML.double_ml(B.panel(spark, sf_dir), "y", "t", ["x"], 5, "ols1")


@register("m08_double_ml_lasso")
def m08l(spark, sf_dir):
    return ML.double_ml(B.panel(spark, sf_dir), "y", "t", ["x", "x2"], 5, "lasso")


@register("m08_double_ml_forest")
def m08f(spark, sf_dir):
    return ML.double_ml(B.panel(spark, sf_dir), "y", "t", ["x", "x2"], 5, "forest")


@register(
    "m09_naive_ols",
    f"""WITH {PANEL}, g AS (SELECT covar_pop(t, y) AS sty, covar_pop(x, y) AS sxy, var_pop(t) AS stt, var_pop(x) AS sxx,
  covar_pop(t, x) AS stx FROM pn)
SELECT {_sig('(sxx * sty - stx * sxy) / (stt * sxx - stx * stx)')} AS ols_t FROM g""",
)
def m09(spark, sf_dir):
    return ML.naive_ols(B.panel(spark, sf_dir), "y", "t", "x")


@register("m09_naive_lasso")
def m09l(spark, sf_dir):
    return ML.naive_lasso(B.panel(spark, sf_dir), "y", "t", ["x", "x2"])


# fixed values: the sparse signal (5 non-zeros) planted for the recovery test
TRUE_COEF = {0: 1.0, 13: -2.0, 26: 3.0, 39: -4.0, 52: 5.0}


def _planted(spark, sf_dir):
    """The embeddings as columns, ``y`` from the planted coefficients, a fold; and the columns' names."""
    e = B.table(spark, sf_dir, "embeddings")
    xs = [f"f{i}" for i in range(64)]
    wide = e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(64)])
    y = sum(F.col(f"f{i}") * c for i, c in TRUE_COEF.items())
    return wide.withColumn("y", y).withColumn("fold", F.col("vec_id") % 5), xs


def _score(spark, w):
    est = spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "feature int, coef double")
    return ML.recovery_score(spark.createDataFrame(list(TRUE_COEF.items()), "feature int, coef double"), est)


@register("m10_sparse_recovery")
def m10(spark, sf_dir):
    wide, xs = _planted(spark, sf_dir)
    return _score(spark, ML.sparse_fit(wide, "y", xs))


# the pursuit has to find the planted coefficients themselves
@register(
    "m10_omp_recovery",
    f"""SELECT CAST(0 AS DOUBLE) AS rel_l2_error, CAST({len(TRUE_COEF)} AS BIGINT) AS nnz_est, CAST({len(TRUE_COEF)} AS BIGINT) AS nnz_true
FROM embeddings HAVING COUNT(*) >= 64""",
)
def m10_omp(spark, sf_dir):
    wide, xs = _planted(spark, sf_dir)
    return _score(spark, ML.matching_pursuit(wide, "y", xs, 2 * len(TRUE_COEF)))


def _dp_means(points, times):
    """Cluster sizes, K and passes; lambda by rule, ``times`` the mean squared distance to the global mean."""
    spread = points.select(F.posexplode("vec").alias("i", "v")).groupBy("i").agg(F.var_pop("v").alias("s"))
    assigned, hist = CL.dp_means(points, times * spread.agg(F.sum("s")).first()[0])
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return sizes.withColumn("k_final", F.lit(hist[-1])).withColumn("passes", F.lit(len(hist)))


@register("g01_dp_means")
def g01(spark, sf_dir):
    return _dp_means(B.vectors(spark, sf_dir), 1.0)


@register("g01_dp_means_customers")
def g01c(spark, sf_dir):
    return _dp_means(B.customer_points(spark, sf_dir), 1.0)

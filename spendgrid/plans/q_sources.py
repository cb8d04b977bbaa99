"""Registered source/sink and tracker queries and their twins (S1-S3, S6, S8-S10, S12,
J5, A19)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendgrid.functions.calendar import fiscal_week
from spendgrid.functions.measures import MEASURES
from spendgrid.operators import grains as G
from spendgrid.operators import longfact as LF
from spendgrid.operators import rollup as R
from spendgrid.operators import refresh as RF
from spendgrid.operators import snapshots as SN
from spendgrid.operators import tracker as TR
from spendgrid.plans import bindings as B
from spendgrid.plans.sqlparts import FACTS_CTE, LONG_CTE
from spendgrid.session import scratch_path
from spendgrid.sources import io as IO
from spendgrid.plans.registry import register, twin

_M = ", ".join(f"CAST(SUM({m}) AS DOUBLE) AS {m}" for m in MEASURES)


def _grains(spark, sf_dir):
    leaf = B.facts(spark, sf_dir)
    spec = {"division": ["agrupa1", "division"], "territorio": ["agrupa1", "division", "territorio"]}
    base = scratch_path(spark, "grains")
    G.write_grains(leaf, spec, base)
    return base


@register("s10_build_grains", f"WITH {FACTS_CTE} SELECT sem, agrupa1, division, territorio, {_M} FROM facts GROUP BY 1, 2, 3, 4")
def s10(spark, sf_dir):
    g = IO.read_grain(spark, _grains(spark, sf_dir), "territorio")
    return g.select("sem", "agrupa1", "division", "territorio", *[F.col(m).cast("double").alias(m) for m in MEASURES])


@register(
    "s01_read_grain",
    f"WITH {FACTS_CTE} SELECT sem, division, {_M} FROM facts WHERE agrupa1 = 'EUROPE' GROUP BY sem, division",
)
def s01(spark, sf_dir):
    g = IO.read_grain(spark, _grains(spark, sf_dir), "division")
    return g.filter(F.col("agrupa1") == "EUROPE").select("sem", "division", *[F.col(m).cast("double").alias(m) for m in MEASURES])


@register(
    "s02_register_view",
    f"WITH {FACTS_CTE} SELECT division, CAST(ROUND(SUM(real), 2) AS DOUBLE) AS real FROM facts WHERE sem <= 30 GROUP BY division",
)
def s02(spark, sf_dir):
    IO.register_view(B.facts(spark, sf_dir), "facts_v")
    return spark.sql("SELECT division, CAST(ROUND(SUM(real), 2) AS DOUBLE) AS real FROM facts_v WHERE sem <= 30 GROUP BY division")


CUST_SCHEMA = T.StructType(
    [T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
     T.StructField("c_mktsegment", T.StringType()), T.StructField("c_acctbal", T.DoubleType())]
)


@register("s03_read_clean_csv", "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
def s03(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    padded = c.select(*[F.concat(F.lit("  "), F.col(x).cast("string"), F.lit(" ")).alias(f" {x}  ") for x in c.columns])
    path = scratch_path(spark, "csv")
    (padded.write.option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return IO.read_clean_csv(spark, path, CUST_SCHEMA)


@register(
    "s06_read_text_corpus",
    "SELECT 'lang=' || lang AS dir, CAST(SUM(length(replace(text, chr(65533), '')) + 1) AS BIGINT) AS n_chars FROM documents GROUP BY lang",
)
def s06(spark, sf_dir):
    root = scratch_path(spark, "corpus")
    d = B.table(spark, sf_dir, "documents")
    d.select("lang", "text").write.partitionBy("lang").text(root)
    d.select("text").write.text(os.path.join(root, "aggs"))  # an ignored folder
    c = IO.read_text_corpus(spark, root, exts=(".txt",), ignore=("aggs",))
    return c.groupBy(F.split("path", "/")[0].alias("dir")).agg(F.sum(F.length("text")).alias("n_chars"))


@register(
    "s08_export_csv",
    f"""WITH {FACTS_CTE}
SELECT CAST(n.n_nationkey AS VARCHAR) || ' · ' || f.division AS division,
  round(CAST(ROUND(SUM(real_py), 2) AS DOUBLE), 2) AS real_py, round(CAST(ROUND(SUM(plan), 2) AS DOUBLE), 2) AS plan,
  round(CAST(ROUND(SUM(new_plan), 2) AS DOUBLE), 2) AS new_plan, round(CAST(ROUND(SUM(real), 2) AS DOUBLE), 2) AS real
FROM facts f JOIN nation n ON f.division = n.n_name WHERE sem <= 30 GROUP BY n.n_nationkey, f.division""",
)
def s08(spark, sf_dir):
    y = R.ytd(B.facts(spark, sf_dir), ["division"], B.SMR)
    n = B.table(spark, sf_dir, "nation").select(F.col("n_name").alias("division"), "n_nationkey")
    path = scratch_path(spark, "export")
    IO.export_csv(y.join(n, "division").drop("n_nationkey").join(n, "division"), path, {"division": "n_nationkey"})
    schema = T.StructType([T.StructField("division", T.StringType())] + [T.StructField(m, T.DoubleType()) for m in MEASURES]
                          + [T.StructField("n_nationkey", T.IntegerType())])
    back = spark.read.option("header", True).schema(schema).csv(path)
    return back.select("division", *MEASURES)


@register("s09_export_report_json")
def s09(spark, sf_dir):
    path = scratch_path(spark, "report")
    IO.export_report_json(B.facts(spark, sf_dir).filter(F.col("yr") == B.CURRENT_YEAR), path, B.SMR)
    return spark.read.json(path)


@register("s12_cached_aggregate", lambda: twin("j02_attach_catalog"))
def s12(spark, sf_dir):
    real, _ = B.snapshots(spark, sf_dir)
    cat = SN.clean_catalog(B.account_catalog(spark, sf_dir))
    src = scratch_path(spark, "snap-src")
    real.write.parquet(src)
    target = scratch_path(spark, "snap-cache")

    def build():
        a = SN.snapshot_aggregate(spark.read.parquet(src), cat, "amount")
        return a.select("snapshot", "grupo", "cuenta", F.round("amount", 2).cast("double").alias("amount"))

    SN.cached_aggregate(build, [src], target, spark)  # builds
    return SN.cached_aggregate(build, [src], target, spark)  # reuses: the source is not newer


@register(
    "s12_refreshed_aggregate",
    """SELECT l_returnflag, l_linestatus, SUM(CAST(l_quantity AS BIGINT)) AS qty, COUNT(*) AS n
FROM lineitem WHERE l_orderkey % 4 <> 1 GROUP BY ALL""",
)
def s12_refresh(spark, sf_dir):
    """Three folders of line items arrive, one of them in part; then one gets other rows and one all of its own."""
    li = B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("bigint").alias("qty"), F.lit(1).cast("bigint").alias("n"))
    src, target = scratch_path(spark, "refresh-src"), scratch_path(spark, "refresh-sums")

    def arrive(part, rows):
        rows.write.mode("overwrite").parquet(f"{src}/{part}")

    def refresh():
        return RF.refresh_aggregate(spark, src, target, ["l_returnflag", "l_linestatus"], ["qty", "n"], li.schema)

    of = lambda r: li.filter(F.col("l_orderkey") % 4 == r)
    for r in (0, 1, 2):
        arrive(f"p{r}", of(r).limit(10) if r == 2 else of(r))
    refresh()
    arrive("p1", of(3))  # other rows in place of its own
    arrive("p2", of(2))
    return refresh().aggregate


# --- tracker ----------------------------------------------------------------------------------
_ECO = "CASE WHEN c_acctbal < 0 THEN c_name WHEN c_acctbal > 5000 THEN CAST(c_custkey AS VARCHAR) || '.0' ELSE CAST(c_custkey AS VARCHAR) END"


@register(
    "j05_attach_spend",
    f"""WITH {FACTS_CTE}, {LONG_CTE},
sp AS (SELECT pdc, coalesce(SUM(CASE WHEN serie = 'R25' THEN monto END), 0) AS R25,
         coalesce(SUM(CASE WHEN serie = 'P26' THEN monto END), 0) AS P26, coalesce(SUM(CASE WHEN serie = 'R26' THEN monto END), 0) AS R26
       FROM long GROUP BY pdc),
t AS (SELECT c_custkey AS project, {_ECO} AS eco FROM customer),
j AS (SELECT t.project, t.eco, c.c_name AS pdc FROM t LEFT JOIN customer c
        ON c.c_custkey = CASE WHEN NOT isnan(TRY_CAST(trim(t.eco) AS DOUBLE)) THEN TRY_CAST(TRY_CAST(trim(t.eco) AS DOUBLE) AS BIGINT) END)
SELECT j.project, j.eco, j.pdc, CAST(ROUND(coalesce(R25, 0), 2) AS DOUBLE) AS R25, CAST(ROUND(coalesce(P26, 0), 2) AS DOUBLE) AS P26,
  CAST(ROUND(coalesce(R26, 0), 2) AS DOUBLE) AS R26, CAST(ROUND(coalesce(R26, 0) - coalesce(P26, 0), 2) AS DOUBLE) AS delta
FROM j LEFT JOIN sp ON j.pdc = sp.pdc""",
)
def j05(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer")
    eco = (F.when(F.col("c_acctbal") < 0, F.col("c_name"))
           .when(F.col("c_acctbal") > 5000, F.concat(F.col("c_custkey").cast("string"), F.lit(".0")))
           .otherwise(F.col("c_custkey").cast("string")))
    tracker = c.select(F.col("c_custkey").alias("project"), eco.alias("eco"))
    catalog = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    spend = LF.pivot_wide(B.facts_long(spark, sf_dir), "pdc", ("R25", "P26", "R26")).withColumnRenamed("pdc", "name")
    j = TR.attach_spend(tracker, catalog, spend)
    return j.select("project", "eco", "pdc", *[F.round(c, 2).cast("double").alias(c) for c in ("R25", "P26", "R26", "delta")])


@register(
    "a19_tracker_summary",
    """WITH o AS (SELECT c.c_mktsegment AS project, CAST(datediff('day', make_date(1998, 1, 1) - CAST(dayofweek(make_date(1998, 1, 1)) AS INTEGER),
                CAST(o.o_orderdate AS DATE)) // 7 + 1 AS INTEGER) AS sem
           FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE year(o.o_orderdate) = 1998),
s AS (SELECT project, CAST(COUNT(*) * (28 + length(project) % 4) // 53 AS BIGINT) AS plan, SUM(CASE WHEN sem <= 30 THEN 1 ELSE 0 END) AS current FROM o GROUP BY project)
SELECT project, plan, CAST(current AS BIGINT) AS current, CAST(current - plan AS BIGINT) AS delta,
  CASE WHEN current - plan > 0 THEN 'alza' ELSE 'baja' END AS direction FROM s""",
)
def a19(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").filter(F.year("o_orderdate") == B.CURRENT_YEAR)
    c = B.table(spark, sf_dir, "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("project"), fiscal_week(F.col("o_orderdate")).alias("sem"))
    s = j.groupBy("project").agg(F.expr("count(1) * (28 + length(project) % 4) div 53").alias("plan"),  # the year's orders, pro rata
                                 
                                 F.sum(F.when(F.col("sem") <= B.SMR, 1).otherwise(0)).cast("bigint").alias("current"))
    return TR.tracker_summary(s)

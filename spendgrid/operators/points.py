"""Point (contact-centre) reports: deviation KPIs and histogram, top lists, label order,
multi-source point search (A17, A18, O2, O3, O6, U2).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_bottom(df: DataFrame, col: str, keys: list[str], n: int = 25) -> DataFrame:
    """O2: top ``n`` and bottom ``n`` live rows by ``col`` (ties by ``keys``).

    Each side is a ``TakeOrderedAndProject`` (per-partition top-n then merge), so only
    2n rows ever meet in one task; ``rank`` is numbered over those rows only.
    """
    live = df.filter((F.col("plan") != 0) | (F.col("real") != 0))
    top = live.orderBy(F.col(col).desc(), *keys).limit(n).withColumn("side", F.lit("top"))
    bottom = live.orderBy(F.col(col).asc(), *keys).limit(n).withColumn("side", F.lit("bottom"))
    both = top.unionByName(bottom)
    signed = F.when(F.col("side") == "top", -F.col(col)).otherwise(F.col(col))
    w = Window.partitionBy("side").orderBy(signed, *keys)
    return both.withColumn("rank", F.row_number().over(w))


def top_abs(df: DataFrame, col: str, keys: list[str], n: int = 10) -> DataFrame:
    """O3: top ``n`` rows by ``abs(col)`` (ties by ``keys``), with their rank."""
    top = df.orderBy(F.abs(col).desc(), *keys).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.abs(col).desc(), *keys)))


def order_by_label_id(df: DataFrame, label: str) -> DataFrame:
    """Order by the leading id number inside a label, nulls last, then the label.

    Emits ``label_id`` (the parsed number, null when absent) as the sort key.
    """
    num = F.regexp_extract(F.col(label), r"^\s*(\d+)", 1)
    out = df.withColumn("label_id", F.when(num != "", num.cast("bigint")))
    return out.orderBy(F.col("label_id").asc_nulls_last(), F.col(label))


def deviation_kpis(points: DataFrame, name: str = "pdc") -> DataFrame:
    """Consolidate homonyms by name, keep plan != 0; counts and % over/under plan,
    overall status, exact median % deviation (``percentile`` is exact, interpolated).
    """
    g = points.groupBy(name).agg(F.sum("plan").alias("plan"), F.sum("real").alias("real"))
    g = g.filter(F.col("plan") != 0).withColumn(
        "dev_pct", (F.col("real") - F.col("plan")).cast("double") / F.abs(F.col("plan").cast("double")) * 100
    )
    from spendgrid.functions.windows import exact_percentile

    med = exact_percentile(g, "dev_pct", 0.5)  # distributed exact median
    k = g.agg(
        F.count("*").alias("n_points"),
        F.sum(F.when(F.col("real") > F.col("plan"), 1).otherwise(0)).alias("n_over"),
        F.sum(F.when(F.col("real") <= F.col("plan"), 1).otherwise(0)).alias("n_under"),
        F.sum("plan").alias("plan"),
        F.sum("real").alias("real"),
    ).withColumn("median_dev_pct", F.lit(med).cast("double"))
    return k.select(
        F.col("n_points").cast("bigint").alias("n_points"),
        F.col("n_over").cast("bigint").alias("n_over"),
        F.col("n_under").cast("bigint").alias("n_under"),
        F.round(F.col("n_over") / F.col("n_points") * 100, 4).alias("pct_over"),
        F.round(F.col("n_under") / F.col("n_points") * 100, 4).alias("pct_under"),
        F.round(F.col("plan"), 2).cast("double").alias("plan"),
        F.round(F.col("real"), 2).cast("double").alias("real"),
        F.when(F.col("real") > F.col("plan"), "Sobre plan").otherwise("Bajo plan").alias("status"),
        F.round("median_dev_pct", 4).alias("median_dev_pct"),
    )


def deviation_histogram(points: DataFrame, col: str = "vs_plan_abs", bins: int = 40) -> DataFrame:
    """Clipped deviation histogram in millions with sigma bands.

    L = min(max(1, ceil(q99(|x|))), max(2, ceil(max|x|))); 40 equal bins on [-L, L], the
    last bin closed; sigma = sample sd of the kept values (1.0 when 0 or undefined);
    band by |centre| < width -> plan, then |centre|/sigma <= 1, <= 2, else 3 sigma.
    Empty bins appear with count 0 (left join from ``range(bins)``).
    """
    from spendgrid.functions.windows import exact_percentile

    x = points.select((F.col(col) / 1e6).alias("x")).filter(F.col("x").isNotNull())
    q99 = exact_percentile(x, F.abs(F.col("x")), 0.99)  # distributed exact quantile
    mx = x.agg(F.max(F.abs("x"))).first()[0]
    lim = F.lit(float(min(max(1.0, math.ceil(q99)), max(2.0, math.ceil(mx)))))
    kept = x.filter((F.col("x") >= -lim) & (F.col("x") <= lim))
    sd = kept.select(F.stddev_samp("x").alias("sd")).scalar()
    sigma = F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd)
    width = (lim * 2) / bins
    b = F.least(F.floor((F.col("x") + lim) / width), F.lit(bins - 1)).cast("int")
    counts = kept.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    spark = points.sparkSession
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = all_bins.join(counts, "bin", "left").fillna(0, ["n"])
    centre = -lim + (F.col("bin") + 0.5) * width
    band = (
        F.when(F.abs(centre) < width, "plan")
        .when(F.abs(centre) / sigma <= 1, "1s")
        .when(F.abs(centre) / sigma <= 2, "2s")
        .otherwise("3s")
    )
    return out.select(
        "bin",
        F.round(-lim + F.col("bin") * width, 6).alias("lo"),
        F.round(-lim + (F.col("bin") + 1) * width, 6).alias("hi"),
        F.col("n").cast("bigint").alias("n"),
        band.alias("band"),
    )


def find_points(catalog: DataFrame, centres: DataFrame, q: str) -> DataFrame:
    """Union of matches by name, by id text and by cost-centre id, mapped to the point.

    ``catalog(name, point_id)``, ``centres(name, centre_id)``; returns distinct points.
    """
    ql = q.lower()
    by_name = catalog.filter(F.lower("name").contains(ql)).select("name", "point_id")
    by_id = catalog.filter(F.col("point_id").cast("string").contains(q)).select("name", "point_id")
    by_centre = (
        centres.filter(F.col("centre_id").cast("string") == F.lit(q))
        .select("name")
        .join(catalog, "name")
        .select("name", "point_id")
    )
    return by_name.union(by_id).union(by_centre).distinct()

"""Versioned snapshots: discovery, build-once aggregates and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendgrid.operators.catalog import attach_catalog, dedupe_first, outer_align


def snapshots_available(real: DataFrame, plan: DataFrame, col: str = "snapshot") -> DataFrame:
    """Snapshot ids present in **both** the actuals and the plan extracts, newest first."""
    return real.select(col).distinct().intersect(plan.select(col).distinct()).orderBy(F.col(col).desc())


def clean_catalog(catalog: DataFrame, key_raw: str = "account_raw", order: str = "pos") -> DataFrame:
    """Trim the catalog key and keep the first row per key."""
    c = catalog.withColumn("account_id", F.trim(F.col(key_raw)))
    return dedupe_first(c, "account_id", [order]).select("account_id", "grupo", "cuenta")


def snapshot_aggregate(extract: DataFrame, catalog: DataFrame, value: str, week: int | None = None) -> DataFrame:
    """Aggregate one extract to (snapshot, grupo, cuenta) through the account catalog.

    The extract's id is trimmed, joined left to the cleaned catalog (unmatched ->
    ``(Sin dato)``) and summed; ``week`` restricts to one week before summing.
    """
    e = extract.withColumn("account_id", F.trim(F.col("account_raw")))
    if week is not None:
        e = e.filter(F.col("sem") == week)
    j = attach_catalog(e, catalog, "account_id", ["grupo", "cuenta"])
    return j.groupBy("snapshot", "grupo", "cuenta").agg(F.sum("amount").alias(value))


def compare_snapshots(
    real: DataFrame, plan: DataFrame, catalog: DataFrame, cur: int, cmp: int, week: int | None = None
) -> DataFrame:
    """Actuals of snapshot ``cur`` vs ``cmp`` per (group, account), with the plan of
    ``cur``; full outer joins fill 0; group and total levels by ``ROLLUP``.

    Output per row: level (2 account, 1 group, 0 total), plan, real_cur, real_cmp,
    var_abs = cur - cmp, var_pct = var_abs / |cmp| * 100 (0 when cmp is 0).
    """
    cat = clean_catalog(catalog)
    keys = ["grupo", "cuenta"]
    # one pass over the actuals: both snapshots are columns of the same aggregate
    both = snapshot_aggregate(real.filter(F.col("snapshot").isin(cur, cmp)), cat, "r", week)
    at = lambda s: F.sum(F.when(F.col("snapshot") == s, F.col("r")))
    act = both.groupBy(*keys).agg(at(cur).alias("real_cur"), at(cmp).alias("real_cmp"))
    p = snapshot_aggregate(plan.filter(F.col("snapshot") == cur), cat, "plan", week).drop("snapshot")
    m = outer_align(p, act, keys)
    lvl = (2 - (F.grouping("grupo") + F.grouping("cuenta"))).cast("int")
    g = m.rollup(*keys).agg(
        F.sum("plan").alias("plan"), F.sum("real_cur").alias("real_cur"), F.sum("real_cmp").alias("real_cmp"), lvl.alias("level")
    )
    var = F.col("real_cur") - F.col("real_cmp")
    cmpd = F.col("real_cmp").cast("double")
    return g.select(
        *keys,
        "level",
        F.round("plan", 2).cast("double").alias("plan"),
        F.round("real_cur", 2).cast("double").alias("real_cur"),
        F.round("real_cmp", 2).cast("double").alias("real_cmp"),
        F.round(var, 2).cast("double").alias("var_abs"),
        F.round(F.when(cmpd == 0, F.lit(0.0)).otherwise(var.cast("double") / F.abs(cmpd) * 100), 4).alias("var_pct"),
    )


def _modified(spark, path: str) -> list:
    """Modification times of the data files below ``path``, from the file listing alone: no file is
    opened, and a path that does not exist has none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return []
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    oldest, newest = files.agg(F.min("modificationTime"), F.max("modificationTime")).first()
    return [] if oldest is None else [oldest, newest]


def cached_aggregate(build, source_paths: list[str], target: str, spark) -> DataFrame:
    """Build-once cache of an aggregate, rebuilt when any source is newer or there is none.

    Freshness comes from the files' modification times. ``build()`` returns the aggregate."""
    newest = max((m[1] for p in source_paths if (m := _modified(spark, p))), default=None)
    oldest = m[0] if (m := _modified(spark, target)) else None
    if oldest is None or (newest is not None and newest > oldest):
        build().write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)

"""Project tracker joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def code_to_int(c):
    """Text / int / float project code -> int; anything unparsable -> null."""
    d = F.trim(c.cast("string")).try_cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d), d.try_cast("bigint"))


def attach_spend(tracker: DataFrame, catalog: DataFrame, spend: DataFrame, code: str = "eco") -> DataFrame:
    """Tracker code -> int -> catalog name -> spend pivot (left joins); missing spend
    is 0; delta = actual - plan. ``catalog(id, name)``, ``spend(name, R25, P26, R26)``."""
    t = tracker.withColumn("code_id", code_to_int(F.col(code)))
    j = t.join(catalog.select(F.col("id").alias("code_id"), F.col("name").alias("pdc")), "code_id", "left")
    j = j.join(spend.withColumnRenamed("name", "pdc"), "pdc", "left").fillna(0, ["R25", "P26", "R26"])
    return j.withColumn("delta", F.col("R26") - F.col("P26"))


def tracker_summary(summary: DataFrame) -> DataFrame:
    """Per project plan vs current: delta and direction (alza / baja)."""
    d = F.col("current") - F.col("plan")
    return summary.select("project", "plan", "current", d.alias("delta"),
                          F.when(d > 0, F.lit("alza")).otherwise(F.lit("baja")).alias("direction"))

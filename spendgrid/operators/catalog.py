"""Catalog joins and name cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The missing-category label and the "ungrouped" label.
MISSING = "(Sin dato)"
UNGROUPED = "Sin agrupar"
# Name texts treated as missing when building a display label.
MISSING_LIKE = ["", "0", "0.0", "nan", "NaN", "None"]


def clean_category(c: Column, fill: str = MISSING) -> Column:
    """Cast to string, trim; empty or null -> the missing category."""
    return F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit(fill))


def dedupe_first(df: DataFrame, key: list[str] | str, order: list[str]) -> DataFrame:
    """Keep the first row per key under an explicit order (deterministic).

    A ``min_by`` aggregate rather than a window: partial aggregation combines rows
    map-side, so a key holding a large share of the rows never sits whole in one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order]))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def attach_catalog(facts: DataFrame, catalog: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Left join to a (deduplicated) catalog; unmatched/blank names -> ``(Sin dato)``.

    The catalog side is not forced to broadcast: Spark's size check
    (``autoBroadcastJoinThreshold`` / AQE) decides from the actual catalog size.
    """
    j = facts.join(catalog.select(key, *cols), key, "left")
    return j.withColumns({c: clean_category(F.col(c)) for c in cols})


def outer_align(a: DataFrame, b: DataFrame, keys: list[str], fill: float = 0.0) -> DataFrame:
    """Full outer join of two aggregates on all keys; missing measures -> 0."""
    j = a.join(b, keys, "full")
    measures = [c for c in j.columns if c not in keys]
    return j.fillna(fill, measures)


def label_with_id(df: DataFrame, name_col: str, catalog: DataFrame, out: str = "label") -> DataFrame:
    """``"<id> · <name>"``; missing-like names -> ``Sin agrupar``; no id -> name.

    ``catalog(name, id)`` where ``id`` may be text, integer or float: integral positive
    values print without decimals, other missing-like ids fall back to the bare name.
    """
    cat = catalog.select(F.trim(F.col("name").cast("string")).alias("_name"), F.col("id").cast("string").alias("_id"))
    nm = F.trim(F.col(name_col).cast("string"))
    j = df.withColumn("_name", nm).join(cat, "_name", "left")
    idt = F.trim(F.col("_id"))
    num = idt.try_cast("double")
    id_txt = (
        F.when(num.isNotNull() & (num == F.floor(num)) & (num > 0), F.floor(num).cast("bigint").cast("string"))
        .otherwise(idt)
    )
    missing_id = F.col("_id").isNull() | idt.isin(MISSING_LIKE)
    missing_name = F.col(name_col).isNull() | nm.isin(MISSING_LIKE)
    label = (
        F.when(missing_name, F.lit(UNGROUPED))
        .when(missing_id, nm)
        .otherwise(F.concat(id_txt, F.lit(" · "), nm))
    )
    return j.withColumn(out, label).drop("_name", "_id")


def learn_canonical(dfs: list[DataFrame], cols: list[str]) -> DataFrame:
    """per column, case-insensitive variants map to the one with the fewest
    upper-case letters (ties: the smallest string). Learned over several tables.

    Returns ``(column, value, canonical)``; the value set is one distinct aggregate.
    """
    parts = []
    for df in dfs:
        for c in cols:
            if c in df.columns:
                parts.append(df.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")))
    vals = reduce(DataFrame.unionByName, parts).filter(F.col("value").isNotNull()).distinct()
    n_upper = F.length("value") - F.length(F.regexp_replace("value", r"\p{Lu}", ""))
    best = vals.groupBy("column", F.lower("value").alias("lv")).agg(
        F.min_by("value", F.struct(n_upper, F.col("value"))).alias("canonical")
    )
    return vals.withColumn("lv", F.lower("value")).join(best, ["column", "lv"]).select("column", "value", "canonical")


def apply_canonical(df: DataFrame, mapping: DataFrame, cols: list[str]) -> DataFrame:
    """replace each column's value by its canonical variant (left join per column)."""
    for c in cols:
        m = mapping.filter(F.col("column") == c).select(F.col("value").alias(c), F.col("canonical").alias("_canon"))
        df = df.join(m, c, "left").withColumn(c, F.coalesce("_canon", F.col(c))).drop("_canon")
    return df

"""Long-format fact: wide->long, conditional pivots, series totals, match report, top
centres and the fast index (P9, A11-A14, O4, O5, S11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendgrid.session import stored

# Series codes of the long fact (prior actual, plan, actual, new plan).
SERIES = {"real_py": "R25", "plan": "P26", "real": "R26", "new_plan": "NVO"}


def to_long(df: DataFrame, ids: list[str], measures=("real_py", "plan", "new_plan", "real")) -> DataFrame:
    """Wide -> long with ``serie`` codes and ``monto`` (``DataFrame.unpivot``)."""
    w = df.select(*ids, *[F.col(m).alias(SERIES[m]) for m in measures])
    return w.unpivot(ids, [SERIES[m] for m in measures], "serie", "monto")


def pivot_series(long: DataFrame, keys: list[str], cut: int, codes=("R25", "P26", "R26")) -> DataFrame:
    """``SUM(CASE WHEN serie = x THEN monto ELSE 0 END)`` per listed series, sem <= cut."""
    zero = F.lit(0).cast("decimal(18,5)")
    f = long.filter(F.col("sem") <= cut)
    return f.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("serie") == c, F.col("monto")).otherwise(zero)).alias(c) for c in codes]
    )


def pivot_wide(long: DataFrame, key: list[str] | str, codes=("R25", "P26", "R26", "NVO")) -> DataFrame:
    """``groupBy(key).pivot('serie', codes).sum('monto')``; missing -> 0.

    Listing the pivot values avoids the extra distinct-values job and makes absent
    series appear as zero columns.
    """
    keys = [key] if isinstance(key, str) else list(key)
    p = long.groupBy(*keys).pivot("serie", list(codes)).agg(F.sum("monto"))
    return p.fillna(0, list(codes))


def series_totals(long: DataFrame, cut: int) -> DataFrame:
    """Totals per series (NVO included) up to the cut week."""
    return long.filter(F.col("sem") <= cut).groupBy("serie").agg(F.sum("monto").alias("total"))


# Point names that mean "no point assigned".
GENERIC_POINTS = ["0", "(Sin dato)", "Sin agrupar"]


def match_report(long: DataFrame, cut: int, point: str = "pdc", centre: str = "centre") -> DataFrame:
    """Centres with no/generic point vs assigned: distinct centres and actual R26."""
    bucket = F.when(F.col(point).isNull() | F.col(point).isin(GENERIC_POINTS), F.lit("generic")).otherwise(
        F.lit("assigned")
    )
    zero = F.lit(0).cast("decimal(18,5)")
    return (
        long.filter(F.col("sem") <= cut)
        .groupBy(bucket.alias("match"))
        .agg(
            F.countDistinct(centre).alias("n_centres"),
            F.sum(F.when(F.col("serie") == "R26", F.col("monto")).otherwise(zero)).alias("R26"),
        )
    )


def centre_detail(long: DataFrame, centre_id: str, cut: int, grupo: str | None = None, n: int = 20) -> DataFrame:
    """The top ``n`` (centre, point, division, group, account) rows of centres whose id
    contains ``centre_id``, by actual desc; totals over *all* matching rows are attached."""
    f = long.filter(F.col("centre").cast("string").contains(centre_id) & (F.col("sem") <= cut))
    if grupo is not None:
        f = f.filter(F.col("grupo") == grupo)
    keys = ["centre", "pdc", "division", "grupo", "cuenta"]
    g = stored(pivot_series(f, keys, cut), "centre-detail")  # the rows and their total read it back
    tot = g.agg(F.sum("R25").alias("total_R25"), F.sum("P26").alias("total_P26"), F.sum("R26").alias("total_R26"))  # one row
    return g.orderBy(F.col("R26").desc(), *keys).limit(n).crossJoin(F.broadcast(tot))


def top_centres(long: DataFrame, cut: int, n: int = 12) -> DataFrame:
    """Top ``n`` (point, centre, division) by actual up to the cut week."""
    keys = ["pdc", "centre", "division"]
    g = pivot_series(long, keys, cut, codes=("R26",))
    return g.orderBy(F.col("R26").desc(), *keys).limit(n)


def build_fast_index(long: DataFrame, top_n: int = 500) -> DataFrame:
    """Totals by division, by group, by centre (the top N by R26) and by week, NULL keys
    excluded, as one frame ``(kind, key, R25, P26, R26, NVO)``. One GROUPING SETS aggregate over
    the long fact; its rows are stored for the two readers (top centres, and the rest)."""
    codes = ("R25", "P26", "R26", "NVO")
    zero = F.lit(0).cast("decimal(18,5)")
    dims = {"division": "division", "grupo": "group", "centre": "centre", "sem": "week"}
    sums = [F.sum(F.when(F.col("serie") == c, F.col("monto")).otherwise(zero)).alias(c) for c in codes]
    g = long.filter(F.col("sem") <= 99).groupingSets([[d] for d in dims], *dims).agg(F.grouping_id(*dims).alias("gid"), *sums)
    kind, key = None, None
    for i, (d, name) in enumerate(dims.items()):
        mine = F.col("gid") == (2 ** len(dims) - 1) - 2 ** (len(dims) - 1 - i)  # all but this one are rolled up
        kind = F.when(mine, name) if kind is None else kind.when(mine, name)
        key = F.when(mine, F.col(d).cast("string")) if key is None else key.when(mine, F.col(d).cast("string"))
    g = stored(g.select(kind.alias("kind"), key.alias("key"), *codes).filter(F.col("key").isNotNull()), "fast-index")
    centres = g.filter(F.col("kind") == "centre").orderBy(F.col("R26").desc(), "key").limit(top_n)
    return g.filter(F.col("kind") != "centre").unionByName(centres)

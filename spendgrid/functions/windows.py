"""Skew-safe ordered prefix sums, row numbers and exact quantiles.

A window partitioned by a key puts every row of that key in one task; when one key
holds a large share of the rows that task dominates. Here the rows are range-partitioned
on (key, order) instead, so a hot key is split across many tasks. Each row's partition
number is stored with it, once; partial results and offsets are then both taken by that
column, so they always belong together, whatever columns a reader of the result uses.
Quantiles move no values at all: histograms close in on them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendgrid.session import stored


def _ranged(df: DataFrame, n: int, *cols) -> DataFrame:
    """``df`` with the number of its range partition along ``cols`` as column ``_part``."""
    return stored(df.repartitionByRange(n, *cols).withColumn("_part", F.spark_partition_id()), "ranged")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def prefix_sum(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str,
               inclusive: bool = True, partitions: int | None = None) -> DataFrame:
    """Running sum of ``value`` per ``keys`` along ``order`` (ties must be broken by
    ``order``). ``inclusive=False`` gives the sum over strictly earlier rows."""
    ranged = _ranged(df, partitions or _partitions(df), *[F.col(k) for k in keys], *order)
    local_w = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_local", F.sum(value).over(local_w))
    # per (partition, key) totals: at most partitions x keys-per-partition rows
    tot = ranged.groupBy("_part", *keys).agg(F.sum(value).alias("_tot"))
    off_w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tot.withColumn("_off", F.coalesce(F.sum("_tot").over(off_w), F.lit(0)))
    offsets = offsets.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys], "_off")
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    run = F.col("_local") + F.col("_off")
    if not inclusive:
        run = run - F.col(value)
    return local.join(offsets, same).withColumn(out, run).drop("_part", "_local", "_off", "_p", *[f"_k_{k}" for k in keys])


def global_index(df: DataFrame, order: list, out: str = "idx") -> DataFrame:
    """0-based position of each row in ``order`` without a single-partition window: number
    rows inside each range partition, add the counts of earlier partitions. Rows that tie in
    ``order`` take consecutive positions."""
    r = _ranged(df, _partitions(df), *order)
    local = r.withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    counts = r.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    offs = counts.withColumn(
        "_off", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    # offsets: one row per partition
    return local.join(F.broadcast(offs.select("_part", "_off")), "_part").withColumn(out, F.col("_i") + F.col("_off")).drop("_part", "_i", "_off")


#: Equal parts of an interval that a pass of the quantile search counts.
BINS = 4096


def exact_percentile(df: DataFrame, col, q: float):
    """Exact quantile with linear interpolation of a whole column, as ``exact_percentiles``. Returns a
    Python float (None for no values)."""
    d = df.select(F.lit(0).alias("all"), (F.col(col) if isinstance(col, str) else col).alias("v"))
    got = exact_percentiles(d, ["all"], "v", {"q": q}).first()
    return None if got is None else got["q"]


def _same(left: str, right: str, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) for k in keys])


def exact_percentiles(df: DataFrame, keys: list[str], col: str, qs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation (``lo + (hi - lo) * frac``) per group: ``keys`` and one
    column per entry of ``qs``. Nulls are left out; groups without values are too. Infinities are
    ordered as numbers, NaN above all.

    Selection by histograms, without sorting or moving the values: a pass counts, for every group,
    the values in ``BINS`` equal parts of the interval that holds a wanted position, by partial
    aggregates, and goes on with the part that it falls into, cut down to its smallest and largest
    value; equal values end it. Each pass splits the smallest from the largest value and cuts an
    interval by ``BINS``, so that a few passes suffice; the values are stored once and scanned in
    each. A group's state is a row per wanted position, joined to the scan by the planner's choice.
    """
    d = df.select(*[F.col(k) for k in keys], F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    d = stored(d, "quantile-values")
    inf = F.lit(float("inf"))
    finite = ~F.isnan("_v") & (F.abs("_v") < inf)
    sizes = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_v") == -inf).alias("_low"), F.count_if(finite).alias("_mid"),
        F.count_if(F.col("_v") == inf).alias("_high"),
        F.min(F.when(finite, F.col("_v"))).alias("_lo"), F.max(F.when(finite, F.col("_v"))).alias("_hi"),
    )
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q"), F.lit(up).alias("up")) for name, q in qs.items() for up in (0, 1)]))
    state = sizes.withColumn("_w", wanted).withColumn("_at", F.col("_w.q") * (F.col("_n") - 1))
    rank = F.when(F.col("_w.up") == 1, F.ceil("_at")).otherwise(F.floor("_at")).cast("bigint")
    state = state.withColumn("_rank", rank - F.col("_low"))
    # positions among the infinite values and NaN are known already
    beyond = F.when(F.col("_rank") < 0, -inf).when(F.col("_rank") >= F.col("_mid") + F.col("_high"), F.lit(float("nan"))).when(F.col("_rank") >= F.col("_mid"), inf)
    state = state.select(*keys, "_w.name", "_w.up", "_at", "_rank", F.coalesce(beyond, "_lo").alias("_lo"), F.coalesce(beyond, "_hi").alias("_hi"))
    columns = state.columns
    state = stored(state, "quantile-state")
    values = d.filter(finite)
    while state.filter("_lo < _hi").limit(1).count():
        open_, done = state.filter("_lo < _hi"), state.filter("NOT _lo < _hi")
        spans = open_.select(*keys, "_lo", "_hi").distinct()
        inside = values.alias("d").join(spans.alias("s"), _same("d", "s", keys) & F.col("_v").between(F.col("_lo"), F.col("_hi")))
        # halves, where the width itself is too large for a double
        wide = F.col("_hi") / 2 - F.col("_lo") / 2 > F.lit(8e307)
        part = F.when(wide, (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2))
        part = part.otherwise((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
        bin_ = F.least(F.floor(part * BINS), F.lit(BINS - 1)).cast("int")
        hist = inside.groupBy(*[F.col(f"d.`{k}`") for k in keys], "_lo", "_hi", bin_.alias("_bin"))
        hist = hist.agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        up = Window.partitionBy(*keys, "_lo", "_hi").orderBy("_bin")  # at most BINS rows
        hist = hist.withColumn("_to", F.sum("_c").over(up)).withColumn("_from", F.col("_to") - F.col("_c"))
        same = _same("o", "h", [*keys, "_lo", "_hi"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
        cut = open_.alias("o").join(hist.alias("h"), same)
        cut = cut.select(*[F.col(f"o.`{k}`") for k in keys], "name", "up", "_at", (F.col("_rank") - F.col("_from")).alias("_rank"), F.col("_min").alias("_lo"), F.col("_max").alias("_hi"))
        state = stored(done.unionByName(cut.select(*columns)), "quantile-state")
    out = []
    for name in qs:
        lo, hi = (F.max(F.when((F.col("name") == name) & (F.col("up") == u), F.col("_lo"))) for u in (0, 1))
        frac = F.max(F.when(F.col("name") == name, F.col("_at") - F.floor("_at")))
        out.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * frac).alias(name))
    return state.groupBy(*keys).agg(*out)

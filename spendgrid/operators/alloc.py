"""Greedy allocation by bid and auction prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendgrid.functions.windows import prefix_sum


def allocate_by_bid(bids: DataFrame, totals: DataFrame) -> DataFrame:
    """In each auction, bids in descending order (ties by agent) take
    ``max(0, min(bid, total - sum of higher bids))``. ``totals(auction, total)``.

    The running sum of higher bids is skew-safe (range-partitioned prefix sum), so an
    auction holding most of the bids is still spread over many tasks.
    """
    order = [F.col("bid").desc(), F.col("agent")]
    r = prefix_sum(bids, ["auction"], order, "bid", "higher", inclusive=False)
    r = r.join(totals, "auction")
    alloc = F.greatest(F.lit(0.0), F.least(F.col("bid"), F.col("total") - F.col("higher")))
    return r.withColumn("alloc", alloc)


def auction_prices(alloc: DataFrame) -> DataFrame:
    """price = the highest *other* bid in the auction, only for allocated agents;
    utility = alloc x (valuation - price); welfare = total allocation of the auction.

    The top two bids per auction come from ``row_number() <= 2`` (planned with a
    per-partition group limit), then a join back on the auction.
    """
    w = Window.partitionBy("auction").orderBy(F.col("bid").desc(), F.col("agent"))
    top2 = alloc.select("auction", "agent", "bid").withColumn("r", F.row_number().over(w)).filter("r <= 2")
    tops = top2.groupBy("auction").agg(
        F.max(F.when(F.col("r") == 1, F.col("agent"))).alias("top_agent"),
        F.max(F.when(F.col("r") == 1, F.col("bid"))).alias("b1"),
        F.max(F.when(F.col("r") == 2, F.col("bid"))).alias("b2"),
    )
    welfare = alloc.groupBy("auction").agg(F.sum("alloc").alias("welfare"))
    j = alloc.join(tops, "auction").join(welfare, "auction")
    other = F.when(F.col("agent") == F.col("top_agent"), F.coalesce(F.col("b2"), F.lit(0.0))).otherwise(F.col("b1"))
    price = F.when(F.col("alloc") > 0, other).otherwise(F.lit(0.0))
    d = lambda c: F.round(c.cast("double"), 6)
    return j.select(
        "auction", "agent", d(F.col("bid")).alias("bid"), d(F.col("alloc")).alias("alloc"),
        d(price).alias("price"), F.round((F.col("alloc") * (F.col("bid") - price)).cast("double"), 4).alias("utility"),
        d(F.col("welfare")).alias("welfare"),
    )

"""Graph cut values of node assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _side(a, v):
    """Bit ``v`` of ``a`` (both columns; exact for the small integers used here)."""
    return (F.floor(a / F.pow(F.lit(2), v)) % 2).cast("int")


def cut_values(edges: DataFrame, assignments: DataFrame) -> DataFrame:
    """Cut value of each assignment ``(assignment, node, side)`` over ``edges(i, j)``:
    the number of edges whose ends are on different sides; ``best`` marks the maximum,
    ``baseline`` is half the edges (a random assignment's expectation)."""
    s = assignments
    e = edges.join(s.select("assignment", F.col("node").alias("i"), F.col("side").alias("si")), "i")
    e = e.join(s.select("assignment", F.col("node").alias("j"), F.col("side").alias("sj")), ["assignment", "j"])
    g = e.groupBy("assignment").agg(F.sum(F.when(F.col("si") != F.col("sj"), 1).otherwise(0)).cast("bigint").alias("cut"))
    n_edges = edges.select(F.count(F.lit(1))).scalar()
    best = g.select(F.max("cut")).scalar()
    return g.select("assignment", "cut", (F.col("cut") == best).alias("best"), (n_edges / 2.0).alias("baseline"))


def bit_assignments(nodes: DataFrame, bits: int) -> DataFrame:
    """Assignment k puts node v on side ``bit k of v`` (k = 0..bits-1)."""
    k = F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("assignment")
    return nodes.select("node", k).select("assignment", "node", _side(F.col("node"), F.col("assignment")).alias("side"))


MAX_NODES = 34  # 2^(n-1) assignments are tried


def best_cut(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """G2 exhaustive mode: the largest cut over all 2^n assignments of the graph's nodes 0..n-1 (bit v
    of the assignment number is node v's side), how many reach it, and the smallest of them.

    A cut does not change when all sides are swapped, so the last node's side is fixed: 2^(n-1)
    assignments, spread over the tasks, each counted twice. Their cut is a sum over nodes of set
    bits, of the node's neighbours on the other side: n terms, whatever the number of edges (which
    are distinct pairs; self loops cut nothing). A graph with a node outside 0..MAX_NODES-1 raises.
    """
    lo, hi = edges.agg(F.min(F.least("i", "j")), F.max(F.greatest("i", "j"))).first()
    if lo is not None and (lo < 0 or hi >= MAX_NODES):
        raise ValueError(f"nodes {lo}..{hi}: all assignments can be tried for nodes 0..{MAX_NODES - 1} only")
    n = 0 if hi is None else hi + 1
    e = edges.filter("i <> j").select("i", "j").distinct().collect()  # fewer than MAX_NODES^2
    near = [sum(1 << w for w in {r["j"] for r in e if r["i"] == v} | {r["i"] for r in e if r["j"] == v}) for v in range(n)]
    a = F.col("assignment")
    cut = F.lit(0).cast("bigint")
    for v, mask in enumerate(near[:-1]):  # nodes on side 1; the last one stays on side 0
        cut = cut + F.shiftright(a, v).bitwiseAND(F.lit(1)) * F.bit_count(F.bitwise_not(a).bitwiseAND(F.lit(mask).cast("bigint")))
    g = spark.range(1 << max(n - 1, 0)).select(F.col("id").alias("assignment")).withColumn("cut", cut)
    sides = F.struct(F.count(F.lit(1)).alias("n"), F.min("assignment").alias("first"), F.max("assignment").alias("last"))
    top = g.groupBy("cut").agg(sides.alias("s")).orderBy(F.col("cut").desc()).limit(1)  # at most n^2 / 4 + 1 groups
    swapped = F.lit((1 << n) - 1).cast("bigint") - F.col("s.last")
    both = F.lit(2 if n else 1).cast("bigint")
    return top.select(F.col("cut").alias("best_cut"), (F.col("s.n") * both).alias("n_optimal"), F.least("s.first", swapped).alias("first_optimal"))

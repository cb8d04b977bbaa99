"""Helpers shared by the training-data operators: written stages and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendgrid.session import scratch_path

#: The white space of the word and normalisation rules: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read back.

    Cuts the lineage: what comes after it never recomputes ``df``, also when executors are lost.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused_name(df: DataFrame, column: str) -> str:
    """``column``, with underscores added until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while column.lower() in taken:
        column += "_"
    return column


#: Rows of one file that a number can tell apart, and files whose numbers are sent to the tasks.
FILE_ROWS = 1 << 36
MAX_FILES = 100_000


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` with a row number, and the name of that column, which ``df`` does not have.

    The numbers are the same in every reading and tell rows apart that agree in everything. A table
    as it was read from at most ``MAX_FILES`` files is not copied: a row is the number of its file
    and its place in it. Anything else is written with its numbers.
    """
    column = unused_name(df, "_row")
    bare = df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    if bare and unused_name(df, "_metadata") == "_metadata":
        file, first = unused_name(df, "_file"), unused_name(df, "_first")
        placed = df.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(column))
        paths = [r[0] for r in placed.select(file).distinct().limit(MAX_FILES + 1).collect()]  # one row per file
        if len(paths) <= MAX_FILES:
            files = df.sparkSession.createDataFrame([(p, i * FILE_ROWS) for i, p in enumerate(sorted(paths))], f"`{file}` string, `{first}` bigint")
            placed = placed.join(F.broadcast(files), file)  # at most MAX_FILES rows
            return placed.withColumn(column, F.col(column) + F.col(first)).drop(file, first), column
    return written(df.withColumn(column, F.monotonically_increasing_id()), name), column


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 100) -> DataFrame:
    """Components of an undirected graph given as ``edges(a, b)`` (bigint, no nulls).

    Alternates the large-star and small-star rewrites until the edge set is a set of stars.
    Minima are partial aggregates, and the joins are plain equi-joins whose hot keys adaptive
    execution can split, so a node with very many links needs no task of its own. Returns
    ``(node, component)`` for every node with a link to another node; ``component`` is the
    smallest node of its component. Raises if ``max_rounds`` rounds are not enough.
    """

    def signature(df):
        r = df.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        return r["n"], r["x"]

    def hooked(pairs):  # every pair (u, v) with the smallest neighbour m of u
        low = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return pairs.join(low, "u").withColumn("m", F.least("m", "u"))

    e = edges.filter(F.col("a") != F.col("b"))
    e = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, f"{name}-edges")
    before = signature(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = hooked(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = hooked(large)
        small = near.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(near.select("u", F.col("m").alias("v"))).distinct()
        e = written(small, f"{name}-edges")
        after = signature(e)
        if after == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = after
    raise RuntimeError(f"components not stable after {max_rounds} rounds")

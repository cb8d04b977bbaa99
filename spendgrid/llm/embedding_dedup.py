"""Embedding near-duplicates: spherical k-means cells and blocked cosine products.

Vectors of a label are compared inside k-means cells. A vector is a member of its nearest cell and
a guest of every cell whose border is so near that a vector within the threshold may lie beyond it.
Members and guests of a cell are dealt into blocks; each pair of blocks is one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendgrid.llm.common import connected_components, written

#: Distinct vectors for each k-means cell, and the most cells.
VECTORS_PER_CELL, MAX_CELLS = 4096, 4096
#: The codebook is fitted on about this many vectors a cell, and this many at least, chosen by
#: hash. It is the only bound: every vector is indexed.
SAMPLE_PER_CELL, LEAST_SAMPLE = 32, 4096
#: Vectors in a block; a block pair is one task's matrix product.
BLOCK = 2048
ITERATIONS = 10
#: Guests stand within this many standard deviations of a border, for a deviation at the threshold
#: in a random direction. ``sqrt(dimensions)`` would be the exact bound for any direction.
DEVIATIONS = 5.0


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision."""
    x = np.asarray(x, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, iterations: int = ITERATIONS, seed: int = 11) -> np.ndarray:
    """``k`` unit centroids of unit rows: assign by the largest cosine, move to the normalised sum.
    A centroid that no row chooses takes the row worst served."""
    rng = np.random.default_rng(seed)
    centroids = x[np.sort(rng.choice(len(x), size=min(k, len(x)), replace=False))]
    for _ in range(iterations):
        best, near = np.empty(len(x), dtype=np.int64), np.empty(len(x))
        for at in range(0, len(x), BLOCK):
            s = x[at : at + BLOCK] @ centroids.T
            best[at : at + BLOCK], near[at : at + BLOCK] = s.argmax(axis=1), s.max(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, best, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        spare = iter(np.argsort(near))
        centroids = np.array([s / n if n > 1e-12 else x[next(spare)] for s, n in zip(sums, length[:, 0], strict=True)])
    return centroids


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _cells(shared, threshold: float, deviations: float):
    """Home and guest cells of each vector; lengths without a codebook have one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        gaps = np.linalg.norm(centroids[:, None] - centroids[None], axis=2) if len(centroids) <= 256 else None
        reach = np.sqrt(2.0 - 2.0 * threshold) * min(1.0, deviations / np.sqrt(max(centroids.shape[1], 1)))
        for b in batches:
            vectors = b.column(b.schema.get_field_index("vector"))
            same = np.asarray(vectors.value_lengths()) == centroids.shape[1]
            row, cell, home = [np.flatnonzero(~same)], [np.full((~same).sum(), -1)], [np.ones((~same).sum(), dtype=bool)]
            fit = np.flatnonzero(same)
            for at in range(0, len(fit), BLOCK):
                rows = fit[at : at + BLOCK]
                s = unit(_matrix(vectors.take(pa.array(rows)))) @ centroids.T
                best = s.argmax(axis=1)
                gap = gaps[best] if gaps is not None else np.sqrt(np.maximum(2.0 - 2.0 * centroids[best] @ centroids.T, 0.0))
                # a vector within the threshold is at most its chord away; the border is this far
                i, c = np.nonzero(s.max(axis=1, keepdims=True) - s <= reach * gap + 1e-12)
                row.append(rows[i])
                cell.append(c)
                home.append(c == best[i])
            pick = pa.array(np.concatenate(row))
            out = {n: b.column(b.schema.get_field_index(n)).take(pick) for n in ("vid", "label", "mult", "vector")}
            out |= {"cell": pa.array(np.concatenate(cell).astype(np.int32)), "home": pa.array(np.concatenate(home))}
            yield pa.RecordBatch.from_pydict(out)

    return run


def _local_roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index reachable inside one block pair, by spreading minima."""
    root = np.arange(len(linked))
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], len(linked)).min(axis=1))
        low = np.minimum(low, low[low])
        if (low == root).all():
            return root
        root = low


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        vid, mult = table.column("vid").to_numpy(), table.column("mult").to_numpy()
        home, part = table.column("home").to_numpy(), table.column("part").to_numpy()
        pair = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        x = unit(_matrix(table.column("vector")))
        a, b = np.flatnonzero(part == pair[0]), np.flatnonzero(part == pair[1])
        near = x[a] @ x[b].T >= threshold
        near &= home[a][:, None] | home[b][None, :]  # two guests meet in a home cell of theirs
        if pair[0] == pair[1]:
            np.fill_diagonal(near, False)
        links = np.zeros(len(x), dtype=np.int64)
        # a link of x is counted where its other end is at home, so once
        links[a] += near @ np.where(home[b], mult[b], 0)
        if pair[0] != pair[1]:
            links[b] += near.T @ np.where(home[a], mult[a], 0)
        some_a, some_b = near.any(axis=1), near.any(axis=0)
        at = np.union1d(a[some_a], b[some_b])
        linked = np.zeros((len(at), len(at)), dtype=bool)
        linked[np.ix_(np.searchsorted(at, a[some_a]), np.searchsorted(at, b[some_b]))] = near[np.ix_(some_a, some_b)]
        root = at[_local_roots(linked | linked.T)] if len(at) else at
        return pa.table({"vid": pa.array(vid[at], pa.int64()), "links": pa.array(links[at], pa.int64()), "root": pa.array(vid[root], pa.int64())})

    return run


def embedding_groups(
    embeddings: DataFrame,
    threshold: float = 0.98,
    deviations: float = DEVIATIONS,
    vectors_per_cell: int = VECTORS_PER_CELL,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Rows link when their labels are equal and their cosine, in double precision, reaches
    ``threshold``. Nothing links with a vector that is null, empty, zero or holds a null or
    non-finite component, with a null label, or with a vector of another length. ``n_links``
    counts the other rows linked directly; repeated rows count each. ``component_id`` is the
    smallest id reachable (ids that are null come last), ``kept`` tells whether it is the row's own.

    Equal vectors of a label are compared once, with their number. With ``deviations`` at the
    square root of the dimensions no link is missed; the default misses only pairs that a cell
    border parts by a rare deviation. The codebook is broadcast: at most ``MAX_CELLS`` vectors.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "embedding-rows")
    finite = F.forall("vector", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    good = F.col("label").isNotNull() & F.coalesce(finite & F.exists("vector", lambda v: v != 0.0), F.lit(False))
    reps = rows.filter(good).groupBy("label", "vector").agg(F.count(F.lit(1)).alias("mult"), F.min("id").alias("id"))
    reps = written(reps.withColumn("vid", F.monotonically_increasing_id()), "embedding-distinct")
    by_length = reps.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    n, dim = (by_length["n"], by_length["d"]) if by_length else (0, 1)
    k = int(min(MAX_CELLS, max(1, -(-n // vectors_per_cell))))
    share = min(1.0, max(k * SAMPLE_PER_CELL, LEAST_SAMPLE) / max(n, 1))
    picked = (F.pmod(F.xxhash64("vid"), F.lit(1_000_000)) < int(share * 1_000_000) + 1) & (F.size("vector") == dim)
    sample = reps.filter(picked).select("vector").toArrow().column("vector")  # the bounded sample
    codebook = spherical_kmeans(unit(_matrix(sample)), k) if len(sample) else np.ones((1, dim)) / np.sqrt(dim)
    shared = spark.sparkContext.broadcast(codebook)
    placed = reps.select("vid", "label", "mult", "vector").mapInArrow(
        _cells(shared, threshold, deviations), reps.select("vid", "label", "mult", "vector").schema.add("cell", "integer").add("home", "boolean")
    )
    placed = written(placed.withColumn("length", F.size("vector")), "embedding-cells")
    cell = ["label", "length", "cell"]
    blocks = placed.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("parts"))
    dealt = placed.join(blocks, cell).withColumn("part", F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
    found = dealt.select(*cell, "low", "high", "vid", "mult", "home", "part", "vector").groupBy(*cell, "low", "high")
    found = written(found.applyInArrow(_compare(threshold), "vid bigint, links bigint, root bigint"), "embedding-links")
    comps = connected_components(found.select(F.col("vid").alias("a"), F.col("root").alias("b")), "embedding")
    links = found.groupBy("vid").agg(F.sum("links").alias("links"))
    state = reps.select("vid", "label", "vector", "mult", "id").join(links, "vid", "left")
    state = state.join(comps, state["vid"] == comps["node"], "left").withColumn("component", F.coalesce("component", "vid"))
    smallest = state.groupBy("component").agg(F.min("id").alias("component_id"))
    state = written(
        state.join(smallest, "component").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id"),
        "embedding-state",
    )
    r, s = rows.alias("r"), state.alias("s")
    j = r.join(s, (F.col("r.label") == F.col("s.label")) & (F.col("r.vector") == F.col("s.vector")), "left")
    component = F.when(F.col("s.n_links").isNull(), F.col("r.id")).otherwise(F.col("s.component_id"))
    return j.select(
        F.col("r.id").alias(id_col), F.coalesce("s.n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.col("r.id").eqNullSafe(component).alias("kept"),
    )

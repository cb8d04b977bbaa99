"""Clustering without a fixed K: DP-means (G1).

The source's collapsed Gibbs sampler is inherently sequential; DP-means (Kulis & Jordan, 2012) is
its small-variance limit and runs as data-parallel passes. A pass is one scan of the stored points:
tasks take distances to all centres by blocked matrix products and send the sum, size and farthest
points of each of their clusters. Between passes centres move to their means and a batch of new
ones opens at far points. Centres are K x D numbers, sent to the tasks as in MLlib's k-means.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendgrid.session import stored

#: Far points looked at for new centres in a pass, and points of a distance block.
FAR_POINTS = 1024
BLOCK = 4096


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    vec = batch.column(batch.schema.get_field_index("vec"))
    return vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row (the first of equals) and the squared distance to it."""
    own = np.empty(len(x), dtype=np.int64)
    half = (centres * centres).sum(axis=1) / 2
    for at in range(0, len(x), BLOCK):
        own[at : at + BLOCK] = (half - x[at : at + BLOCK] @ centres.T).argmin(axis=1)
    away = x - centres[own]
    return own, (away * away).sum(axis=1)


def _sums(centres: np.ndarray, lam: float):
    """Size and sum of each cluster of a task (rows with an id of null), and its points beyond ``lam``, the farthest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, total, far = np.zeros(len(centres), dtype=np.int64), np.zeros_like(centres), []
        for b in batches:
            if not b.num_rows:
                continue
            x, ids = _matrix(b), b.column(0).to_numpy()
            own, d = _nearest(x, centres)
            size += np.bincount(own, minlength=len(centres))
            np.add.at(total, own, x)
            beyond = np.flatnonzero(d > lam)
            far = heapq.nlargest(FAR_POINTS, [*far, *((d[i], -int(ids[i]), x[i].tolist()) for i in beyond)], key=lambda f: f[:2])
        used = np.flatnonzero(size)
        rows = [(int(k), None, int(size[k]), 0.0, total[k].tolist()) for k in used] + [(-1, -i, 1, float(d), v) for d, i, v in far]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
        columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "id", "size", "dmin", "vec"])

    return run


def _opened(far: list, lam: float, room: int) -> list[list[float]]:
    """Of far points in order (farthest first, then smallest id) those beyond ``lam`` of all taken before."""
    taken: list[np.ndarray] = []
    for _, _, v in far:
        v = np.array(v)
        if len(taken) < room and all(((v - t) ** 2).sum() > lam for t in taken):
            taken.append(v)
    return [t.tolist() for t in taken]


def dp_means(points: DataFrame, lam: float, max_iter: int | None = None, tol: float = 1e-3) -> tuple[DataFrame, list[int]]:
    """G1: ``points(id bigint, vec array<double>)``; returns (``(id, cluster, dmin)`` per point, K per pass).

    A pass moves each centre to its points' mean, closes those without points, and opens new ones:
    of the ``FAR_POINTS`` points farthest beyond the squared distance ``lam`` (ties: smallest id)
    those that lie beyond ``lam`` of each other, the farthest first. That choice depends on the
    points alone, not on how they are spread over tasks. As many as there are centres (eight at
    least) open at a time, so that means settle before the next. Passes go on until no centre is
    opened or closed and none moves by more than ``tol`` times the radius ``sqrt(lam)``. They end:
    means, nearest centres, and a centre opened beyond ``lam`` of all others each lower the sum of
    squared distances plus ``lam`` a centre, and there are finitely many assignments. A run given
    ``max_iter`` raises beyond it, so what is returned has converged. Cluster sizes
    are ``groupBy('cluster').count()`` of the first. Vectors have one length; an empty table has no
    clusters. What is collected in a pass: a sum per cluster, and ``FAR_POINTS`` points.
    """
    pts = stored(points.select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec")), "dp-means")
    columns = "cluster int, id bigint, size bigint, dmin double, vec array<double>"
    dims = pts.select(F.size("vec")).first()
    out = "id bigint, cluster int, dmin double"
    if dims is None:
        return pts.sparkSession.createDataFrame([], out), [0]
    d = dims[0]

    def gathered(centres):
        parts = stored(pts.mapInArrow(_sums(centres, lam), columns), "dp-means-sums")
        total = parts.filter("id IS NULL").groupBy("cluster").agg(F.sum("size").alias("size"), *[F.sum(F.col("vec")[j]).alias(f"v{j}") for j in range(d)])
        far = parts.filter("id IS NOT NULL").orderBy(F.col("dmin").desc(), "id").limit(FAR_POINTS).collect()
        sums = {r["cluster"]: np.array([r[f"v{j}"] for j in range(d)]) / r["size"] for r in total.collect()}  # K rows
        return sums, [(r["dmin"], r["id"], r["vec"]) for r in far]

    centres, history = np.zeros((1, d)), []
    centres = np.array([gathered(centres)[0][0]])  # the mean of all
    for _ in itertools.count() if max_iter is None else range(max_iter):
        means, far = gathered(centres)
        kept = sorted(means)
        moved = np.array([means[k] for k in kept])
        stable = len(kept) == len(centres) and np.sqrt(((moved - centres) ** 2).sum(axis=1)).max() <= tol * np.sqrt(lam)
        history.append(len(kept))
        if stable and not far:
            break
        new = _opened(far, lam, max(8, len(kept)))
        centres = np.vstack([moved, np.array(new).reshape(-1, d)])
    else:
        raise RuntimeError(f"not stable after {max_iter} passes (K so far {history[-1]}); lam may be too small")

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, far = _nearest(_matrix(b), centres) if b.num_rows else (np.zeros(0), np.zeros(0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.int32()), pa.array(far, pa.float64())], ["id", "cluster", "dmin"])

    return pts.mapInArrow(assigned, out), history

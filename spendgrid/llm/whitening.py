"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance is never formed. A block of vectors Q is multiplied by it in distributed passes of
centred XᵀXQ. A Chebyshev polynomial of the covariance, run as a three-term recurrence over such
passes, damps the unwanted part of the spectrum; QR and a Rayleigh-Ritz step then rotate the block
to eigenvectors, until the residuals certify them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendgrid.llm.common import written

#: Entries become integers: floor(SCALE * c) + SHIFT, c limited to what stays exact in a double.
SCALE, SHIFT, LIMIT = 1024, 100_000, 1 << 52
#: Columns of the block beyond the wanted components, degree of the filter, rounds at most.
GUARD = 24
DEGREE = 10
MAX_ROUNDS = 60
#: Residual, relative to the largest eigenvalue, that certifies; and what passes when rounding stops progress.
CERTIFIED, ROUNDED = 1e-14, 1e-11


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, x`` of the rows whose vector has the table's dimension and only finite entries.

    The dimension is the most frequent length, the larger on a tie; vectors of other lengths,
    like empty ones, belong to no common space and are dropped.
    """
    v = F.col("v")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.filter(v.isNotNull() & (F.size(v) > 0) & finite)
    floored = lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(LIMIT))), F.lit(-float(LIMIT))))
    rows = written(rows.select("id", F.transform(v, lambda c: floored(c).cast("bigint") + SHIFT).alias("x")), "whiten-vectors")
    by_size = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = by_size.orderBy(F.col("n").desc(), F.col("d").desc()).first()
    return rows if most is None else rows.filter(F.size("x") == most["d"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The batch's vectors as integer rows."""
    x = batch.column(batch.schema.get_field_index("x"))
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and exact sum of each dimension, a row per batch and dimension."""
    for b in batches:
        if b.num_rows:
            x = _matrix(b)
            wide = int(np.abs(x).max()) * len(x) >= 1 << 62
            total = x.sum(axis=0, dtype=object if wide else np.int64)
            at, n = pa.array(range(x.shape[1]), pa.int32()), pa.array([len(x)] * x.shape[1], pa.int64())
            yield pa.RecordBatch.from_arrays([at, n, pa.array([str(s) for s in total])], ["i", "n", "s"])


class Centre:
    """Row count and column sums; rows are centred as ``(x - S // n) - (S % n) / n``, without cancellation."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = np.array([s % n for s in sums], dtype=np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of ``(n * x - S)²`` of each row; null where that is beyond a long."""
        away = x - self.whole
        if not len(x):
            return []
        most = (int(np.abs(away).max()) + 1) * self.n
        if most * most * x.shape[1] < 1 << 63:
            return ((self.n * away - self.rest) ** 2).sum(axis=1).tolist()
        exact = ((self.n * away.astype(object) - self.rest.astype(object)) ** 2).sum(axis=1)
        return [int(e) if e < 1 << 63 else None for e in exact]


def _summed(rows: DataFrame, partial, width: int) -> np.ndarray:
    """Sum over tasks of a matrix of ``width`` columns, which ``partial(batch)`` gives for a batch.

    Each task sends one copy of the matrix, its partial sum; the rows are added up by Spark. What
    is collected is one matrix, dimension x block.
    """
    names = [f"c{j}" for j in range(width)]

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                part = partial(_matrix(b))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *map(pa.array, np.asarray(total, dtype=np.float64).T)], ["i", *names])

    parts = rows.mapInArrow(run, ", ".join(["i int", *(f"{c} double" for c in names)]))
    got = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).toArrow().sort_by("i")
    return np.column_stack([got.column(c).to_numpy() for c in names])


def principal_components(rows: DataFrame, centre: Centre, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``k`` largest eigenvalues and unit eigenvectors of the covariance of ``rows(x)``, and its trace.

    Block of ``k + GUARD`` vectors. Each round: filter of degree ``DEGREE`` that maps the interval
    from 0 to the block's smallest Ritz value into [-1, 1] and grows beyond it; QR; Rayleigh-Ritz.
    It ends when ``|V q - e q|`` of every wanted pair is below ``CERTIFIED`` times the largest
    eigenvalue, or no longer falls and is below ``ROUNDED`` times it; raises if neither happens.
    Signs: the entry of largest size is positive.
    """
    n, d = centre.n, len(centre.whole)
    k, m = min(k, d), min(k + GUARD, d)

    def times(q: np.ndarray) -> np.ndarray:  # one distributed pass
        def partial(x):
            c = centre.rows(x)
            return c.T @ (c @ q)

        return _summed(rows, partial, q.shape[1]) / n

    trace = float(_summed(rows, lambda x: (centre.rows(x) ** 2).sum(axis=0)[:, None], 1).sum()) / n
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, m)))[0]
    aq = times(q)
    last = np.inf
    for _ in range(MAX_ROUNDS):
        small = q.T @ aq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, aq = q @ turn, aq @ turn
        residual = float(np.linalg.norm(aq[:, :k] - q[:, :k] * values[:k], axis=0).max())
        top = max(float(values[0]), 0.0)
        if m == d or residual <= CERTIFIED * top or (residual > last / 2 and residual <= ROUNDED * top):
            sign = np.sign(q[np.abs(q[:, :k]).argmax(axis=0), np.arange(k)])
            return values[:k], q[:, :k] * np.where(sign == 0, 1, sign), trace
        last = residual
        cut = max(float(values[-1]), 1e-6 * top)  # a Ritz value of the block: the unwanted spectrum lies below or about it
        half = cut / 2
        sigma = sigma1 = half / (top - half)
        before, now = q, (aq - half * q) * (sigma / half)
        for _ in range(DEGREE - 1):
            following = 1 / (2 / sigma1 - sigma)
            before, now = now, (times(now) - half * now) * (2 * following / half) - sigma * following * before
            sigma = following
        q = np.linalg.qr(now)[0]
        aq = times(q)
    raise RuntimeError(f"components not certified after {MAX_ROUNDS} rounds (residual {residual / top:.1e})")


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per vector and component.

    Fitted on all vectors of the table's dimension without null or non-finite entries; other rows
    are dropped. Entries become ``x = floor(1024 c) + 100000`` (``1024 c`` limited to 2^52), ``n``
    rows with column sums ``S``. ``deviation`` is the exact sum of ``(n x - S)²``, null beyond a
    long. Components are numbered from 1 by falling eigenvalue ``e`` of the covariance (divisor
    ``n``); there are as many as dimensions if these are fewer. ``whitened`` is ``x - S / n``
    projected on the component, over ``sqrt(e)``; ``explained`` is ``e / trace``;
    ``identity_error`` the largest absolute entry of whitened's covariance minus the identity. A
    component without variance (up to rounding) has a null ``whitened``, explains 0 and is left out
    of ``identity_error``. Null and repeated ids stay rows; other columns are ignored; a table
    without such vectors gives no rows.

    Every pass reads the written integer vectors once and sends one dimension x block matrix a task.
    """
    spark = vectors.sparkSession
    schema = f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = integer_vectors(vectors, id_col, vec_col)
    sums = rows.mapInArrow(_sums, "i int, n bigint, s string").groupBy("i")
    sums = sums.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()  # one row per dimension
    if not sums:
        return spark.createDataFrame([], schema)
    centre = Centre(sums[0]["n"], [int(r["s"]) for r in sums])
    values, basis, trace = principal_components(rows, centre, components)
    k = len(values)
    valid = values > len(basis) * np.finfo(float).eps * trace
    explained = np.where(valid, values / trace if trace > 0 else 0.0, 0.0)
    turn = np.where(valid, basis / np.sqrt(np.where(valid, values, 1.0)), 0.0)
    moments = _summed(rows, lambda x: _moments(centre.rows(x) @ turn), k) / centre.n
    gap = np.abs(moments[:k] - np.outer(moments[k], moments[k]) - np.diag(valid.astype(float)))
    identity_error = float(gap.max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b) if b.num_rows else np.zeros((0, len(turn)), dtype=np.int64)
            w = (centre.rows(x) @ turn).reshape(-1)
            times = np.repeat(np.arange(len(x)), k)
            columns = [
                b.column(0).take(pa.array(times)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(times), centre.n, dtype=np.int64)),
                pa.array(centre.deviations(x), pa.int64()).take(pa.array(times)),
                pa.array(w, mask=~np.tile(valid, len(x))),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(times), identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = rows.mapInArrow(project, schema.replace(f"`{id_col}`", "id", 1))
    return out.withColumnRenamed("id", id_col)


def _moments(w: np.ndarray) -> np.ndarray:
    """Second moments of the rows, and below them their sum."""
    return np.vstack([w.T @ w, w.sum(axis=0)])
